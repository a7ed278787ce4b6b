from __future__ import annotations

import random

import numpy as np
import pytest
from compare import differences, duck
from samples import sentences

from retail_engine.llm.minhash import BANDS, COORDINATES, Shingler, near_duplicates
from retail_engine.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_nn_descent", "op5_fast_similarity_sketch", "op8_gzip_normaliser"])
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), duck(SMALL), ORACLE_SQL[name]) is None


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for r, (key, *_) in zip(root, rows, strict=True):
        keys = [k for k in (least.get(r), key) if k is not None]
        least[r] = min(keys) if keys else None
    return sorted((k or -1, len(s), least[r] or -1) for (k, *_), s, r in zip(rows, sets, root, strict=True))


def found(docs):
    return sorted((r.key or -1, r.n_shingles, r.component_id or -1) for r in near_duplicates(docs).collect())


def test_near_copies_in_a_chain_and_a_large_group(documents):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        words = sentences(i % 3, 160).split()
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        rows.append((i + 1, " ".join(words), "en", "a"))
    # Each link of the chain is near the next one, but not near the one after.
    words = sentences(50, 100).split()
    for i in range(12):
        rows.append((200 - i, " ".join(words[5 * i : 5 * i + 60]), "en", "a"))
    rows += [(300 + i, "one two three", "en", "a") for i in range(3)]
    rows += [(310, "ONE  two\nthree", "en", "a"), (311, "one two", "en", "a")]
    assert found(documents(rows)) == brute(rows)


def test_odd_rows(odd, empty):
    from samples import ODD

    assert found(odd) == brute(ODD)
    assert near_duplicates(empty).count() == 0


def test_sketch_coordinates_fill_and_agree_as_often_as_sets_are_alike():
    shingler, rng = Shingler(), np.random.default_rng(1)
    for size in (1, 2, 7, 400):
        assert (shingler.sketch(rng.integers(0, 2**63, size, dtype=np.uint64)) < 2**64 - 1).all()
    errors = []
    for _ in range(30):
        both = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = shingler.sketch(both[:500]), shingler.sketch(both[100:])
        errors.append((a == b).mean() - 400 / 600)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 1.2 * (0.22 / COORDINATES) ** 0.5


def test_shingles_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    words = sentences(1, 500).encode().split()
    whole = Shingler().shingles(words)
    monkeypatch.setattr("retail_engine.llm.minhash._PIECE", 37)
    assert (Shingler().shingles(words) == whole).all() and len(whole) == 496
    assert len(Shingler().candidates(whole)[0]) == BANDS
