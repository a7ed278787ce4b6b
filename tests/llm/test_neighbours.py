from __future__ import annotations

import numpy as np
import pytest

from retail_engine.llm import neighbours
from retail_engine.llm.neighbours import near_vectors, tables_for


@pytest.fixture
def vectors(spark, tmp_path):
    def write(rows):
        path = str(tmp_path / "vectors")
        schema = "vec_id long, embedding array<float>, label int, node string, size string"
        spark.createDataFrame([(*r, "n", "s") for r in rows], schema).write.parquet(path)
        return spark.read.parquet(path)

    return write


def brute(rows):
    n = len(rows)
    cos = np.zeros((n, n))
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and None not in (la, lb, a, b) and la == lb and len(a) == len(b):
                if None in a or None in b:
                    continue
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                    cos[i, j] = x @ y / np.sqrt((x @ x) * (y @ y))
    linked = cos >= 0.93
    least = [r[0] for r in rows]
    for _ in rows:
        for i in range(n):
            for j in np.flatnonzero(linked[i]):
                least[i] = least[j] = min(least[i], least[j])
    return sorted((r[0], int(linked[i].sum()), least[i]) for i, r in enumerate(rows))


def found(df):
    return sorted((r.key, r.n_links, r.component_id) for r in near_vectors(df).collect())


def test_equals_brute_force_with_full_lists_and_copies(vectors):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(420):
        # One cluster is larger than a list is long, others are pairs and single ones.
        c = centres[0] if i < 150 else centres[1 + i % 5] if i < 160 else rng.normal(size=16)
        spread = 0.02 if i < 150 else 0.1
        v = (c + spread * np.linalg.norm(c) / 4 * rng.normal(size=16)).tolist()
        rows.append((1000 - i, v, i % 2))
    rows += [(2000 + i, rows[0][1], 0) for i in range(5)] + [(2010, [2 * x for x in rows[1][1]], 1)]
    assert found(vectors(rows)) == brute(rows)


def test_odd_rows(vectors):
    rows = [
        (1, None, 1),
        (2, [0.0, 0.0], 1),
        (3, [float("nan"), 1.0], 1),
        (4, [float("inf"), 1.0], 1),
        (5, [1.0, None], 1),
        (6, [1.0, 1.0], None),
        (7, [1.0, 1.0], 1),
        (8, [2.0, 2.0], 1),
        (8, [2.0, 2.0], 1),
        (9, [1.0, 1.0, 0.0], 1),
        (10, [], 1),
        (11, [1.0, 1.0], 2),
    ]
    assert found(vectors(rows)) == brute(rows)


def test_empty_table(vectors):
    assert near_vectors(vectors([])).count() == 0


def planted(number, pairs, seed):
    """Unit vectors of one label, nearly at right angles, with pairs at cosine 0.935."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    v = unit(rng.normal(size=(number, 128)))
    other = rng.normal(size=(pairs, 128))
    other -= (other * v[:pairs]).sum(axis=1)[:, None] * v[:pairs]
    v[pairs : 2 * pairs] = 0.935 * v[:pairs] + np.sqrt(1 - 0.935**2) * unit(other)
    return v


def test_sparse_links_at_the_limit_are_found(vectors):
    number, pairs = 12_000, 1000
    rows = [(i, v.tolist(), 1) for i, v in enumerate(planted(number, pairs, 3))]
    found = {r.key: r.n_links for r in near_vectors(vectors(rows)).collect()}
    assert sum(found[i] for i in range(pairs)) >= 0.995 * pairs
    assert sum(found.values()) <= 2 * pairs


def test_codes_grow_in_number_with_their_length():
    assert [tables_for(b) for b in (0, 1, 7, 11, 15)] == [1, 10, 14, 25, 44]


def test_without_enough_links_all_vectors_are_compared(vectors, monkeypatch):
    # A graph that finds nothing, and blocks smaller than the label.
    monkeypatch.setattr(neighbours, "_nearest", lambda nodes, unit: (nodes[:0], nodes[:0], unit[:0, 0]))
    monkeypatch.setattr(neighbours, "MOST_ROUNDS", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(np.repeat(planted(150, 30, 4), 2, axis=0))]
    assert found(vectors(rows)) == brute(rows)
