from __future__ import annotations

import random
import re
from collections import Counter

from samples import sentences

from retail_engine.llm.outliers import BASE, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_base_statistics_equal_a_plain_count(spark, documents, odd):
    rng = random.Random(2)
    texts = [
        " ".join(rng.choices(["a", "bb", "é", "#x", "日本"], k=rng.randint(0, 60)))
        + rng.choice(["", "\n", "\nsame\nsame\n \n"])
        for _ in range(60)
    ]
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)])
    for table in (docs, odd):
        for r in quality_rules(table).collect():
            assert tuple(r[c] for c in BASE) == base(r.record.text)
            failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept)


def test_outliers_go_and_others_stay(documents):
    rng = random.Random(4)
    rows = [(i, sentences(i, rng.randint(40, 900)), "en", "a") for i in range(300)]
    shouted = [(1000 + i, sentences(i, 200).upper().replace(" ", "!! "), "en", "a") for i in range(40)]
    marked = [(2000 + i, sentences(i, 200).replace(" ", "$$$ "), "en", "a") for i in range(40)]
    kept = {r.record.doc_id for r in quality_rules(documents(rows + shouted + marked)).collect() if r.kept}
    # A fifth of the group is odd, which would pull a plain mean and covariance towards it.
    assert kept == {r[0] for r in rows}


def test_groups_have_their_own_estimates(documents):
    plain = [(i, sentences(i, 150), "en", "a") for i in range(150)]
    loud = [(1000 + i, sentences(i, 150).upper(), "en", "b") for i in range(150)]
    stray = [(5000, sentences(9, 150).upper(), "en", "a")]
    kept = {r.record.doc_id for r in quality_rules(documents(plain + loud + stray)).collect() if r.kept}
    assert kept == {r[0] for r in plain + loud}


def test_odd_rows(odd, empty):
    rows = quality_rules(odd).collect()
    assert len(rows) == 10 and {r.record.node for r in rows} == {"n"}
    assert quality_rules(empty).count() == 0
