from __future__ import annotations

import random

from retail_engine.llm import minhash
from retail_engine.llm.graph import components
from retail_engine.llm.minhash import near_duplicates


def plain(links):
    root = {n: n for link in links for n in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {(n, r) for n, r in root.items() if n != r}


def table(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def test_stars_of_chains_hubs_and_random_links(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 130)] + [(7, 200 + i) for i in range(40)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    links += [(5, 5), (201, 7), (239, 240), (240, 130)]
    found = [tuple(r) for r in components(table(spark, links)).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(links)
    assert components(table(spark, [])).count() == 0
    assert components(table(spark, [(3, 3)])).count() == 0


def test_a_round_is_one_write(spark, monkeypatch):
    """Rounds read no table only to see whether it has changed."""
    links = table(spark, [(i, i + 1) for i in range(20)])
    actions = []
    first = type(links).first
    monkeypatch.setattr(type(links), "first", lambda df: actions.append(df) or first(df))
    assert components(links).count() == 20
    assert actions == []


def test_groups_that_the_pivots_have_joined_are_not_joined_again(spark, documents, monkeypatch):
    calls = []
    monkeypatch.setattr(minhash, "components", lambda x: calls.append(1) or components(x))
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*words, f"x{i}"]), "en", "a") for i in range(6)]
    rows += [(10 + i, f"other text number {i} of its own kind", "en", "a") for i in range(4)]
    found = near_duplicates(documents(rows)).collect()
    assert sorted(r.component_id for r in found) == [0] * 6 + [10, 11, 12, 13]
    assert len(calls) == 1
