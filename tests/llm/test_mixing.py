from __future__ import annotations

import numpy as np
import pytest

from retail_engine.llm import mixing
from retail_engine.llm.mixing import flight, landing, mixed
from retail_engine.llm.queries import op9_balanced_mix

SMALL = "/root/testdata/sf0.01"


def goals(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, full = dict.fromkeys(order, 0.0), set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        for s in order:
            target[s] = most * sizes[s] if s in full else rest * weight[s] / shares
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_of_the_given_documents(spark):
    rows = op9_balanced_mix(spark, SMALL).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size
    want = goals(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s, target in want.items():
        assert abs(taken[s] - target) < 0.02 * target
    again = {(r.doc_id, r.taken) for r in op9_balanced_mix(spark, SMALL).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def units(spark, tmp_path, rows):
    path = str(tmp_path / "units")
    spark.createDataFrame(rows, "row_id long, key long, source string, size long").write.parquet(path)
    return spark.read.parquet(path)


def test_blocks_meet_until_one_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rng = np.random.default_rng(1)
    rows = [(i, i % 700, "ab"[i % 3 == 0], int(n)) for i, n in enumerate(rng.integers(1, 500, 2000))]
    found = mixed(units(spark, tmp_path, rows)).collect()
    assert sorted(r.row_id for r in found) == list(range(2000))
    for s in "ab":
        own = [r for r in found if r.source == s]
        target, size = own[0].target, own[0].source_size
        assert abs(sum(r.copies * r.size for r in own) - target) < 20
        # The number of documents is balanced, too.
        assert abs(sum(r.copies for r in own) - len(own) * target / size) < 7


def test_caps_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(i, 1, "a", 10) for i in range(50)] + [(50 + i, None, "b", 1000) for i in range(30)]
    rows += [(90, 5, None, 70), (91, 6, "empty", 0), (92, 7, "empty", 0)]
    found = mixed(units(spark, tmp_path, rows)).collect()
    want = goals({"a": 500, "b": 30_000, "empty": 0, None: 70})
    assert {r.source: r.target for r in found} == pytest.approx(want)
    assert want["a"] == 1500 and all(r.copies == 3 for r in found if r.source == "a")
    assert mixed(units(spark, tmp_path / "none", [])).count() == 0


def test_flight_keeps_both_totals_and_the_chances():
    rng = np.random.default_rng(2)
    sizes, chances = rng.integers(0, 300, 200).astype(float), rng.random(200)
    drawn = np.zeros(200)
    for seed in range(400):
        out = flight(sizes, chances, np.random.default_rng(seed))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out @ sizes == pytest.approx(chances @ sizes) and out.sum() == pytest.approx(chances.sum())
        drawn += out
    assert np.abs(drawn / 400 - chances).max() < 0.12
    assert (flight(np.ones(5), np.full(5, 0.4), rng) * 5 % 5 == 0).all()
    few = flight(sizes, chances, rng, leave=8)
    landed = landing(sizes, few)
    assert set(landed) <= {0, 1} and abs(landed @ sizes - chances @ sizes) < 60
