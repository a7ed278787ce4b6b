"""Ranges of a database key: what they hold, not the read, which needs a database."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retail_engine.sources import jdbc


def counter(keys):
    asked = []

    def count(low, high, width):
        asked.append((low, high, width))
        inside = (k for k in keys if low <= k < high)
        return Counter(k - (k - low) % width for k in inside)

    return count, asked


def held(keys, starts):
    edges = [*starts[1:], None]
    lows = [None, *starts[1:]]
    return [
        sum((a is None or k >= a) and (b is None or k < b) for k in keys)
        for a, b in zip(lows, edges, strict=True)
    ]


SPREADS = {
    "even": range(1, 5001),
    "gap": [*range(1, 2001), *range(10**12, 10**12 + 300), 10**18],
    "dense": [*range(0, 10**9, 10**6), *range(5 * 10**8 + 1, 5 * 10**8 + 4000)],
    "below zero": [*range(-(10**15), -(10**15) + 500), *range(-3, 900)],
    "drawn": sorted(random.Random(2).sample(range(10**6), 700)),
    "one": [7],
    "few": [3, 10**9],
}


@pytest.mark.parametrize("spread", SPREADS)
@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_no_range_holds_more_than_a_share(spread, partitions):
    keys = list(SPREADS[spread])
    count, asked = counter(keys)
    starts = jdbc.balanced_starts(count, min(keys), max(keys), partitions)
    rows = held(keys, starts)
    assert sum(rows) == len(keys) and min(rows) > 0
    assert max(rows) <= -(-len(keys) // partitions)
    assert len(starts) <= 2 * partitions
    # Finer counts only where a piece holds more than a share, so few of them.
    assert len(asked) <= 1 + 25 * partitions


def test_even_keys_are_counted_once():
    count, asked = counter(range(1, 10_001))
    starts = jdbc.balanced_starts(count, 1, 10_000, 8)
    assert len(asked) == 1 and len(starts) in (8, 9)


def test_equal_widths_would_leave_one_full_task():
    keys = list(SPREADS["gap"])
    count, _ = counter(keys)
    width = (max(keys) - min(keys)) / 16
    assert Counter(int((k - 1) / width) for k in keys).most_common(1)[0][1] == len(keys) - 1
    assert max(held(keys, jdbc.balanced_starts(count, 1, max(keys), 16))) <= 144


def test_predicates_put_every_key_in_one_range():
    assert jdbc.range_predicates("order_id", [5]) == ["1 = 1"]
    assert jdbc.range_predicates("order_id", [5, 9, 20]) == [
        "order_id < 9",
        "order_id >= 9 AND order_id < 20",
        "order_id >= 20",
    ]


def test_counts_and_predicates_as_sql(spark):
    keys = [*range(1, 301), *range(10**10, 10**10 + 50), 10**15]
    rows = spark.createDataFrame([(k,) for k in keys], "order_id long")
    rows.createOrReplaceTempView("jdbc_test_orders")

    def count(low, high, width):
        sql = jdbc.pieces_sql("jdbc_test_orders", "order_id", low, high, width)
        return {r.start: r.n for r in spark.sql(sql).collect()}

    plain, _ = counter(keys)
    assert count(1, 10**15 + 1, 977) == plain(1, 10**15 + 1, 977)
    starts = jdbc.balanced_starts(count, 1, 10**15, 4)
    predicates = jdbc.range_predicates("order_id", starts)
    inside = rows.agg(*(F.count_if(F.expr(p)) for p in predicates)).first()
    assert list(inside) == held(keys, starts) and max(inside) <= 88


def test_reads_that_go_on_from_a_mark_share_no_row(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 12:00:00", "2024-01-02 00:00:00", None]
    rows = spark.createDataFrame([(t,) for t in times], "t string")
    rows = rows.select(F.col("t").cast("timestamp").alias("updated_at"))
    first = jdbc.changed_condition("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    then = jdbc.changed_condition("2024-01-02 00:00:00", "2024-01-03 00:00:00")
    assert rows.where(first).count() == 2 and rows.where(then).count() == 1
    assert rows.where(f"({first}) AND {then}").count() == 0
