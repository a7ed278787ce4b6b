from __future__ import annotations

import inspect
import random

from pyspark.sql import functions as F

from retail_engine.operators import ranking
from retail_engine.sources import driver_tables


def test_positions_follow_the_order(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(7)
    found = ranking.with_position(df, [F.desc("a"), F.asc("b")], "n").collect()
    expected = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.n)] == expected
    assert sorted(r.n for r in found) == list(range(1, 5001))


def test_equal_leading_values_spread_over_tasks(spark):
    df = spark.range(40000).select(F.lit(1).alias("a"), F.col("id"))
    placed = df.repartitionByRange(4, "a", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) == 4
    assert max(r["count"] for r in placed) < 20000


def test_rows_that_share_the_key_of_a_line_all_get_their_own_id(spark, tmp_path):
    """150 rows on each of two line numbers of one order: 300 ids, in the order of all columns."""
    lines = spark.range(300).selectExpr(
        "1L AS l_orderkey", "2L AS l_partkey", "id AS l_suppkey",
        "CAST(1 + id % 2 AS INT) AS l_linenumber", "1.0D AS l_quantity",
        "2.0D AS l_extendedprice", "0.0D AS l_discount", "0.0D AS l_tax", "'N' AS l_returnflag",
        "'O' AS l_linestatus", "TIMESTAMP_NTZ '2000-01-01 00:00:00' AS l_shipdate",
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = driver_tables.order_items(spark, str(tmp_path)).collect()
    assert sorted(r.order_item_id for r in found) == list(range(1, 301))


def test_numbering_needs_no_count_and_no_sample_of_its_own():
    source = inspect.getsource(ranking)
    assert ".count()" not in source and ".sample(" not in source


def test_ids_go_on_from_the_last_one(spark):
    new = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "request_seq bigint, name string")
    old = spark.createDataFrame([(7,), (4,)], "customer_id bigint")
    last = ranking.largest_id(old, "customer_id")
    found = ranking.next_ids(new, last, "customer_id", [F.asc("request_seq")])
    assert {(r.customer_id, r.name) for r in found.collect()} == {(8, "a"), (9, "b"), (10, "c")}
    none = ranking.largest_id(old.limit(0), "customer_id")
    first = ranking.next_ids(new, none, "customer_id", [F.asc("request_seq")])
    assert sorted(r.customer_id for r in first.collect()) == [1, 2, 3]
