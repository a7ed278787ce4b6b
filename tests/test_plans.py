"""Plans that would not survive large tables are refused here."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from retail_engine.operators import intake, ranking, reports
from retail_engine.plans import catalogue
from retail_engine.schemas import WAREHOUSE

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_python_and_no_all_pairs(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    for node in ("PythonEval", "PythonUDF", "InPandas", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text


@pytest.fixture
def stored_star(spark, tmp_path):
    """A published star whose size Spark knows only from files."""
    for name, schema in WAREHOUSE.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    return {n: spark.read.schema(s).parquet(str(tmp_path / n)) for n, s in WAREHOUSE.items()}


def test_reports_read_only_their_columns(stored_star):
    text = plan(reports.daily_sales(stored_star["fact_sales"]))
    (schema,) = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert set(re.findall(r"(\w+):", schema)) == {"order_id", "revenue", "sale_date"}


def test_sales_shrink_before_they_meet_products(spark, stored_star):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(reports.sales_by_product(stored_star["fact_sales"], stored_star["dim_product"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = text.index("SortMergeJoin")
    assert "partial_sum(quantity" in text[join:]


def test_sales_shrink_to_orders_before_they_meet_customers(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(contract.queries()["sales_by_city"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [i for i in range(len(text)) if text.startswith("SortMergeJoin [customer_id", i)]
    assert joins and "keys=[order_id" in text[joins[0]:]


def test_a_small_batch_leaves_the_stored_table_where_it_is(spark, tmp_path):
    batch, store = str(tmp_path / "batch"), str(tmp_path / "store")
    spark.range(5).selectExpr(
        "id AS request_seq", "'A' AS first_name", "'B' AS last_name",
        "concat(id, '@b.c') AS email", "'1' AS phone", "'X' AS city",
    ).write.parquet(batch)
    spark.range(300_000).selectExpr("concat(id, '@old.c') AS email").write.parquet(store)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    # Else a plan cuts long paths short.
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        judged = intake.validate_customers(spark.read.parquet(batch), spark.read.parquet(store))
        text = plan(judged)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    above = text[: text.index(store)].split("\n")[::-1]
    # From the scan of the stored table upwards the first join comes before any exchange.
    upward = [x for x in above if "Exchange" in x or "Join" in x]
    assert "BroadcastHashJoin" in upward[0] and "LeftSemi" in upward[0]


def test_order_level_step_reuses_the_partitioning_of_the_order_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(contract.queries()["revenue_summary"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One shuffle per side of the join, one for the single result row.
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Exchange SinglePartition") == 1


def test_top_products_sorts_no_more_than_it_shows(spark):
    assert "TakeOrderedAndProject" in plan(contract.queries()["top_products"](spark, SMALL))


def test_few_repeated_products_leave_the_lines_in_place(spark, tmp_path):
    """The pairs are summed up beforehand, so the lines meet a table of known, small size."""
    rows = spark.range(2000).selectExpr(
        "id div 4 AS request_seq", "id AS pos", "IF(id = 7, 6, id) AS product_id"
    )
    rows.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    found = intake.duplicate_lines(lines)
    assert "Aggregate" not in plan(found) and "BroadcastHashJoin" in plan(found)
    assert [(r.pos, r.first_pos) for r in found.collect()] == [(7, 6)]


def test_rows_are_counted_once_for_all_readers_of_positions(spark):
    placed = ranking.with_position(spark.range(100), [F.desc("id")], "place")
    assert "Aggregate" not in plan(placed) and "Window" not in plan(placed)
    assert placed.where("place + id <> 100").count() == 0
