from __future__ import annotations

import pytest

from retail_engine.operators import audit, reports, star
from retail_engine.plans import catalogue
from retail_engine.sources import buckets
from retail_engine.sources import driver_tables as tables

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_by_order_move_no_rows(spark, no_broadcast):
    stored = catalogue._bucketed(spark, SMALL)
    orders, items = stored["orders"], stored["order_items"]
    people = tables.customers(spark, SMALL)
    built = {
        "fact_sales": star.fact_sales(items, orders),
        "order_totals": reports.order_totals(orders, items),
        "total_audit": audit.total_audit(orders, items),
        "orders_list": reports.orders_list(orders, people, items),
    }
    for name, df in built.items():
        text = plan(df)
        assert "SortMergeJoin" in text and "hashpartitioning(order_id" not in text, name
    for name in ("fact_sales", "order_totals", "total_audit"):
        assert "Exchange" not in plan(built[name]).split("SortMergeJoin", 1)[1], name
    plain = tables.orders(spark, SMALL), tables.order_items(spark, SMALL)
    want = reports.orders_list(plain[0], people, plain[1]).collect()
    assert sorted(built["orders_list"].collect()) == sorted(want)
    want = audit.total_audit(*plain).collect()
    assert sorted(built["total_audit"].collect()) == sorted(want)


def test_another_session_knows_the_buckets_by_their_path(spark, tmp_path, no_broadcast):
    path, rows = str(tmp_path / "t"), spark.range(1000).selectExpr("id AS k", "id % 7 AS v")
    buckets.write(rows, path, "k", 4)
    spark.sql(f"DROP TABLE {buckets._name(path)}")
    found = buckets.read(spark, path, rows.schema, "k", 4)
    assert "Exchange" not in plan(found.groupBy("k").count())
    assert sorted(found.collect()) == sorted(rows.collect())


def test_a_hot_bucket_makes_plain_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "_SMALL", 0)
    path = str(tmp_path / "t")
    rows = spark.range(60_000).selectExpr("IF(id < 50000, 1L, id) AS k", "uuid() AS v")
    buckets.write(rows, path, "k", 8)
    found = buckets.read(spark, path, rows.schema, "k", 8)
    assert "Exchange" in plan(found.groupBy("k").count()) and found.count() == 60_000


def test_empty_tables_have_buckets_too(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(0).selectExpr("id AS k")
    buckets.write(rows, path, "k", 4)
    assert buckets.read(spark, path, rows.schema, "k", 4).count() == 0
