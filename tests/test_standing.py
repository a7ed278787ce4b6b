"""Standing reports: states of batches that merge to the reports over all sales."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retail_engine.jobs import standing
from retail_engine.operators import increments, reports
from retail_engine.schemas import WAREHOUSE, conform
from retail_engine.sources import commits

AT = datetime(2024, 2, 25, 12)


@pytest.fixture(scope="module")
def dims(spark):
    buyers = spark.createDataFrame(
        [(c, f"n{c}", None if c == 3 else f"city{c % 2}", None) for c in range(5)],
        WAREHOUSE["dim_customer"],
    )
    goods = spark.createDataFrame(
        [(p, f"p{p % 4}", "c", Decimal("1.00")) for p in range(6)], WAREHOUSE["dim_product"]
    )
    return buyers, goods


def sales(spark, first, last):
    """Lines of which three make an order, cents in their amounts, ids over several bitmaps."""
    rows = spark.range(first, last).selectExpr(
        "id AS sale_id",
        "id div 3 * 9973 + 1 AS order_id",
        "id div 3 % 7 AS customer_id",
        "id % 7 AS product_id",
        "id % 5 + 1 AS quantity",
        "(id % 100) / 100 + 10000000000000 AS revenue",
        "IF(id % 11 = 0, NULL, timestamp_seconds(id * 4000)) AS sale_date",
    )
    return conform(rows, WAREHOUSE["fact_sales"])


def reports_of(states, goods):
    return [
        increments.revenue_summary(states),
        increments.sales_by_product(states, goods),
        increments.sales_by_city(states),
        increments.daily_sales(states),
    ]


def full(fact, buyers, goods):
    return [
        reports.revenue_summary(fact),
        reports.sales_by_product(fact, goods),
        reports.sales_by_city(fact, buyers),
        reports.daily_sales(fact),
    ]


def rows(found):
    return [sorted(df.select(*sorted(df.columns)).collect(), key=str) for df in found]


def test_three_batches_give_the_reports_over_all_sales(spark, tmp_path, dims):
    buyers, goods = dims
    root, fact = str(tmp_path), sales(spark, 0, 700)
    # Batches end amid an order, and the last one comes back to orders of the first.
    parts = [sales(spark, 0, 200), sales(spark, 200, 601), sales(spark, 601, 700)]
    for n, part in enumerate(parts):
        standing.add_sales(spark, root, f"b{n}", part, buyers, AT)
    want = rows(full(fact, buyers, goods))
    assert rows(reports_of(standing.states(spark, root), goods)) == want
    assert standing.fold(spark, root, AT).number == 4
    states = standing.states(spark, root)
    assert rows(reports_of(states, goods)) == want
    assert all(len(s.inputFiles()) < 10 for s in states.values())
    # One more order is one more batch, and reads no sales but its own.
    standing.add_sales(spark, root, "b3", sales(spark, 699, 703), buyers, AT)
    more = sales(spark, 0, 700).unionAll(sales(spark, 699, 703))
    assert rows(reports_of(standing.states(spark, root), goods)) == rows(full(more, buyers, goods))


def test_reports_read_states_alone(spark, tmp_path, dims):
    buyers, goods = dims
    root = str(tmp_path)
    sales(spark, 0, 100).write.parquet(f"{root}/fact")
    fact = spark.read.schema(WAREHOUSE["fact_sales"]).parquet(f"{root}/fact")
    standing.add_sales(spark, root, "b1", fact, buyers, AT)
    for report in reports_of(standing.states(spark, root), goods):
        files = report.inputFiles()
        assert files and all("/reports/states/" in f for f in files)


def test_a_batch_counts_once(spark, tmp_path, dims):
    root = str(tmp_path)
    standing.add_sales(spark, root, "b1", sales(spark, 0, 10), dims[0], AT)
    with pytest.raises(ValueError, match="already"):
        standing.add_sales(spark, root, "b1", sales(spark, 0, 10), dims[0], AT)
    assert commits.read(spark, f"{root}/reports").number == 1


def test_many_batches_are_folded(spark, tmp_path, dims, monkeypatch):
    monkeypatch.setattr(standing, "FOLD_EVERY", 2)
    root = str(tmp_path)
    for n in range(3):
        state = standing.add_sales(spark, root, f"b{n}", sales(spark, 9 * n, 9 * n + 9), dims[0], AT)
    assert len({f.path.split("/")[1] for f in state.files.values()}) == 1
    found = increments.revenue_summary(standing.states(spark, root)).first()
    assert found == reports.revenue_summary(sales(spark, 0, 27)).first()


def test_no_sales(spark, tmp_path, dims):
    states = standing.states(spark, str(tmp_path))
    assert increments.revenue_summary(states).first().totalOrders == 0
    assert [r.count() for r in reports_of(states, dims[1])[1:]] == [0, 0, 0]


def test_states_of_a_day_without_a_date(spark, dims):
    state = increments.states(sales(spark, 0, 12), dims[0])["day_states"]
    assert {r.day for r in state.where(F.col("day").isNull()).collect()} == {None}
    assert date(1970, 1, 1) in {r.day for r in state.collect()}


def test_states_are_no_wider_for_orders_far_apart(spark, dims):
    """A day or city with one order in many bitmaps has small rows, summed where they hash."""
    made = increments.states(sales(spark, 0, 300), dims[0])
    for name in ("day_states", "city_states"):
        assert made[name].schema["orders"].dataType.typeName() == "long"
        plan = made[name]._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_any_order_id_counts_once(spark, dims):
    ids = [0, 1, 62, 63, 64, 127, 128, -1, -64, -65, 2**40, 2**63 - 1, -(2**63), None]
    fact = spark.createDataFrame(
        [(n, i, 1, 1, 1, Decimal("1.00"), AT) for n, i in enumerate(ids * 3)],
        WAREHOUSE["fact_sales"],
    )
    halves = [fact.where(f"sale_id % 2 = {n}") for n in range(2)]
    both = [increments.states(half, dims[0])["day_states"] for half in halves]
    merged = increments.merged(both, "day_states")
    found = increments.daily_sales({"day_states": merged}).first()
    assert (found.totalOrders, found.totalRevenue) == (13, 42.0)
    none = increments.states(fact.where("order_id IS NULL"), dims[0])
    assert increments.daily_sales(none).first().totalOrders == 0
