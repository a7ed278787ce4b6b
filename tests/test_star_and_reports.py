from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest

from retail_engine.operators import reports, star
from retail_engine.operators.intake import STATUSES
from retail_engine.schemas import OPERATIONAL, WAREHOUSE

D = Decimal


def table(spark, name, rows):
    """Rows given by column; all others are NULL."""
    schema = OPERATIONAL.get(name) or WAREHOUSE[name]
    return spark.createDataFrame(
        [tuple(row.get(f.name) for f in schema.fields) for row in rows], schema
    )


def sale(order, product=1, customer=1, quantity=1, revenue="1.00", at=datetime(2024, 1, 1)):
    return dict(
        sale_id=order * 100 + product,
        order_id=order,
        customer_id=customer,
        product_id=product,
        quantity=quantity,
        revenue=D(revenue),
        sale_date=at,
    )


def test_name_is_null_when_a_part_is(spark):
    people = table(
        spark,
        "customers",
        [
            dict(customer_id=1, first_name="Asha", last_name="Rao"),
            dict(customer_id=2, first_name="Asha"),
        ],
    )
    names = {r.customer_id: r.name for r in star.dim_customer(people).collect()}
    assert names == {1: "Asha Rao", 2: None}


def test_fact_keeps_every_status_and_drops_orphans(spark):
    orders = [
        dict(order_id=i, customer_id=7, status=s, order_date=datetime(2024, 1, i))
        for i, s in enumerate(STATUSES, 1)
    ]
    items = [
        dict(order_item_id=i, order_id=i, product_id=1, quantity=3, unit_price=D("2.50"),
             subtotal=D("99.99"))
        for i in range(1, 7)
    ]
    fact = star.fact_sales(table(spark, "order_items", items), table(spark, "orders", orders))
    rows = fact.collect()
    assert sorted(r.order_id for r in rows) == [1, 2, 3, 4, 5]
    assert {r.revenue for r in rows} == {D("7.50")}
    assert {r.customer_id for r in rows} == {7}


def test_net_revenue_leaves_out_cancelled_and_refunded(spark):
    orders = table(
        spark, "orders", [dict(order_id=i, status=s) for i, s in enumerate(STATUSES, 1)]
    )
    fact = table(spark, "fact_sales", [sale(i, revenue=f"{i}.00") for i in range(1, 6)])
    row = reports.net_revenue(fact, orders).first()
    assert (row.totalRevenue, row.totalOrders) == (6.0, 3)


def test_empty_fact(spark):
    fact = table(spark, "fact_sales", [])
    assert tuple(reports.revenue_summary(fact).first()) == (None, None, 0, None)
    assert reports.daily_sales(fact).count() == 0
    products = table(spark, "dim_product", [])
    assert reports.sales_by_product(fact, products).count() == 0
    assert reports.product_ranking(reports.sales_by_product(fact, products)).count() == 0


def test_summary_is_exact_where_doubles_drift(spark):
    fact = table(spark, "fact_sales", [sale(i, revenue="0.10") for i in range(1, 31)])
    row = reports.revenue_summary(fact).first()
    assert (row.totalRevenue, row.averageOrderValue) == (3.0, 0.1)


def test_units_beyond_int(spark):
    fact = table(spark, "fact_sales", [sale(i, quantity=2_000_000_000) for i in (1, 2)])
    assert reports.revenue_summary(fact).first().totalUnitsSold == 4_000_000_000


def test_products_of_one_name_and_category_are_one_row(spark):
    products = table(
        spark,
        "dim_product",
        [
            dict(product_id=1, name="Kettle", category="Home"),
            dict(product_id=2, name="Kettle", category="Home"),
            dict(product_id=3, name="Kettle", category="Camping"),
        ],
    )
    fact = table(
        spark,
        "fact_sales",
        [sale(1, 1, quantity=2, revenue="5.00"), sale(1, 2, revenue="7.00"), sale(2, 3), sale(3, 9)],
    )
    rows = {tuple(r) for r in reports.sales_by_product(fact, products).collect()}
    assert rows == {("Kettle", "Home", 3, 12.0), ("Kettle", "Camping", 1, 1.0)}


def test_city_counts_an_order_once_and_skips_unknown_customers(spark):
    people = table(
        spark,
        "dim_customer",
        [dict(customer_id=1, city="Pune"), dict(customer_id=2, city="Pune"),
         dict(customer_id=3, city="Surat")],
    )
    fact = table(
        spark,
        "fact_sales",
        [sale(1, 1, 1), sale(1, 2, 1), sale(2, 1, 2), sale(3, 1, 3, 4, "9.00"), sale(4, 1, 99)],
    )
    found = reports.sales_by_city(fact, people)
    assert {tuple(r) for r in found.collect()} == {("Pune", 2, 3, 3.0), ("Surat", 1, 4, 9.0)}


def test_city_counts_an_order_of_two_customers_once(spark):
    people = table(
        spark, "dim_customer", [dict(customer_id=1, city="Pune"), dict(customer_id=2, city="Pune")]
    )
    fact = table(spark, "fact_sales", [sale(1, 1, 1), sale(1, 2, 2)])
    assert tuple(reports.sales_by_city(fact, people).first()) == ("Pune", 1, 2, 2.0)


def test_days_break_at_midnight_utc(spark):
    times = [datetime(2024, 3, 1, 23, 30), datetime(2024, 3, 2), datetime(2024, 3, 2, 0, 30), None]
    rows = [sale(i, at=t) for i, t in enumerate(times, 1)]
    found = reports.by_day(reports.daily_sales(table(spark, "fact_sales", rows))).collect()
    assert [tuple(r) for r in found] == [
        (date(2024, 3, 1), 1, 1.0),
        (date(2024, 3, 2), 2, 2.0),
        (None, 1, 1.0),
    ]


def test_ties_rank_by_name(spark):
    rows = [("B", "x", 1, 5.0), ("A", "y", 1, 5.0), ("A", "x", 1, 5.0), ("C", "x", 1, 9.0),
            ("D", "x", 1, 1.0)]
    report = spark.createDataFrame(
        rows, "productName string, category string, totalUnits bigint, totalRevenue double"
    )
    ranked = reports.product_ranking(report).orderBy("rank").collect()
    assert [(r.productName, r.category, r["rank"], r.badge) for r in ranked] == [
        ("C", "x", 1, "1"),
        ("A", "x", 2, "2"),
        ("A", "y", 3, "3"),
        ("B", "x", 4, "default"),
        ("D", "x", 5, "default"),
    ]
    top = reports.top_products(report, 2).collect()
    assert [(r.productName, r.category) for r in top] == [("C", "x"), ("A", "x")]


def test_order_list_keeps_empty_orders_and_puts_undated_first(spark):
    orders = table(
        spark,
        "orders",
        [
            dict(order_id=1, customer_id=1, order_date=datetime(2024, 1, 1), status="Pending",
                 total_amount=D("0")),
            dict(order_id=2, customer_id=1, order_date=datetime(2024, 1, 1), status="Pending",
                 total_amount=D("0")),
            dict(order_id=3, customer_id=1, status="Pending", total_amount=D("0")),
            dict(order_id=4, customer_id=99, status="Pending", total_amount=D("0")),
        ],
    )
    people = table(
        spark, "customers",
        [dict(customer_id=1, first_name="A", last_name="B", email="a@b.c", city="Pune")],
    )
    items = table(
        spark, "order_items",
        [dict(order_item_id=1, order_id=1), dict(order_item_id=2, order_id=1)],
    )
    found = reports.orders_list(orders, people, items).collect()
    assert [(r.order_id, r.item_count) for r in found] == [(3, 0), (2, 0), (1, 2)]


def test_order_totals_are_zero_without_items(spark):
    orders = table(spark, "orders", [dict(order_id=1), dict(order_id=2)])
    items = table(
        spark, "order_items",
        [dict(order_item_id=i, order_id=1, subtotal=D("1.10")) for i in (1, 2)],
    )
    found = {tuple(r) for r in reports.order_totals(orders, items).collect()}
    assert found == {(1, D("2.20")), (2, D("0.00"))}


@pytest.mark.parametrize("report", ["product", "city", "day"])
def test_parts_add_up(spark, report):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.001"
    total = contract.queries()["revenue_summary"](spark, folder).first().totalRevenue
    name = {"product": "sales_by_product", "city": "sales_by_city", "day": "daily_sales"}[report]
    parts = contract.queries()[name](spark, folder).collect()
    assert round(sum(r.totalRevenue for r in parts), 2) == total
