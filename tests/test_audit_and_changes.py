from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from test_star_and_reports import table

from retail_engine.operators import audit, changes, star

D = Decimal


def shop(spark, **rows):
    names = ("customers", "products", "orders", "order_items")
    return {name: table(spark, name, rows.get(name, [])) for name in names}


def sample(spark):
    return shop(
        spark,
        customers=[
            dict(customer_id=1, first_name="A", last_name="B", email="a@b.c", city="Pune"),
            dict(customer_id=2, first_name="A", email="a@b.c", city="Surat"),
        ],
        products=[
            dict(product_id=1, name="Kettle", sku="k", category="Home", price=D("-1.00")),
            dict(product_id=1, name="Kettle", sku="l", category="Home", price=D("1.00")),
        ],
        orders=[
            dict(order_id=1, customer_id=1, status="Pending", total_amount=D("5.00")),
            dict(order_id=2, customer_id=9, status="Lost", total_amount=D("0.00")),
        ],
        order_items=[
            dict(order_item_id=1, order_id=1, product_id=1, quantity=2, unit_price=D("2.50"),
                 subtotal=D("5.00")),
            dict(order_item_id=2, order_id=7, product_id=8, quantity=0, unit_price=D("1.00"),
                 subtotal=D("3.00")),
            dict(order_item_id=3, order_id=7, product_id=8, quantity=1, unit_price=D("1.00"),
                 subtotal=D("1.00")),
        ],
    )


def test_foreign_keys(spark):
    tables = sample(spark)
    found = {tuple(r) for r in audit.fk_audit(tables).collect()}
    assert found == {
        ("orders.customer_id", 2, 1),
        ("order_items.order_id", 3, 2),
        ("order_items.product_id", 3, 2),
    }
    lost = audit.orphans(tables["order_items"], tables["orders"], "order_id").collect()
    assert sorted(r.order_item_id for r in lost) == [2, 3]


def test_constraints(spark):
    found = audit.constraint_audit(sample(spark)).filter("violations > 0").collect()
    assert {(r.table_name, r.rule, r.violations) for r in found} == {
        ("customers", "last_name IS NOT NULL", 1),
        ("customers", "email UNIQUE", 1),
        ("products", "price >= 0", 1),
        ("products", "product_id UNIQUE", 1),
        (
            "orders",
            "status IN ('Pending', 'Processing', 'Completed', 'Cancelled', 'Refunded')",
            1,
        ),
        ("order_items", "quantity > 0", 1),
    }


def test_totals(spark):
    tables = sample(spark)
    found = audit.total_audit(tables["orders"], tables["order_items"]).collect()
    assert found == []
    wrong = shop(
        spark,
        orders=[dict(order_id=7, total_amount=D("4.00")), dict(order_id=1, total_amount=D("6.00"))],
        order_items=[r.asDict() for r in tables["order_items"].collect()],
    )
    found = audit.total_audit(wrong["orders"], wrong["order_items"]).collect()
    assert {(r.order_id, r.items_total, r.bad_lines) for r in found} == {
        (7, D("4.00"), 1), (1, D("5.00"), 0),
    }


def test_reconciliation_reports_lost_items(spark):
    tables = sample(spark)
    fact = star.fact_sales(tables["order_items"], tables["orders"])
    found = {r.metric: tuple(r)[1:] for r in audit.reconcile_totals(tables["order_items"], fact).collect()}
    assert found == {
        "revenue": (D("6.00"), D("5.00"), False),
        "orders": (D("2.00"), D("1.00"), False),
        "quantity": (D("3.00"), D("2.00"), False),
    }


def test_reconciliation_of_nothing_matches(spark):
    tables = shop(spark)
    fact = star.fact_sales(tables["order_items"], tables["orders"])
    assert all(r.matches for r in audit.reconcile_totals(tables["order_items"], fact).collect())


def test_drift(spark):
    before = {"a": spark.range(3), "gone": spark.range(2)}
    after = {"a": spark.range(5), "new": spark.range(1)}
    assert {tuple(r) for r in audit.count_drift(before, after).collect()} == {
        ("a", 3, 5, 2), ("gone", 2, None, -2), ("new", None, 1, 1),
    }


def test_status_audit(spark):
    orders = table(spark, "orders", [dict(status=s) for s in ("Pending", "Lost", None, "Pending")])
    assert {tuple(r) for r in audit.status_audit(orders).collect()} == {
        ("Pending", 2, True), ("Lost", 1, False), (None, 1, False),
    }


def test_deletes(spark):
    tables = sample(spark)
    gone = spark.createDataFrame([(1,)], "order_id bigint")
    orders, items = changes.cascade_delete(tables["orders"], tables["order_items"], gone)
    assert [r.order_id for r in orders.collect()] == [2]
    assert sorted(r.order_item_id for r in items.collect()) == [2, 3]
    blocked = changes.restrict_delete(
        spark.createDataFrame([(1,), (2,)], "customer_id bigint"), tables["orders"], "customer_id"
    )
    assert [r.customer_id for r in blocked.collect()] == [1]


def test_upsert_stamps_every_matched_row(spark):
    made = datetime(2024, 1, 1)
    old = table(
        spark,
        "products",
        [
            dict(product_id=i, name=f"p{i}", sku=f"s{i}", category="c", price=D("1.00"),
                 created_at=made, updated_at=made)
            for i in (1, 2, 3)
        ],
    )
    new = table(
        spark,
        "products",
        [
            dict(product_id=1, name="p1", sku="s1", category="c", price=D("1.00")),
            dict(product_id=2, name=None, sku="s2", category="c", price=D("9.00")),
            dict(product_id=4, name="p4", sku="s4", category="c", price=D("4.00")),
        ],
    )
    now = datetime(2025, 5, 5)
    found = changes.upsert(old, new, "product_id", "2025-05-05 00:00:00").collect()
    assert {(r.product_id, r.name, r.price, r.created_at, r.updated_at) for r in found} == {
        (1, "p1", D("1.00"), made, now),
        (2, None, D("9.00"), made, now),
        (3, "p3", D("1.00"), made, made),
        (4, "p4", D("4.00"), now, now),
    }
