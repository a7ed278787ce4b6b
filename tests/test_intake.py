"""Batch intake against the rules, and against a one-by-one intake in plain Python."""

from __future__ import annotations

import random
import re
from datetime import datetime
from decimal import Decimal

import pytest

from retail_engine.operators import intake
from retail_engine.schemas import ORDER_REQUEST

CUSTOMER = (
    "request_seq bigint, first_name string, last_name string, email string, phone string, "
    "city string"
)
PRODUCT = "request_seq bigint, name string, sku string, category string, price string"


def customers(spark, rows, existing=()):
    batch = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], CUSTOMER)
    known = spark.createDataFrame([(e,) for e in existing], "email string")
    judged = intake.validate_customers(batch, known)
    return [(r.reason, r.reasons) for r in judged.orderBy("request_seq").collect()]


def reasons(found):
    return [reason for reason, _ in found]


def test_customer_rules_in_order(spark):
    found = customers(
        spark,
        [
            (None, None, "bad", None, ""),
            ("A", " ", "a@b.c", None, "Pune"),
            ("A", "B", "\t", None, "Pune"),
            ("A", "B", " a@b.c", None, "Pune"),
            ("A", "B", "a@b.c\n", None, "Pune"),
            ("A", "B", "a@b.c", None, " "),
            ("A", "B", "old@b.c", None, "Pune"),
            ("A" * 101, "B", "long@b.c", None, "Pune"),
            ("A", "B", "ok@b.c", "1" * 51, "Pune"),
            ("A", "B", "ok@b.c", "  ", "Pune"),
        ],
        existing=["old@b.c"],
    )
    assert reasons(found) == [
        "first_name_required", "last_name_required", "email_required", "email_invalid",
        "email_invalid", "city_required", "email_taken", "too_long", "too_long", None,
    ]
    assert found[0][1] == [
        "first_name_required", "last_name_required", "email_invalid", "city_required",
    ]


def test_first_valid_request_keeps_the_email(spark):
    found = customers(
        spark,
        [
            ("A", "B", "x@y.z", None, ""),
            ("A" * 200, "B", "x@y.z", None, "Pune"),
            ("A", "B", "x@y.z", None, "Pune"),
            ("A", "B", "x@y.z", None, "Pune"),
            ("A" * 200, "B", "x@y.z", None, "Pune"),
        ],
    )
    assert reasons(found) == ["city_required", "too_long", None, "email_taken", "email_taken"]


def test_messages_carry_the_value(spark):
    batch = spark.createDataFrame([(1, "A", "B", "x@y.z", None, "Pune")], CUSTOMER)
    known = spark.createDataFrame([("x@y.z",)], "email string")
    row = intake.rejected(intake.validate_customers(batch, known)).first()
    assert row.message == "A customer with email 'x@y.z' already exists."


def test_clean_customers(spark):
    rows = [(1, "\tAsha ", "Rao ", "a@b.c", "", " Pune"), (2, "A", "B", "b@b.c", " ", "X")]
    found = intake.clean_customers(spark.createDataFrame(rows, CUSTOMER)).orderBy("request_seq")
    assert [tuple(r) for r in found.collect()] == [
        (1, "Asha", "Rao", "a@b.c", None, "Pune"),
        (2, "A", "B", "b@b.c", "", "X"),
    ]


def test_product_rules(spark):
    rows = [
        (1, " ", "s1", "c", "1"),
        (2, "n", None, "c", "1"),
        (3, "n", "s3", "", "1"),
        (4, "n", "s4", "c", None),
        (5, "n", "s5", "c", "-1"),
        (6, "n", "s6", "c", "abc"),
        (7, "n", "s7", "c", "0"),
        (8, "n", "s8", "c", "1.005"),
        (9, "n", "s9", "c", "123456789"),
        (10, "n", " s7 ", "c", "1"),
        (11, "n" * 256, "s11", "c", "1"),
        (12, "n", "old", "c", "1"),
        (13, "n", "s9", "c", "5"),
        (14, "n", "s14", "c", "-0.00000000001"),
        (15, "n", "s15", "c", "1e30"),
        (16, "n", "s16", "c", "-1e30"),
        (17, "n", "s17", "c", "-0.0"),
        (18, "n", "s18", "c", "0.00000000001"),
    ]
    judged = intake.validate_products(
        spark.createDataFrame(rows, PRODUCT), spark.createDataFrame([("old",)], "sku string")
    )
    found = {r.request_seq: r.reason for r in judged.collect()}
    assert found == {
        1: "name_required", 2: "sku_required", 3: "category_required", 4: "price_required",
        5: "price_invalid", 6: "price_invalid", 7: None, 8: None, 9: "out_of_range",
        10: "sku_taken", 11: "too_long", 12: "sku_taken", 13: None, 14: "price_invalid",
        15: "out_of_range", 16: "price_invalid", 17: None, 18: None,
    }
    prices = {r.request_seq: r.price for r in intake.clean_products(intake.accepted(judged)).collect()}
    assert prices == {
        7: Decimal("0.00"), 8: Decimal("1.01"), 13: Decimal("5.00"), 17: Decimal("0.00"),
        18: Decimal("0.00"),
    }


def orders(spark, requests):
    batch = spark.createDataFrame(requests, ORDER_REQUEST)
    headers, lines = intake.split_requests(batch)
    known = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    catalogue = spark.createDataFrame(
        [(1, Decimal("10.00")), (2, Decimal("2.50")), (3, Decimal("0.00"))],
        "product_id bigint, price decimal(10,2)",
    )
    priced = intake.priced_lines(lines, catalogue)
    return intake.validate_orders(headers, priced, known), priced


def judged_orders(spark, requests):
    judged, _ = orders(spark, requests)
    return {r.request_seq: r for r in judged.collect()}


def test_order_rules(spark):
    good = [(1, "1")]
    found = judged_orders(
        spark,
        [
            (1, 1, None, "Pending", []),
            (2, 1, None, "Pending", None),
            (3, 1, None, "Pending", [(0, "1"), (1, "1"), (1, "1")]),
            (4, 1, None, "Pending", [(1, "1"), (1, "1"), (None, "1")]),
            (5, 1, None, "Shipped", good),
            (6, 1, None, "", good),
            (7, 1, "soon", "Pending", good),
            (8, 1, "", "Pending", good),
            (9, 99, None, "Pending", [(77, "1")]),
            (10, None, None, "Pending", good),
            (11, 1, None, "Pending", [(1, "1"), (77, "1")]),
            (12, 1, None, "Pending", [(1, "0"), (77, "1")]),
            (13, 1, None, "Pending", [(77, "x")]),
            (14, 1, None, "Pending", [(1, "3.0"), (2, "2")]),
            (15, 1, None, "Pending", [(1, "3abc")]),
            (16, 1, None, "Pending", [(1, "1e2")]),
            (17, 1, None, "Pending", [(1, "-1")]),
            (18, 1, None, "Pending", [(1, "99999999")]),
            (19, 1, None, None, [(3, "3000000000")]),
            (20, 2, "2024-02-25T10:00:00Z", "Refunded", good),
        ],
    )
    assert {k: r.reason for k, r in found.items()} == {
        1: "items_required", 2: "items_required", 3: "product_required", 4: "product_repeated",
        5: "status_invalid", 6: None, 7: "date_invalid", 8: None, 9: "customer_unknown",
        10: "customer_unknown", 11: "product_unknown", 12: "quantity_invalid",
        13: "product_unknown", 14: None, 15: "quantity_invalid", 16: "quantity_invalid",
        17: "quantity_invalid", 18: "out_of_range", 19: "out_of_range", 20: None,
    }
    assert (found[6].status, found[14].total_amount) == ("Pending", Decimal("35.00"))
    assert found[20].order_date == datetime(2024, 2, 25, 10)
    assert found[4].message == "Duplicate product_id 1 in single order is rejected."
    assert found[9].message == "Customer with ID 99 does not exist."
    assert found[11].message == "Product with ID 77 does not exist in the database."
    assert found[12].message == "Quantity for product ID 1 must be an integer greater than 0."
    assert found[12].reasons == ["quantity_invalid", "product_unknown"]


def test_one_bad_line_rejects_the_order(spark):
    judged, priced = orders(
        spark,
        [(1, 1, None, None, [(1, "1"), (2, "0")]), (2, 1, "2024-01-01", None, [(1, "2"), (2, "2")])],
    )
    good = intake.accepted_orders(judged, "2030-01-01 00:00:00").collect()
    assert [(r.request_seq, r.total_amount, r.item_count) for r in good] == [(2, Decimal("25.00"), 2)]
    kept = intake.accepted_lines(judged, priced).orderBy("pos").collect()
    assert [(r.request_seq, r.product_id, r.subtotal) for r in kept] == [
        (2, 1, Decimal("20.00")), (2, 2, Decimal("5.00")),
    ]


def test_undated_order_is_dated_as_of(spark):
    judged, _ = orders(spark, [(1, 1, None, None, [(1, "1")])])
    row = intake.accepted_orders(judged, "2030-01-01 00:00:00").first()
    assert row.order_date == datetime(2030, 1, 1)


def test_quote_counts_unknown_products_as_free(spark):
    lines = spark.createDataFrame(
        [(1, 1, 3), (1, 9, 5), (2, 9, 1)], "request_seq bigint, product_id bigint, quantity bigint"
    )
    catalogue = spark.createDataFrame(
        [(1, Decimal("1.50"))], "product_id bigint, price decimal(10,2)"
    )
    found = {tuple(r) for r in intake.order_quote(lines, catalogue).collect()}
    assert found == {(1, Decimal("4.50")), (2, Decimal("0.00"))}


def one_by_one_customers(rows, existing):
    taken, out = set(existing), []
    for first, last, email, _, city in rows:
        for value, code in ((first, "first_name"), (last, "last_name"), (email, "email")):
            if value is None or not value.strip():
                out.append(f"{code}_required")
                break
        else:
            if not re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", email):
                out.append("email_invalid")
            elif city is None or not city.strip():
                out.append("city_required")
            elif email in taken:
                out.append("email_taken")
            elif len(first) > 100:
                out.append("too_long")
            else:
                taken.add(email)
                out.append(None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_customers_like_one_by_one(spark, seed):
    """A third of the batch shares one email."""
    rng = random.Random(seed)
    rows = [
        (
            rng.choice(["A", "A", "A", "", None, "N" * 120]),
            rng.choice(["B", "B", "B", " "]),
            "hot@x.y" if rng.random() < 0.33 else f"u{rng.randrange(60)}{rng.choice(['@x.y', ''])}",
            None,
            rng.choice(["Pune", "Pune", "", None]),
        )
        for _ in range(400)
    ]
    existing = [f"u{i}@x.y" for i in range(0, 60, 7)]
    assert reasons(customers(spark, rows, existing)) == one_by_one_customers(rows, existing)


def one_by_one_order(customer, status, items):
    if not items:
        return "items_required"
    seen = set()
    for product, _ in items:
        if not product:
            return "product_required"
        if product in seen:
            return "product_repeated"
        seen.add(product)
    if (status or "Pending") not in intake.STATUSES:
        return "status_invalid"
    if customer not in (1, 2):
        return "customer_unknown"
    for product, quantity in items:
        if product not in (1, 2, 3):
            return "product_unknown"
        if not quantity.isdigit() or int(quantity) <= 0:
            return "quantity_invalid"
    return None


def test_orders_like_one_by_one(spark):
    """One order holds a third of all lines."""
    rng = random.Random(11)
    requests = []
    for i in range(300):
        size = 400 if i == 7 else rng.randrange(5)
        items = [
            (rng.choice([1, 2, 3, 3, 4, 0, None]) if i != 7 else 1, rng.choice(["1", "2", "0", "x"]))
            for _ in range(size)
        ]
        requests.append(
            (i, rng.choice([1, 2, 2, 3]), None, rng.choice(["Pending", "", None, "Lost"]), items)
        )
    found = judged_orders(spark, requests)
    for seq, customer, _, status, items in requests:
        assert found[seq].reason == one_by_one_order(customer, status, items), seq


def test_duplicate_lines(spark):
    lines = spark.createDataFrame(
        [(1, p, 5, "1") for p in range(50)] + [(1, 60, 6, "1"), (2, 1, 5, "1"), (2, 2, 0, "1"),
                                               (2, 3, 0, "1")],
        "request_seq bigint, pos bigint, product_id bigint, quantity string",
    )
    found = intake.duplicate_lines(lines).collect()
    assert sorted((r.request_seq, r.pos, r.first_pos) for r in found) == [
        (1, p, 0) for p in range(1, 50)
    ]
