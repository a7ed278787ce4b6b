"""Intake of customers, products and orders in batches.

Each function takes a batch of requests and returns it with three more columns: `reason`,
the first rule a request breaks in the order a one-by-one intake would check them (NULL
when accepted), `message`, the text for the client, and `reasons`, all broken rules. A bad
request never fails the job.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_engine.functions import text
from retail_engine.session import checkpointed

# Order statuses, the default one, and column limits of the operational tables.
STATUSES = ("Pending", "Processing", "Completed", "Cancelled", "Refunded")
DEFAULT_STATUS = "Pending"
CUSTOMER_LENGTHS = {"first_name": 100, "last_name": 100, "email": 255, "phone": 50, "city": 100}
PRODUCT_LENGTHS = {"name": 255, "sku": 100, "category": 100}
PRICE_TYPE = "decimal(10,2)"
LARGEST_AMOUNT = "99999999.99"
LARGEST_INT = 2_147_483_647

# Messages by rule. `{}` takes the value at fault.
MESSAGES = {
    "first_name_required": "First name is required.",
    "last_name_required": "Last name is required.",
    "email_required": "Email is required.",
    "email_invalid": "Invalid email address format.",
    "city_required": "City is required.",
    "email_taken": "A customer with email '{}' already exists.",
    "name_required": "Product name is required.",
    "sku_required": "Product SKU is required.",
    "category_required": "Product category is required.",
    "price_required": "Price is required.",
    "price_invalid": "Price must be a number greater than or equal to 0.",
    "sku_taken": "A product with SKU '{}' already exists.",
    "items_required": "Order items list is required and cannot be empty.",
    "product_required": "Each order item must specify a product_id.",
    "product_repeated": "Duplicate product_id {} in single order is rejected.",
    "status_invalid": "Invalid status: {}. Status must be one of: "
    "Pending, Processing, Completed, Cancelled, Refunded",
    "date_invalid": "Invalid order_date timestamp format.",
    "customer_unknown": "Customer with ID {} does not exist.",
    "product_unknown": "Product with ID {} does not exist in the database.",
    "quantity_invalid": "Quantity for product ID {} must be an integer greater than 0.",
    "too_long": "A text is longer than its column allows.",
    "out_of_range": "A number is larger than its column allows.",
}

# Columns a judgement adds.
RULING = ("reason", "message", "reasons")

_ALREADY_THERE = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    """`broken` is true for a request at fault; NULL counts as kept."""

    code: str
    broken: Column
    value: Column | None = None

    def message(self) -> Column:
        before, _, after = MESSAGES[self.code].partition("{}")
        if self.value is None:
            return F.lit(before)
        shown = F.coalesce(self.value.cast("string"), F.lit("null"))
        return F.concat(F.lit(before), shown, F.lit(after))


def _marked(requests: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[Rule]]:
    """Evaluate each rule once, into a flag column the returned rules then refer to."""
    flags = {f"_broken_{rule.code}": F.coalesce(rule.broken, F.lit(False)) for rule in rules}
    marked = [Rule(r.code, F.col(f), r.value) for r, f in zip(rules, flags, strict=True)]
    return requests.withColumns(flags), marked


def judged(requests: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add `reason`, `message` and `reasons`."""
    codes = [F.when(rule.broken, F.lit(rule.code)) for rule in rules]
    return requests.withColumns(
        {
            "reason": F.coalesce(*codes),
            "message": F.coalesce(*(F.when(rule.broken, rule.message()) for rule in rules)),
            "reasons": F.array_compact(F.array(*codes)),
        }
    )


def accepted(judged_requests: DataFrame) -> DataFrame:
    return judged_requests.filter(F.col("reason").isNull()).drop(*RULING)


def rejected(judged_requests: DataFrame) -> DataFrame:
    return judged_requests.filter(F.col("reason").isNotNull())


def _with_trimmed(requests: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Each text trimmed once, into a column the rules share."""
    return requests.withColumns({f"_{c}": text.trimmed(c) for c in columns})


def _missing(column: str) -> Column:
    """NULL, empty or white space only."""
    return F.coalesce(f"_{column}", F.lit("")) == ""


def _too_long(lengths: dict[str, int]) -> Column:
    over = (F.coalesce(F.length(f"_{c}"), F.lit(0)) > limit for c, limit in lengths.items())
    return reduce(or_, over)


def _any(rules: list[Rule]) -> Column:
    return reduce(or_, (rule.broken for rule in rules))


def _asked_for(stored: DataFrame, key: str, batch: DataFrame, asked: str) -> DataFrame:
    """The rows of a stored table whose key the batch asks for.

    What follows then costs as much as the batch: a small batch is the side that is sent to
    all tasks, and the stored table is not shuffled.
    """
    keys = batch.select(F.col(asked).alias("_asked")).distinct()
    return stored.join(keys, F.col(key) == F.col("_asked"), "left_semi")


def _judged_with_owner(
    requests: DataFrame,
    own: list[Rule],
    limits: list[Rule],
    existing: DataFrame,
    key: str,
    taken: str,
) -> DataFrame:
    """Judge by the request's `own` rules, then by whether its trimmed `key` is `taken`, then by
    the column `limits`.

    A key belongs to an existing row, else to the first request of the batch that breaks no
    other rule. Claims are reduced to one row per key before the join, on the map side first,
    so a key that fills a third of the batch is one claim.
    """
    marked, rules = _marked(requests, [*own, *limits])
    # A faulty request claims nothing. As a filter, the rules would be pushed below the columns
    # they share and evaluate those once per use.
    claim = F.when(~_any(rules), F.col("request_seq").cast("bigint"))
    claims = (
        marked.select(f"_{key}", claim.alias("_owner"))
        .unionAll(
            _asked_for(existing.select(key), key, marked, f"_{key}").select(
                key, F.lit(_ALREADY_THERE)
            )
        )
        .groupBy(f"_{key}")
        .agg(F.min("_owner").alias("_owner"))
    )
    owned = marked.join(claims, f"_{key}", "left")
    rules.insert(len(own), Rule(taken, F.col("_owner") < F.col("request_seq"), F.col(key)))
    return judged(owned, rules)


def validate_customers(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """`requests`: request_seq, first_name, last_name, email, phone, city."""
    own = [
        Rule("first_name_required", _missing("first_name")),
        Rule("last_name_required", _missing("last_name")),
        Rule("email_required", _missing("email")),
        Rule("email_invalid", ~text.email_ok("email")),
        Rule("city_required", _missing("city")),
    ]
    limits = [Rule("too_long", _too_long(CUSTOMER_LENGTHS))]
    trimmed = _with_trimmed(requests, CUSTOMER_LENGTHS)
    result = _judged_with_owner(trimmed, own, limits, existing, "email", "email_taken")
    return result.select(*requests.columns, *RULING)


def clean_customers(customers: DataFrame) -> DataFrame:
    """Trimmed texts; no phone is NULL."""
    return customers.withColumns(
        {
            **{c: text.trimmed(c) for c in ("first_name", "last_name", "email", "city")},
            "phone": text.phone_or_null("phone"),
        }
    )


def validate_products(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """`requests`: request_seq, name, sku, category, price (text)."""
    written, number = F.col("_written"), F.col("_number")
    own = [
        Rule("name_required", _missing("name")),
        Rule("sku_required", _missing("sku")),
        Rule("category_required", _missing("category")),
        Rule("price_required", F.col("price").isNull()),
        Rule("price_invalid", written.isNull() | text.below_zero("_written")),
    ]
    limits = [
        Rule("too_long", _too_long(PRODUCT_LENGTHS)),
        Rule("out_of_range", written.isNotNull() & number.try_cast(PRICE_TYPE).isNull()),
    ]
    read = _with_trimmed(requests, PRODUCT_LENGTHS).withColumns(
        {"_written": text.number_text("price"), "_number": text.leading_number("price")}
    )
    result = _judged_with_owner(read, own, limits, existing, "sku", "sku_taken")
    return result.select(*requests.columns, *RULING)


def clean_products(products: DataFrame) -> DataFrame:
    """Trimmed texts and the price as the catalogue keeps it."""
    return products.withColumns(
        {
            **{c: text.trimmed(c) for c in ("name", "sku", "category")},
            "price": text.leading_number("price").try_cast(PRICE_TYPE),
        }
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested order requests as headers and lines; an order without items has no line."""
    headers = requests.drop("items")
    lines = requests.select("request_seq", F.posexplode("items").alias("pos", "item")).select(
        "request_seq", F.col("pos").cast("bigint").alias("pos"), "item.product_id", "item.quantity"
    )
    return headers, lines


def _no_product() -> Column:
    return F.coalesce(F.col("product_id"), F.lit(0)) == 0


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """Lines whose product came up earlier in the same order.

    Only repeated (order, product) pairs meet the lines again, and they carry the first
    position: no window has to hold all lines of a pair in one task. The pairs are stored, so
    that Spark knows their size and leaves the lines where they are when the pairs are few.
    """
    repeated = checkpointed(
        lines.filter(~_no_product())
        .groupBy("request_seq", "product_id")
        .agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("_lines"))
        .filter("_lines > 1")
        .drop("_lines")
    )
    return lines.join(repeated, ["request_seq", "product_id"]).filter("pos > first_pos")


def priced_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with whole quantity, catalogue price and subtotal, NULL where there is none.

    A price sent by the client is never looked at.
    """
    catalogue = products.select("product_id", F.col("price").alias("unit_price"))
    catalogue = _asked_for(catalogue, "product_id", lines, "product_id")
    return (
        lines.select("request_seq", "pos", "product_id", "quantity")
        .join(catalogue, "product_id", "left")
        .withColumn("quantity", text.whole_quantity("quantity"))
        .withColumn(
            "subtotal", (F.col("quantity") * F.col("unit_price")).try_cast("decimal(18,2)")
        )
        .select("request_seq", "pos", "product_id", "quantity", "unit_price", "subtotal")
    )


def validate_orders(headers: DataFrame, priced: DataFrame, customers: DataFrame) -> DataFrame:
    """`headers`: request_seq, customer_id, order_date (text), status; `priced`: the lines as
    priced_lines gives them, best stored, as they are read twice. One bad line rejects the
    whole order.

    Lines shrink to one row per order: the first position of each kind of fault, as plain
    minima that combine on the map side. `order_date` comes back parsed, `status` with its
    default, with `item_count` and `total_amount` beside them.
    """
    pos, quantity, subtotal = F.col("pos"), F.col("quantity"), F.col("subtotal")
    fault = {
        "required": _no_product(),
        "unknown": F.col("unit_price").isNull(),
        "quantity": quantity.isNull() | (quantity <= 0),
    }
    aggregates = [
        F.min(F.when(broken, pos)).alias(f"_{kind}_pos") for kind, broken in fault.items()
    ]
    aggregates += [
        F.min_by("product_id", F.when(fault[kind], pos)).alias(f"_{kind}_id")
        for kind in ("unknown", "quantity")
    ]
    limit = F.lit(LARGEST_AMOUNT).cast(PRICE_TYPE)
    per_order = priced.groupBy("request_seq").agg(
        *aggregates,
        F.count(F.lit(1)).alias("item_count"),
        F.sum("subtotal").alias("total_amount"),
        F.coalesce(
            F.bool_or(
                (quantity > LARGEST_INT)
                | (subtotal > limit)
                | (quantity.isNotNull() & F.col("unit_price").isNotNull() & subtotal.isNull())
            ),
            F.lit(False),
        ).alias("_large"),
    )
    repeats = (
        duplicate_lines(priced)
        .groupBy("request_seq")
        .agg(
            F.min("pos").alias("_repeated_pos"),
            F.min_by("product_id", "pos").alias("_repeated_id"),
        )
    )
    known = _asked_for(customers.select("customer_id"), "customer_id", headers, "customer_id")
    known = known.distinct().withColumn("_known", F.lit(True))
    facts = (
        headers.join(per_order, "request_seq", "left")
        .join(repeats, "request_seq", "left")
        .join(known, "customer_id", "left")
        .withColumn("_date", text.parsed_time("order_date"))
        .withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit(DEFAULT_STATUS)))
    )

    def first(one: str, other: str) -> Column:
        """`one` occurs, and not after `other`."""
        return F.col(one).isNotNull() & (F.col(one) <= F.coalesce(F.col(other), F.col(one)))

    required_first = first("_required_pos", "_repeated_pos")
    unknown_first = first("_unknown_pos", "_quantity_pos")
    rules = [
        Rule("items_required", F.col("item_count").isNull()),
        Rule("product_required", required_first),
        Rule("product_repeated", F.col("_repeated_pos").isNotNull(), F.col("_repeated_id")),
        Rule("product_required", F.col("_required_pos").isNotNull() & ~required_first),
        Rule("status_invalid", ~F.col("status").isin(*STATUSES), F.col("status")),
        Rule("date_invalid", (F.col("order_date") != "") & F.col("_date").isNull()),
        Rule("customer_unknown", F.col("_known").isNull(), F.col("customer_id")),
        Rule("product_unknown", unknown_first, F.col("_unknown_id")),
        Rule("quantity_invalid", F.col("_quantity_pos").isNotNull(), F.col("_quantity_id")),
        Rule("product_unknown", F.col("_unknown_pos").isNotNull() & ~unknown_first),
        Rule("out_of_range", F.col("_large") | (F.col("total_amount") > limit)),
    ]
    return judged(facts, rules).select(
        "request_seq",
        "customer_id",
        F.col("_date").alias("order_date"),
        "status",
        F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"),
        "total_amount",
        *RULING,
    )


def accepted_orders(validated: DataFrame, as_of: str) -> DataFrame:
    """Orders to write; one without a date is dated `as_of`, so that a rerun agrees."""
    return accepted(validated).withColumn(
        "order_date", F.coalesce("order_date", F.lit(as_of).cast("timestamp"))
    )


def accepted_lines(validated: DataFrame, priced: DataFrame) -> DataFrame:
    """Priced lines of accepted orders; no line of a rejected order gets through."""
    good = accepted(validated).select("request_seq")
    return priced.join(good, "request_seq", "left_semi")


def order_quote(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Running total of draft orders; an unknown product counts as price 0."""
    catalogue = products.select("product_id", "price")
    amount = F.col("quantity") * F.coalesce("price", F.lit(0).cast(PRICE_TYPE))
    return (
        lines.join(catalogue, "product_id", "left")
        .groupBy("request_seq")
        .agg(F.sum(amount.cast("decimal(18,2)")).alias("total"))
    )
