"""Reports out of states that merge, so that new sales cost what they are, not the whole fact.

A state has exact sums, and the orders it has seen as bitmaps, one long for each 64 order ids:
an order that two batches share counts once when the bitmaps meet. A row is then of one small
size, however few of a bitmap's orders fall on its day or city, and there are never more rows
than orders of a day. Sums of a merged state are those of the rows, to the last digit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_engine.schemas import REPORT_STATES, conform

Tables = dict[str, DataFrame]

#: A bitmap holds as many orders as a long has bits: two to this power.
_ID_BITS = 6

#: What each state is kept by, bitmaps aside.
KEYS = {"day_states": "day", "city_states": "city", "product_states": "product_id"}


def states(fact: DataFrame, dim_customer: DataFrame) -> Tables:
    """The states of some sales. A sale belongs to the city its buyer has at this time."""
    cities = dim_customer.select("customer_id", "city")
    rows = {
        "day_states": fact.withColumn("day", F.to_date("sale_date")),
        "city_states": fact.join(cities, "customer_id"),
        "product_states": fact,
    }
    sums = [F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue")]
    bucket = F.shiftright("order_id", _ID_BITS).alias("bucket")
    place = F.col("order_id").bitwiseAND(F.lit((1 << _ID_BITS) - 1)).cast("int")
    orders = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias("orders")
    found = {
        name: rows[name].groupBy(KEYS[name], bucket).agg(*sums, orders)
        for name in ("day_states", "city_states")
    }
    found["product_states"] = fact.groupBy("product_id").agg(*sums)
    return {name: conform(state, REPORT_STATES[name]) for name, state in found.items()}


def merged(parts: list[DataFrame] | DataFrame, name: str) -> DataFrame:
    """One state out of several of the same kind."""
    if isinstance(parts, list):
        parts = reduce(DataFrame.unionByName, parts)
    sums = [F.sum("units").alias("units"), F.sum("revenue").alias("revenue")]
    if name == "product_states":
        found = parts.groupBy("product_id").agg(*sums)
    else:
        orders = F.bit_or("orders").alias("orders")
        found = parts.groupBy(KEYS[name], "bucket").agg(*sums, orders)
    return conform(found, REPORT_STATES[name])


def _orders(state: DataFrame, *keys: str) -> DataFrame:
    """Distinct orders, units and revenue by `keys`; bitmaps of a bucket meet first."""
    sums = [F.sum("units").alias("units"), F.sum("revenue").alias("revenue")]
    buckets = state.groupBy(*keys, "bucket").agg(*sums, F.bit_or("orders").alias("orders"))
    orders = F.coalesce(F.bit_count("orders"), F.lit(0))
    return buckets.groupBy(*keys).agg(
        F.sum(orders).cast("bigint").alias("totalOrders"), *[
            F.sum(c).alias(c) for c in ("units", "revenue")
        ]
    )


def revenue_summary(states: Tables) -> DataFrame:
    """As reports.revenue_summary over all sales."""
    revenue = F.col("revenue").cast("double")
    orders = F.coalesce("totalOrders", F.lit(0))
    return _orders(states["day_states"]).select(
        revenue.alias("totalRevenue"),
        F.col("units").cast("bigint").alias("totalUnitsSold"),
        orders.cast("bigint").alias("totalOrders"),
        F.try_divide(revenue, orders.cast("double")).alias("averageOrderValue"),
    )


def daily_sales(states: Tables) -> DataFrame:
    """As reports.daily_sales over all sales."""
    return _orders(states["day_states"], "day").select(
        F.col("day").alias("date"),
        "totalOrders",
        F.col("revenue").cast("double").alias("totalRevenue"),
    )


def sales_by_city(states: Tables) -> DataFrame:
    """As reports.sales_by_city over all sales, each at the city its buyer had then."""
    return _orders(states["city_states"], "city").select(
        "city",
        "totalOrders",
        F.col("units").cast("bigint").alias("totalUnits"),
        F.col("revenue").cast("double").alias("totalRevenue"),
    )


def sales_by_product(states: Tables, dim_product: DataFrame) -> DataFrame:
    """As reports.sales_by_product over all sales, by the names the products have now."""
    per_product = merged(states["product_states"], "product_states")
    return (
        per_product.join(dim_product.select("product_id", "name", "category"), "product_id")
        .groupBy(F.col("name").alias("productName"), "category")
        .agg(
            F.sum("units").cast("bigint").alias("totalUnits"),
            F.sum("revenue").cast("double").alias("totalRevenue"),
        )
    )
