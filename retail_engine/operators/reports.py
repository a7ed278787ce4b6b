"""Reports on the star schema and lists of the operational tables.

Money stays decimal until the last step and leaves as double. Unit and order counts are
BIGINT: an INT total overflows at scale.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_engine.operators import ranking
from retail_engine.operators.star import full_name

TOP_PRODUCTS = 10
# Statuses that do not count towards net revenue.
NOT_NET = ("Cancelled", "Refunded")


def _double(total: Column | str) -> Column:
    return F.col(total).cast("double") if isinstance(total, str) else total.cast("double")


def revenue_summary(fact: DataFrame) -> DataFrame:
    """One row: revenue, units, distinct orders, revenue per order (NULL without orders)."""
    totals = fact.agg(
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("units"),
        F.countDistinct("order_id").alias("orders"),
    )
    return totals.select(
        _double("revenue").alias("totalRevenue"),
        F.col("units").cast("bigint").alias("totalUnitsSold"),
        F.col("orders").cast("bigint").alias("totalOrders"),
        F.try_divide(_double("revenue"), _double("orders")).alias("averageOrderValue"),
    )


def net_revenue(fact: DataFrame, orders: DataFrame, excluded: Sequence[str] = NOT_NET) -> DataFrame:
    """The summary over sales whose order status is not excluded."""
    counted = orders.filter(~F.col("status").isin(*excluded)).select("order_id")
    return revenue_summary(fact.join(counted, "order_id", "left_semi"))


def sales_by_product(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Units and revenue per (name, category); products that share both are one row.

    The fact shrinks to one row per product before it meets the dimension, so the join
    moves products, not sales, and a best-seller is summed on the map side.
    """
    per_product = fact.groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue")
    )
    return (
        per_product.join(dim_product.select("product_id", "name", "category"), "product_id")
        .groupBy(F.col("name").alias("productName"), "category")
        .agg(
            F.sum("units").cast("bigint").alias("totalUnits"),
            _double(F.sum("revenue")).alias("totalRevenue"),
        )
    )


def sales_by_city(fact: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Distinct orders, units and revenue per city of the buyer.

    Sales shrink to one row per order before they meet the customers; the fact is already
    clustered by order, so that needs no shuffle. The distinct count groups by (city, order)
    before it groups by city, with the sums alongside: a big city spreads over all tasks.
    """
    per_order = fact.groupBy("order_id", "customer_id").agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue")
    )
    return (
        per_order.join(dim_customer.select("customer_id", "city"), "customer_id")
        .groupBy("city")
        .agg(
            F.countDistinct("order_id").cast("bigint").alias("totalOrders"),
            F.sum("quantity").cast("bigint").alias("totalUnits"),
            _double(F.sum("revenue")).alias("totalRevenue"),
        )
    )


def daily_sales(fact: DataFrame) -> DataFrame:
    """Distinct orders and revenue per calendar day of the session time zone."""
    return fact.groupBy(F.to_date("sale_date").alias("date")).agg(
        F.countDistinct("order_id").cast("bigint").alias("totalOrders"),
        _double(F.sum("revenue")).alias("totalRevenue"),
    )


def by_revenue(report: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    """Highest revenue first; equal revenue goes by `tie_break`."""
    return report.orderBy(
        F.desc_nulls_last("totalRevenue"), *(F.asc_nulls_last(c) for c in tie_break)
    )


def by_day(report: DataFrame) -> DataFrame:
    return report.orderBy(F.asc_nulls_last("date"))


PRODUCT_TIE_BREAK = ("productName", "category")
CITY_TIE_BREAK = ("city",)


def top_products(report: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    return by_revenue(report, PRODUCT_TIE_BREAK).limit(n)


def product_ranking(report: DataFrame) -> DataFrame:
    return ranking.ranked_by_revenue(report, PRODUCT_TIE_BREAK)


def city_ranking(report: DataFrame) -> DataFrame:
    return ranking.ranked_by_revenue(report, CITY_TIE_BREAK)


def customers_list(customers: DataFrame) -> DataFrame:
    """Customers by first and last name. The id ends the sort key, so that namesakes can
    be range-partitioned like everyone else."""
    return customers.select(
        "customer_id", "first_name", "last_name", "email", "phone", "city", "created_at"
    ).orderBy(
        F.asc_nulls_last("first_name"), F.asc_nulls_last("last_name"), F.asc("customer_id")
    )


def products_list(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id", "name", "sku", "category", "price", "created_at"
    ).orderBy(F.asc_nulls_last("name"), F.asc("product_id"))


def orders_list(orders: DataFrame, customers: DataFrame, order_items: DataFrame) -> DataFrame:
    """Orders with buyer and item count (0 without items), newest first.

    Items are counted per order before the join, which therefore is one to one.
    """
    counts = (
        order_items.filter(F.col("order_item_id").isNotNull())
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("item_count"))
    )
    buyers = customers.select(
        "customer_id",
        full_name().alias("customer_name"),
        F.col("email").alias("customer_email"),
        F.col("city").alias("customer_city"),
    )
    return (
        orders.select("order_id", "customer_id", "order_date", "status", "total_amount")
        .join(counts, "order_id", "left")
        .join(buyers, "customer_id")
        .select(
            "order_id",
            "order_date",
            "customer_name",
            "customer_email",
            "customer_city",
            "status",
            "total_amount",
            F.coalesce("item_count", F.lit(0)).cast("int").alias("item_count"),
        )
        .orderBy(F.desc_nulls_first("order_date"), F.desc("order_id"))
    )


def order_totals(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Sum of the line subtotals per order, 0.00 without lines."""
    sums = order_items.groupBy("order_id").agg(F.sum("subtotal").alias("total"))
    return (
        orders.select("order_id")
        .join(sums, "order_id", "left")
        .select(
            "order_id",
            F.coalesce("total", F.lit(0)).cast("decimal(28,2)").alias("total_amount"),
        )
    )


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per operational table, and the number of distinct cities."""
    counts = {
        name: tables[name].agg(F.count(F.lit(1)).alias("count"))
        for name in ("customers", "products", "orders", "order_items")
    }
    counts["cities"] = tables["customers"].agg(F.countDistinct("city").alias("count"))
    named = (count.select(F.lit(name).alias("entity"), "count") for name, count in counts.items())
    return reduce(DataFrame.unionAll, named)
