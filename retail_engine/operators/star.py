"""The star schema: two dimensions and one fact, at the grain of the operational rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_engine.schemas import MONEY


def full_name() -> Column:
    """First and last name with a blank between; NULL when either is NULL."""
    return F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))


def dim_customer(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", full_name().alias("name"), "city", "created_at")


def dim_product(products: DataFrame) -> DataFrame:
    return products.select("product_id", "name", "category", "price")


def fact_sales(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order item whose order exists; every status is kept.

    Revenue is computed from quantity and unit price, not copied from the subtotal.
    """
    headers = orders.select("order_id", "customer_id", F.col("order_date").alias("sale_date"))
    revenue = (F.col("quantity") * F.col("unit_price")).cast(MONEY)
    return order_items.join(headers, "order_id").select(
        F.col("order_item_id").alias("sale_id"),
        "order_id",
        "customer_id",
        "product_id",
        "quantity",
        revenue.alias("revenue"),
        "sale_date",
    )


def build(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The three warehouse tables from the four operational ones."""
    return {
        "dim_customer": dim_customer(tables["customers"]),
        "dim_product": dim_product(tables["products"]),
        "fact_sales": fact_sales(tables["order_items"], tables["orders"]),
    }
