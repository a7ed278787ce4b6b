"""Report rows as a page shows them: labels beside the values, and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_engine.functions import labels


def orders_display(orders_list: DataFrame) -> DataFrame:
    """The order list with status tag, date, item and amount labels."""
    return orders_list.select(
        "order_id",
        F.concat(F.lit("#"), F.col("order_id").cast("string")).alias("order_label"),
        labels.date_time("order_date").alias("date_label"),
        "customer_name",
        "customer_email",
        "customer_city",
        "status",
        labels.status_tag("status").alias("status_tag"),
        F.concat(F.col("item_count").cast("string"), F.lit(" items")).alias("items_label"),
        labels.rupees("total_amount").alias("amount_label"),
    )


def axis_labels(daily: DataFrame) -> DataFrame:
    """The daily report with axis and tooltip labels."""
    return daily.select(
        "date",
        labels.axis_date("date").alias("date_label"),
        labels.long_date("date").alias("long_date"),
        labels.shorthand("totalRevenue").alias("revenue_axis"),
        labels.rupees("totalRevenue").alias("revenue_label"),
        labels.grouped(F.col("totalOrders")).alias("orders_label"),
    )


def _with_plain_amounts(report: DataFrame) -> DataFrame:
    """Amounts as two-decimal numbers: a large double prints with an exponent."""
    return report.withColumns(
        {
            c: F.col(c).cast("decimal(28,2)")
            for c, kind in report.dtypes
            if kind == "double"
        }
    )


def as_json(report: DataFrame) -> DataFrame:
    """One JSON object per row, fields that are NULL included."""
    return _with_plain_amounts(report).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")
    )


def write_json(report: DataFrame, path: str) -> None:
    """Write the report as JSON lines; an existing path is refused."""
    _with_plain_amounts(report).write.mode("errorifexists").option(
        "ignoreNullFields", "false"
    ).json(path)
