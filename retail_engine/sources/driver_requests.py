"""Request batches, manifests and run logs derived from the given tables.

The given tables hold clean sales only, so the rules below (listed in FIXTURES.md) turn
attributes that are already there into the faults intake and audits look for. Every row of
a given table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_engine.sources.driver_tables import (
    customers,
    given,
    named_customers,
    numbered_lines,
    orders,
    products,
)

_ADDRESS = "concat('user', floor(c_acctbal), '@example.com')"
_SKU = "concat('S-', p_size, '-', floor(p_retailprice))"
_SHOWN_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING)"

# Events as the run log of one run per hour.
_RUN_ID = "date_format(ts, 'yyyyMMddHH')"
_TABLE = (
    "decode(event_type, 'view', 'customers', 'click', 'products', 'purchase', 'orders', "
    "'signup', 'order_items')"
)


def customer_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, existing customers): BUILDING customers exist, all others ask."""
    rows = named_customers(spark, sf_dir)
    requests = rows.filter("c_mktsegment <> 'BUILDING'").selectExpr(
        "c_custkey AS request_seq",
        "IF(c_nationkey = 17, repeat(first_name, 13), first_name) AS first_name",
        "IF(c_nationkey = 11, NULL, last_name) AS last_name",
        f"CASE c_nationkey WHEN 3 THEN replace({_ADDRESS}, '@', '') "
        f"WHEN 13 THEN concat(' ', {_ADDRESS}) ELSE {_ADDRESS} END AS email",
        "CASE c_nationkey WHEN 5 THEN '' WHEN 6 THEN concat(' +91 ', c_custkey, ' ') END AS phone",
        "IF(c_nationkey = 7, '  ', concat(' ', city)) AS city",
    )
    existing = rows.filter("c_mktsegment = 'BUILDING'").selectExpr(
        "c_custkey AS customer_id", f"{_ADDRESS} AS email"
    )
    return requests, existing


def product_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, existing products): Brand#1 is in the catalogue, all others are offered."""
    rows = given(spark, sf_dir, "part")
    requests = rows.filter("p_brand <> 'Brand#1'").selectExpr(
        "p_partkey AS request_seq",
        "IF(p_size = 7, repeat(p_name, 40), p_name) AS name",
        f"{_SKU} AS sku",
        "IF(p_size = 6, '', p_type) AS category",
        f"CASE p_size WHEN 1 THEN NULL WHEN 2 THEN concat('-', {_SHOWN_PRICE}) WHEN 3 THEN 'abc' "
        f"WHEN 4 THEN concat({_SHOWN_PRICE}, ' INR') WHEN 5 THEN '123456789' "
        "WHEN 8 THEN '-0.00000000001' WHEN 9 THEN '1e30' "
        f"ELSE {_SHOWN_PRICE} END AS price",
    )
    existing = rows.filter("p_brand = 'Brand#1'").selectExpr(
        "p_partkey AS product_id", f"{_SKU} AS sku"
    )
    return requests, existing


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a request."""
    return orders(spark, sf_dir).selectExpr(
        "order_id AS request_seq",
        "customer_id",
        "CASE WHEN o_orderpriority = '2-HIGH' AND status = 'Pending' THEN 'soon' "
        "WHEN o_orderpriority = '2-HIGH' AND status = 'Completed' THEN NULL "
        "WHEN o_orderpriority = '1-URGENT' THEN CASE status "
        "WHEN 'Pending' THEN date_format(order_date, 'd MMM yyyy HH:mm:ss') "
        "WHEN 'Completed' THEN date_format(order_date, 'EEE MMM dd yyyy HH:mm:ss') "
        "ELSE date_format(order_date, 'M/d/yyyy H:mm:ss') END "
        "WHEN o_orderpriority = '3-MEDIUM' "
        "THEN date_format(order_date, 'MMM d, yyyy HH:mm:ss') "
        "ELSE date_format(order_date, 'yyyy-MM-dd HH:mm:ss') END AS order_date",
        "CASE WHEN o_orderpriority = '5-LOW' AND status = 'Processing' THEN 'Shipped' "
        "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE status END AS status",
    )


def order_request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the order requests, in the order of their item id."""
    return numbered_lines(spark, sf_dir).selectExpr(
        "l_orderkey AS request_seq",
        "order_item_id AS pos",
        "IF(l_quantity = 2 AND l_returnflag = 'R', 0L, l_partkey) AS product_id",
        "CASE WHEN l_quantity = 1 THEN decode(l_returnflag, 'R', '0', 'A', '1.5', 'N', '1abc') "
        "ELSE CAST(l_quantity AS STRING) END AS quantity",
    )


def known_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers an order request may name: those not deep in debt."""
    return customers(spark, sf_dir).filter("c_acctbal >= -900")


def known_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products an order request may name: all but the largest size."""
    return products(spark, sf_dir).filter("p_size < 50")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but an error is a landed snapshot; a small value leaves a folder marker."""
    return (
        given(spark, sf_dir, "events")
        .filter("event_type <> 'error'")
        .selectExpr(
            f"{_TABLE} AS table_name",
            f"{_RUN_ID} AS run_id",
            "to_date(ts) AS load_date",
            "ts AS committed_at",
            f"concat(concat_ws('/', 'raw', {_TABLE}, date_format(ts, 'yyyy-MM-dd'), {_RUN_ID}, "
            "event_id), IF(value < 1, '/', '')) AS path",
            "floor(value) AS row_count",
        )
    )


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a step of its hour's run: an error is one that failed, all others land a
    table."""
    return given(spark, sf_dir, "events").selectExpr(
        f"{_RUN_ID} AS run_id",
        "event_id AS step_no",
        "'land' AS step",
        "ts AS at",
        "IF(event_type = 'error', 'no rows', NULL) AS message",
        f"IF(event_type = 'error', NULL, {_TABLE}) AS table_name",
        "floor(value) AS row_count",
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event: counts of landed or loaded rows, and noise."""
    return given(spark, sf_dir, "events").selectExpr(
        f"{_RUN_ID} AS run_id",
        "event_id",
        "CASE WHEN event_type <> 'error' "
        f"THEN concat('  Extracted ', lpad(floor(value), 4, ' '), ' rows from \"', {_TABLE}, "
        "'\" -> done') "
        "WHEN value < 50 THEN concat('Table \"fact_sales\": ', floor(value), ' records loaded.') "
        "ELSE concat('Connection closed after ', floor(value), ' rows') END AS line",
    ).withColumn("line", F.replace("line", F.lit('"'), F.lit("'")))
