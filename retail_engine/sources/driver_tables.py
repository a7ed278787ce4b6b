"""The given Parquet tables as operational tables; the rules are in FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_engine.operators.ranking import with_position

_SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}

# All columns of a line, in the order that numbers the lines.
_LINE_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
# Those that anything reads once the lines are numbered.
_LINE_READ = ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")

_NO_TIMES = (
    "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
    "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at",
)
_MEASURES = (
    "l_orderkey AS order_id",
    "l_partkey AS product_id",
    "CAST(l_quantity AS BIGINT) AS quantity",
    "try_divide(l_extendedprice, l_quantity) AS unit_price",
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS subtotal",
)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read with its schema so that no inference job runs."""
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def named_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given customers with their name in two parts and the nation's name as city."""
    nation = given(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS c_nationkey", "n_name AS city"
    )
    return (
        given(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .selectExpr(
            "*",
            "split_part(c_name, '#', 1) AS first_name",
            "split_part(c_name, '#', 2) AS last_name",
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_customers(spark, sf_dir).selectExpr(
        "c_custkey AS customer_id",
        "first_name",
        "last_name",
        "concat(lower(replace(c_name, '#', '.')), '@example.com') AS email",
        "CAST(NULL AS STRING) AS phone",
        "city",
        *_NO_TIMES,
        "c_acctbal",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "p_name AS name",
        "concat('P-', p_partkey) AS sku",
        "p_type AS category",
        "CAST(p_retailprice AS DECIMAL(10,2)) AS price",
        *_NO_TIMES,
        "p_brand",
        "p_size",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "o_orderdate AS order_date",
        "decode(o_orderstatus, 'F', 'Completed', 'O', 'Processing', 'P', 'Pending') AS status",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount",
        *_NO_TIMES,
        "o_orderpriority",
    )


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given lines with `order_item_id`, their position in the order of all columns."""
    lines = given(spark, sf_dir, "lineitem")
    order = [F.asc_nulls_last(c) for c in _LINE_ORDER]
    return with_position(lines, order, "order_item_id", keep=_LINE_READ)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_lines(spark, sf_dir).selectExpr("order_item_id", *_MEASURES)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items for jobs that never look at the item id, which stays a placeholder."""
    return given(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS order_item_id", *_MEASURES)


def operational(spark: SparkSession, sf_dir: str, item_ids: bool = False) -> dict[str, DataFrame]:
    return {
        "customers": customers(spark, sf_dir),
        "products": products(spark, sf_dir),
        "orders": orders(spark, sf_dir),
        "order_items": (order_items if item_ids else order_lines)(spark, sf_dir),
    }
