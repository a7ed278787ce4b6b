"""Checks of keys, constraints and totals, as rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_engine.operators.intake import STATUSES

# Declared rules as conditions a row keeps; NULL counts as kept.
_ALLOWED = ", ".join(f"'{status}'" for status in STATUSES)
_RULES = {
    "customers": (
        "customer_id IS NOT NULL",
        "first_name IS NOT NULL",
        "last_name IS NOT NULL",
        "email IS NOT NULL",
        "city IS NOT NULL",
    ),
    "products": (
        "product_id IS NOT NULL",
        "name IS NOT NULL",
        "sku IS NOT NULL",
        "category IS NOT NULL",
        "price IS NOT NULL",
        "price >= 0",
    ),
    "orders": (
        "order_id IS NOT NULL",
        "customer_id IS NOT NULL",
        "status IS NOT NULL",
        f"status IN ({_ALLOWED})",
        "total_amount IS NOT NULL",
        "total_amount >= 0",
    ),
    "order_items": (
        "order_item_id IS NOT NULL",
        "order_id IS NOT NULL",
        "product_id IS NOT NULL",
        "quantity IS NOT NULL",
        "quantity > 0",
        "unit_price IS NOT NULL",
        "unit_price >= 0",
        "subtotal IS NOT NULL",
        "subtotal >= 0",
    ),
}
_UNIQUE = {
    "customers": ("customer_id", "email"),
    "products": ("product_id", "sku"),
    "orders": ("order_id",),
    "order_items": ("order_item_id",),
}
# (child table, column, parent table)
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _as_rows(one_row: DataFrame, name: str, value: str) -> DataFrame:
    """The columns of a one-row aggregate as (name, value) rows."""
    pairs = ", ".join(f'"{c}", `{c}`' for c in one_row.columns)
    return one_row.selectExpr(f"stack({len(one_row.columns)}, {pairs}) AS ({name}, {value})")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    return _union(
        table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, table in tables.items()
    )


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows loaded per table, with the name and type of each column."""

    def columns_of(table: DataFrame) -> Column:
        return F.array(
            *(
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(field.name).alias("column_name"),
                    F.lit(field.dataType.simpleString()).alias("column_type"),
                )
                for i, field in enumerate(table.schema.fields, 1)
            )
        )

    return _union(
        table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.inline(columns_of(table))
        )
        for name, table in tables.items()
    )


def type_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Per column of each table its type, and how many values it holds that are not NULL."""

    def report(name: str, table: DataFrame) -> DataFrame:
        types = [F.lit(part) for c, kind in table.dtypes for part in (c, kind)]
        counts = table.agg(*(F.count(c).alias(c) for c in table.columns))
        filled = _as_rows(counts, "column_name", "filled")
        return filled.select(
            F.lit(name).alias("table_name"),
            "column_name",
            F.create_map(*types)[F.col("column_name")].alias("column_type"),
            "filled",
        )

    return _union(report(name, table) for name, table in tables.items())


def status_audit(orders: DataFrame) -> DataFrame:
    """Orders per status, and whether the status is in the domain."""
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("orders")).withColumn(
        "allowed", F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    )


def fk_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Per foreign key: rows that refer to something, and rows whose parent is missing.

    Children shrink to one row per key value before the join, so a value that a third of
    them share meets its parent once.
    """

    def audit(child: str, column: str, parent: str) -> DataFrame:
        used = (
            tables[child]
            .filter(F.col(column).isNotNull())
            .groupBy(column)
            .agg(F.count(F.lit(1)).alias("_rows"))
        )
        parents = tables[parent].select(column, F.lit(True).alias("_found")).distinct()
        return (
            used.join(parents, column, "left")
            .agg(
                F.coalesce(F.sum("_rows"), F.lit(0)).alias("checked"),
                F.coalesce(
                    F.sum(F.when(F.col("_found").isNull(), F.col("_rows"))), F.lit(0)
                ).alias("orphans"),
            )
            .select(F.lit(f"{child}.{column}").alias("foreign_key"), "checked", "orphans")
        )

    return _union(audit(*key) for key in FOREIGN_KEYS)


def orphans(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """The rows of `child` whose parent is missing."""
    return child.filter(F.col(column).isNotNull()).join(
        parent.select(column).distinct(), column, "left_anti"
    )


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per declared rule: one grouping by primary key per table, which carries the
    counts of NOT NULL and CHECK along, and one for each other unique column."""
    parts = []
    for name, table in tables.items():
        key, *others = _UNIQUE[name]
        broken = [F.expr(f"count_if(NOT ({rule}))").alias(rule) for rule in _RULES[name]]
        per_key = table.groupBy(key).agg(F.count("*").alias("_rows"), *broken)
        again = F.sum(F.when(F.col(key).isNotNull(), F.col("_rows") - 1))
        counted = per_key.agg(
            *(F.coalesce(F.sum(f"`{r}`"), F.lit(0)).alias(r) for r in _RULES[name]),
            F.coalesce(again, F.lit(0)).alias(f"{key} UNIQUE"),
        )
        parts.append(
            _as_rows(counted, "rule", "violations").selectExpr(
                f"'{name}' AS table_name", "rule", "violations"
            )
        )
        for column in others:
            rows_per_value = (
                table.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
            )
            parts.append(
                rows_per_value.selectExpr(
                    f"'{name}' AS table_name",
                    f"'{column} UNIQUE' AS rule",
                    "coalesce(sum(n - 1), 0L) AS violations",
                )
            )
    return _union(parts)


def total_audit(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Orders whose total is not the sum of their subtotals, or with a line whose subtotal is
    not quantity times unit price."""
    exact = (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)")
    per_order = order_items.groupBy("order_id").agg(
        F.sum("subtotal").alias("_sum"),
        F.count_if(~F.col("subtotal").eqNullSafe(exact)).alias("_bad"),
    )
    return (
        orders.select("order_id", "total_amount")
        .join(per_order, "order_id", "left")
        .select(
            "order_id",
            "total_amount",
            F.coalesce("_sum", F.lit(0)).cast("decimal(28,2)").alias("items_total"),
            F.coalesce("_bad", F.lit(0)).alias("bad_lines"),
        )
        .filter("NOT total_amount <=> items_total OR bad_lines > 0")
    )


def reconcile_totals(order_items: DataFrame, fact: DataFrame) -> DataFrame:
    """Revenue, orders and quantity of the source against the warehouse, compared exactly."""

    def totals(side: str, rows: DataFrame, revenue: Column) -> DataFrame:
        one_row = rows.agg(
            F.sum(revenue).cast("decimal(38,2)").alias("revenue"),
            F.countDistinct("order_id").cast("decimal(38,2)").alias("orders"),
            F.sum("quantity").cast("decimal(38,2)").alias("quantity"),
        )
        return _as_rows(one_row, "metric", "value").withColumn("side", F.lit(side))

    source_revenue = (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)")
    both = totals("source", order_items, source_revenue).unionAll(
        totals("warehouse", fact, F.col("revenue"))
    )
    return (
        both.groupBy("metric")
        .agg(
            F.max(F.when(F.col("side") == "source", F.col("value"))).alias("source_value"),
            F.max(F.when(F.col("side") == "warehouse", F.col("value"))).alias("warehouse_value"),
        )
        .withColumn("matches", F.col("source_value").eqNullSafe(F.col("warehouse_value")))
    )


def count_drift(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows per table in two snapshots and the difference; a table may be in one only."""
    old = row_counts(before).withColumnRenamed("row_count", "rows_before")
    new = row_counts(after).withColumnRenamed("row_count", "rows_after")
    return old.join(new, "table_name", "full_outer").select(
        "table_name",
        "rows_before",
        "rows_after",
        (F.coalesce("rows_after", F.lit(0)) - F.coalesce("rows_before", F.lit(0))).alias("drift"),
    )
