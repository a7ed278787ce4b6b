"""Deletes and updates of operational tables, as new table contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cascade_delete(
    orders: DataFrame, order_items: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Orders and items that stay when the orders in `deleted` (order_id) go."""
    gone = deleted.select("order_id")
    return (
        orders.join(gone, "order_id", "left_anti"),
        order_items.join(gone, "order_id", "left_anti"),
    )


def restrict_delete(candidates: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Candidates that must stay because a child row refers to them.

    Children shrink to one row per key first: a join cannot split the side it only looks up.
    """
    return candidates.join(children.select(key).distinct(), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, as_of: str) -> DataFrame:
    """`old` with the rows of `new` put in by `key`, which is unique in both.

    A matched row takes the new values and is stamped in `updated_at`, changed or not; an
    unmatched new row is created at `as_of`; all others stay as they are.
    """
    stamp = F.lit(as_of).cast(old.schema["updated_at"].dataType)
    values = [c for c in old.columns if c not in (key, "created_at", "updated_at")]
    before = old.select(
        key, *(F.col(c).alias(f"_old_{c}") for c in values), "created_at", "updated_at",
        F.lit(True).alias("_was"),
    )
    after = new.select(key, *values, F.lit(True).alias("_sent"))
    merged = before.join(after, key, "full_outer")
    sent, was = F.col("_sent").isNotNull(), F.col("_was").isNotNull()
    return merged.select(
        key,
        *(F.when(sent, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in values),
        F.when(was, F.col("created_at")).otherwise(stamp).alias("created_at"),
        F.when(sent, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*old.columns)
