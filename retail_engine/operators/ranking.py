"""Positions in a total order, without moving all rows (or a hot group) to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retail_engine.session import checkpointed

# monotonically_increasing_id() keeps the row index of a partition in its lower 33 bits.
_INDEX_BITS = 33


def with_position(
    df: DataFrame, order: Sequence[Column], name: str, keep: Sequence[str] | None = None
) -> DataFrame:
    """Add `name`, the 1-based position of each row in `order`, a key that only equal rows share.

    Rows are range-partitioned on the whole key, so equal leading values spread over tasks.
    The tagged rows are checkpointed because the range bounds come from a sample: counting
    and numbering must see the same partitions, also after a lost executor. Only the columns
    in `keep`, by default all, are carried on from there.
    """
    tagged = checkpointed(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*(keep or df.columns), F.monotonically_increasing_id().alias("_slot"))
    )
    part = F.shiftright("_slot", _INDEX_BITS)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition from here on, whatever the data size; stored, as every step that
    # reads the positions would count the rows again.
    starts = checkpointed(
        sizes.select(
            "_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start")
        )
    )
    index = F.col("_slot").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + index + 1).cast("bigint"))
        .drop("_part", "_slot", "_start")
    )


def badge(rank: str) -> Column:
    """The first three ranks carry their number, all others `default`."""
    return F.when(F.col(rank) <= 3, F.col(rank).cast("string")).otherwise("default")


def ranked_by_revenue(report: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    """Rank and badge each row by falling revenue; equal revenue goes by `tie_break`."""
    order = [F.desc_nulls_last("totalRevenue"), *(F.asc_nulls_last(c) for c in tie_break)]
    return with_position(report, order, "rank").withColumn("badge", badge("rank"))


def largest_id(existing: DataFrame, key: str) -> int:
    """The largest `key` of a table, 0 when it is empty."""
    return existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).first()[0]


def next_ids(new: DataFrame, last: int, key: str, order: Sequence[Column]) -> DataFrame:
    """Number `new` rows in `order` on from the id `last`."""
    placed = with_position(new, order, "_place")
    columns = [c for c in new.columns if c != key]
    return placed.select((F.col("_place") + F.lit(last)).alias(key), *columns)
