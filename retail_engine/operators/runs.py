"""Snapshots and runs as data: what was landed, what ran, what it counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines that extraction and load write to the run log, and their tables.
EXTRACTED = r"(?i)Extracted\s+(\d+)\s+rows from '(\w+)'"
LOADED = r"Table '(\w+)': (\d+) records loaded"
EXTRACTED_TABLES = ("customers", "products", "orders", "order_items")
LOADED_TABLES = ("dim_customer", "dim_product", "fact_sales")


def latest_snapshot(manifest: DataFrame) -> DataFrame:
    """The newest snapshot of each table on its own; at equal times the larger run id.

    Entries that name a directory marker (path ending in /) do not count.
    """
    newest = F.max_by(
        F.struct("path", "run_id", "committed_at"), F.struct("committed_at", "run_id", "path")
    )
    return (
        manifest.filter(~F.col("path").endswith("/"))
        .groupBy("table_name")
        .agg(newest.alias("_newest"))
        .select("table_name", "_newest.*")
    )


def missing_snapshots(
    manifest: DataFrame, runs: DataFrame, expected: Sequence[str] = EXTRACTED_TABLES
) -> DataFrame:
    """(run_id, table_name) pairs that the manifest lacks, for each run in `runs`."""
    wanted = runs.select("run_id").distinct().select(
        "run_id", F.explode(F.array(*(F.lit(t) for t in expected))).alias("table_name")
    )
    landed = manifest.select("run_id", "table_name").distinct()
    return wanted.join(landed, ["run_id", "table_name"], "left_anti")


def latest_complete_run(
    manifest: DataFrame, expected: Sequence[str] = EXTRACTED_TABLES
) -> DataFrame:
    """The newest run that landed every expected table (no row when there is none)."""
    return (
        manifest.filter(F.col("table_name").isin(*expected))
        .groupBy("run_id")
        .agg(
            F.countDistinct("table_name").alias("_tables"),
            F.max("committed_at").alias("committed_at"),
        )
        .filter(F.col("_tables") == len(set(expected)))
        .orderBy(F.desc("committed_at"), F.desc("run_id"))
        .select("run_id", "committed_at")
        .limit(1)
    )


def run_history(steps: DataFrame) -> DataFrame:
    """One row per run out of the outcomes of its steps, as the run history keeps them.

    `steps`: run_id, step_no, step, at, message (NULL when the step went well), table_name and
    row_count (NULL for steps that count nothing). A run failed when its last step did; rows
    that a table counted before are kept. Counts shrink to one row per run and table, then to
    one map per run.
    """
    counted = (
        steps.filter("table_name IS NOT NULL")
        .groupBy("run_id", "table_name")
        .agg(F.sum("row_count").alias("row_count"))
        .groupBy("run_id")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("table_name", "row_count"))).alias(
                "row_counts"
            )
        )
    )
    error = F.when(F.col("message").isNotNull(), F.struct("step", "message"))
    none = F.create_map().cast("map<string,bigint>")
    return (
        steps.groupBy("run_id")
        .agg(
            F.min("at").alias("started_at"),
            F.max("at").alias("completed_at"),
            F.max_by(F.struct(error.alias("error")), "step_no").alias("_last"),
        )
        .join(counted, "run_id", "left")
        .select(
            "run_id",
            F.when(F.col("_last.error").isNull(), "success").otherwise("failed").alias("status"),
            "started_at",
            "completed_at",
            F.col("_last.error").alias("error"),
            F.coalesce("row_counts", none).alias("row_counts"),
        )
    )


def last_successful_run(history: DataFrame) -> DataFrame:
    """One row: when the last successful run completed (NULL when none did)."""
    return history.filter(F.col("status") == "success").agg(
        F.max("completed_at").alias("last_successful_run")
    )


def log_counts(log: DataFrame, order: str) -> DataFrame:
    """The last count per run and table that the log lines name; `log`: run_id, line, `order`.

    All other lines are noise, and so are counts of tables nobody expects.
    """

    def pick(pattern: str, table: int, count: int, tables: Sequence[str]) -> Column:
        name = F.regexp_extract("line", pattern, table)
        return F.when(
            name.isin(*tables),
            F.struct(
                name.alias("table_name"),
                F.regexp_extract("line", pattern, count).try_cast("bigint").alias("row_count"),
            ),
        )

    found = F.coalesce(
        pick(EXTRACTED, 2, 1, EXTRACTED_TABLES), pick(LOADED, 1, 2, LOADED_TABLES)
    )
    return (
        log.select("run_id", order, found.alias("_found"))
        .filter(F.col("_found").isNotNull())
        .groupBy("run_id", F.col("_found.table_name").alias("table_name"))
        .agg(F.max_by("_found.row_count", order).alias("row_count"))
    )
