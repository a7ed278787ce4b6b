"""Landed snapshots and published warehouse versions under one root folder.

    <root>/raw/<table>/<load date>/<run id>/    one snapshot, never overwritten
    <root>/manifest/                            one row per landed snapshot
    <root>/warehouse/<run id>/<table>/          one version of the star schema
    <root>/published/                           one row per published version
    <root>/runs/                                one row per finished run
    <root>/intake/<batch id>/<try>/<table>/     accepted rows of a batch, and its rejections

Data is written first and named in the manifest afterwards, so a reader never meets a
half-written table and a failed job leaves nothing that counts. The manifests take one
writer at a time; run ids must be new. Batches go into the log of commits beside them
(`commits.py`), which takes several writers.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retail_engine import session
from retail_engine.functions import text
from retail_engine.operators import runs
from retail_engine.schemas import (
    KEY_BUCKETS,
    KEY_INDEX,
    MANIFEST,
    OPERATIONAL,
    PRIMARY_KEY,
    PUBLISHED,
    RUNS,
    STORED,
    WAREHOUSE,
    conform,
)
from retail_engine.sources import commits
from retail_engine.sources.commits import Commit, Conflict, File, State


class MissingSnapshots(Exception):
    """Tables without any snapshot, or runs without a complete set."""


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _append(spark: SparkSession, path: str, schema: StructType, rows: list[Row]) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/manifest", MANIFEST)


def published(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/published", PUBLISHED)


def run_history(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/runs", RUNS)


def add_run(spark: SparkSession, root: str, row: Row) -> None:
    _append(spark, f"{root}/runs", RUNS, [row])


def write_counted(df: DataFrame, path: str) -> int:
    """Write `df` and return its number of rows, counted by the write itself.

    An empty table still gets a file, and with it a schema.
    """
    return _write_seen(df, path, F.lit(0))[0]


def _write_seen(df: DataFrame, path: str, key: Column) -> tuple[int, int, int]:
    """Write `df`; its number of rows, its smallest and largest `key` (0 when it is empty)."""
    seen, none = Observation(), F.lit(0)
    facts = [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.min(key), none).alias("smallest"),
        F.coalesce(F.max(key), none).alias("largest"),
    ]
    df.observe(seen, *facts).write.mode("errorifexists").parquet(path)
    return seen.get["rows"], seen.get["smallest"], seen.get["largest"]


def land(
    df: DataFrame, root: str, table: str, run_id: str, load_date: date, committed_at: datetime
) -> Row:
    """Write one snapshot and return its manifest row, which is not yet recorded."""
    path = f"raw/{table}/{load_date:%Y-%m-%d}/{run_id}"
    row_count, _, largest = _write_seen(
        conform(df, OPERATIONAL[table]), f"{root}/{path}", F.col(PRIMARY_KEY[table])
    )
    return Row(
        table_name=table,
        run_id=run_id,
        load_date=load_date,
        committed_at=committed_at,
        path=path,
        row_count=row_count,
        largest_id=largest,
    )


def record(spark: SparkSession, root: str, landed: list[Row]) -> None:
    _append(spark, f"{root}/manifest", MANIFEST, landed)


def _load(spark: SparkSession, root: str, paths: dict[str, str]) -> dict[str, DataFrame]:
    absent = [table for table in OPERATIONAL if table not in paths]
    if absent:
        raise MissingSnapshots(f"no snapshot of: {', '.join(absent)}")
    return {
        table: spark.read.schema(schema).parquet(f"{root}/{paths[table]}")
        for table, schema in OPERATIONAL.items()
    }


def latest_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The newest snapshot of each table on its own; runs may mix."""
    newest = runs.latest_snapshot(manifest(spark, root))
    return _load(spark, root, {r.table_name: r.path for r in newest.collect()})


def run_tables(spark: SparkSession, root: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """The tables one run landed; by default the newest run that landed all of them."""
    landed = manifest(spark, root)
    if run_id is None:
        newest = runs.latest_complete_run(landed).first()
        if newest is None:
            raise MissingSnapshots("no run has landed every table")
        run_id = newest.run_id
    rows = landed.filter(F.col("run_id") == run_id).collect()
    return _load(spark, root, {r.table_name: r.path for r in rows})


def write_version(star: dict[str, DataFrame], root: str, run_id: str) -> dict[str, int]:
    """Write the warehouse tables of one version; returns their row counts."""
    return {
        name: write_counted(conform(star[name], schema), f"{root}/warehouse/{run_id}/{name}")
        for name, schema in WAREHOUSE.items()
    }


def publish(
    spark: SparkSession, root: str, run_id: str, at: datetime, row_counts: dict[str, int]
) -> None:
    """Make a written version the one readers get."""
    row = Row(
        run_id=run_id, published_at=at, path=f"warehouse/{run_id}", row_counts=row_counts
    )
    _append(spark, f"{root}/published", PUBLISHED, [row])


def current_star(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The warehouse tables published last; a build in progress does not disturb readers."""
    newest = (
        published(spark, root)
        .orderBy(F.desc("published_at"), F.desc("run_id"))
        .select("path")
        .first()
    )
    if newest is None:
        raise MissingSnapshots("no warehouse version has been published")
    return {
        name: spark.read.schema(schema).parquet(f"{root}/{newest.path}/{name}")
        for name, schema in WAREHOUSE.items()
    }


def batches(spark: SparkSession, root: str) -> DataFrame:
    return commits.batches(spark, root)


def data_files(
    spark: SparkSession, root: str, table: str, path: str, low: int, high: int
) -> list[File]:
    """The data files of a written folder, whose keys lie from `low` to `high`."""
    return [
        File(table, f"{path}/{name}", size, None, low, high)
        for name, size in commits.listed(spark, f"{root}/{path}").items()
        if name.endswith(".parquet")
    ]


def commit_batch(
    spark: SparkSession,
    root: str,
    batch_id: str,
    at: datetime,
    rows: dict[str, DataFrame],
    rejected: DataFrame,
    state: State | None = None,
    reads: Sequence[str] = (),
) -> Row:
    """Write the rows that a batch adds to each table, and its rejections, then name them all
    in one commit: readers see the whole batch or nothing of it.

    The batch was judged on `state` and depends on the rows of the tables in `reads`; when
    another commit has changed one of these, what was written goes again and Conflict is raised.
    """
    state = state or commits.read(spark, root)
    if batches(spark, root).where(F.col("batch_id") == batch_id).count():
        raise ValueError(f"batch {batch_id} is already committed")
    # Another attempt at the same batch has a folder of its own.
    base, counts, largest, files = f"intake/{batch_id}/{uuid.uuid4().hex}", {}, {}, []
    for table, new in rows.items():
        path, key = f"{base}/{table}", F.col(PRIMARY_KEY[table])
        conformed = conform(new, OPERATIONAL[table])
        counts[table], low, largest[table] = _write_seen(conformed, f"{root}/{path}", key)
        if counts[table]:
            files += data_files(spark, root, table, path, low, largest[table])
        for index in (i for i, (of, _) in KEY_INDEX.items() if of == table and i in state.adopted):
            keys = conform(key_rows(new, index), STORED[index])
            path = f"{base}/{index}"
            number, low, high = _write_seen(keys, f"{root}/{path}", F.col("bucket"))
            files += data_files(spark, root, index, path, low, high) if number else []
    counts["rejected"] = write_counted(rejected, f"{root}/{base}/rejected")
    change = Commit(
        kind="batch",
        at=at,
        files=tuple(files),
        reads=tuple(reads),
        batch_id=batch_id,
        paths={name: f"{base}/{name}" for name in counts},
        row_counts=counts,
        largest_ids=largest,
    )
    try:
        commits.commit(spark, root, state, change)
    except Conflict:
        session.remove(spark, [f"{root}/{base}"])
        raise
    return Row(
        batch_id=batch_id,
        committed_at=at,
        paths=change.paths,
        row_counts=counts,
        largest_ids=largest,
    )


def read_files(spark: SparkSession, root: str, table: str, files: Sequence[File]) -> DataFrame:
    """The rows of some data files of a table."""
    if not files:
        return spark.createDataFrame([], STORED[table])
    return spark.read.schema(STORED[table]).parquet(*(f"{root}/{f.path}" for f in files))


def _bucket(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS))


def key_rows(rows: DataFrame, index: str) -> DataFrame:
    """The rows of a key index for rows of its table."""
    key = F.col(KEY_INDEX[index][1])
    return rows.filter(key.isNotNull()).select(_bucket(key).alias("bucket"), key.alias("key"))


def keys_near(
    spark: SparkSession, root: str, index: str, state: State, asked: DataFrame
) -> DataFrame:
    """The taken keys of all buckets into which the trimmed keys of a batch fall, under the
    name of their column. Files of other buckets are not opened."""
    column = KEY_INDEX[index][1]
    near = asked.select(_bucket(text.trimmed(column)).alias("bucket")).distinct()
    # At most as many numbers as there are buckets.
    buckets = sorted(r.bucket for r in near.collect())
    files = [
        f for f in state.of(index)
        if bisect.bisect_left(buckets, f.low) < bisect.bisect_right(buckets, f.high)
    ]
    rows = read_files(spark, root, index, files).filter(F.col("bucket").isin(buckets))
    return rows.select(F.col("key").alias(column))


def taken(spark: SparkSession, root: str, table: str, state: State | None = None) -> DataFrame:
    """The rows of a table that the commits hold, by default as of now."""
    state = state or commits.read(spark, root)
    return read_files(spark, root, table, state.of(table))


def current_tables(
    spark: SparkSession, root: str, state: State | None = None
) -> dict[str, DataFrame]:
    """The newest snapshot of each table with the rows of the commits; of an adopted table
    these alone."""
    state = state or commits.read(spark, root)
    landed = {} if state.adopted >= set(OPERATIONAL) else latest_tables(spark, root)
    return {
        name: taken(spark, root, name, state)
        if name in state.adopted
        else landed[name].unionByName(taken(spark, root, name, state))
        for name in OPERATIONAL
    }


def last_ids(spark: SparkSession, root: str) -> dict[str, int]:
    """The largest id each table was given so far, out of the manifests alone."""
    landed = manifest(spark, root).select("table_name", "largest_id")
    added = batches(spark, root).select(F.explode("largest_ids").alias("table_name", "largest_id"))
    largest = landed.unionAll(added).groupBy("table_name").agg(F.max("largest_id").alias("n"))
    return dict.fromkeys(OPERATIONAL, 0) | {r.table_name: r.n or 0 for r in largest.collect()}
