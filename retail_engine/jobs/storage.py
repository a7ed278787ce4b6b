"""Upkeep of the committed tables: compaction, and changes that rewrite only the files they touch.

A table of the log is a set of files, each with the smallest and largest key in it. All jobs
write new files and commit the exchange; the old ones stay for readers that began before.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_engine import session
from retail_engine.operators import changes
from retail_engine.schemas import KEY_BUCKETS, KEY_INDEX, LAID_OUT_BY, STORED, conform
from retail_engine.sources import commits, snapshots
from retail_engine.sources.commits import Commit, Conflict, File, State

#: Size of a data file that is worth a task of its own.
TARGET = 128 << 20
#: So many keys of a batch are looked up in the index by the driver; beyond, all files between
#: the smallest and the largest key are asked.
_KEYS_LOOKED_UP = 10_000


def write_clustered(
    spark: SparkSession, root: str, table: str, rows: DataFrame, files: int
) -> tuple[File, ...]:
    """Write rows by key into about so many files."""
    key, path = LAID_OUT_BY[table], f"data/{table}/{uuid.uuid4().hex}"
    spread = conform(rows, STORED[table]).repartitionByRange(max(1, files), key)
    spread.sortWithinPartitions(key).write.parquet(f"{root}/{path}")
    return described(spark, root, table, path)


def described(spark: SparkSession, root: str, table: str, path: str) -> tuple[File, ...]:
    """The files of a written folder with their rows and key ranges; files without rows go."""
    key = LAID_OUT_BY[table]
    name = F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name")
    written = spark.read.schema(STORED[table]).parquet(f"{root}/{path}")
    ranges = (
        written.select(key, name, F.col("_metadata.file_size").alias("bytes"))
        .groupBy("name", "bytes")
        .agg(F.count(key).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
    )
    # One row per file.
    return tuple(
        File(table, f"{path}/{r.name}", r.bytes, r.rows, r.low, r.high) for r in ranges.collect()
    )


def _exchanged(
    spark: SparkSession, root: str, attempts: int, work: Callable[[State], Commit | None]
) -> Commit | None:
    """Commit what `work` makes of the state; after a conflict, once more on the new one."""
    for attempt in range(attempts):
        state = commits.read(spark, root)
        change = work(state)
        if change is None:
            return None
        try:
            commits.commit(spark, root, state, change)
            return change
        except Conflict:
            folders = {f"{root}/{f.path.rsplit('/', 1)[0]}" for f in change.files}
            session.remove(spark, folders)
            if attempt + 1 == attempts:
                raise
    raise ValueError("attempts must be positive")


def compact(
    spark: SparkSession, root: str, table: str, at: datetime, target: int = TARGET, attempts: int = 20
) -> Commit | None:
    """Pack the small files of a table into files of about the target size, then sum up the log.

    Files of half the target or more stay as they are, so a row is rewritten seldom. Batches
    committed meanwhile are left for the next time. None when there is nothing to pack.
    """

    def work(state: State) -> Commit | None:
        small = [f for f in state.of(table) if f.bytes < target / 2]
        if len(small) < 2:
            return None
        rows = snapshots.read_files(spark, root, table, small)
        files = -(-sum(f.bytes for f in small) // target)
        if table in KEY_INDEX:
            files = KEY_BUCKETS
            if len(small) <= 2 * KEY_BUCKETS:
                return None
        return Commit(
            kind="compact",
            at=at,
            files=write_clustered(spark, root, table, rows, files),
            gone=tuple(f.path for f in small),
            same_rows=True,
        )

    change = _exchanged(spark, root, attempts, work)
    if change is not None:
        commits.checkpoint(spark, root)
    return change


def adopt(
    spark: SparkSession, root: str, table: str, at: datetime, files: int | None = None, attempts: int = 20
) -> Commit | None:
    """Take the newest snapshot of a table, and what the commits have added, over into files by
    key, so that rows can be changed in place. Snapshots landed later do not change it. Keys
    that are to be unique get an index in hash buckets, which intake looks at from then on."""

    def work(state: State) -> Commit | None:
        if table in state.adopted:
            return None
        own = state.of(table)
        rows = snapshots.current_tables(spark, root, state)[table]
        landed = set(rows.inputFiles())
        size = sum(
            length
            for folder in {f.rsplit("/", 1)[0] for f in landed}
            for length in commits.listed(spark, folder).values()
        )
        new = write_clustered(spark, root, table, rows, files or -(-size // TARGET))
        indexes = [name for name, (of, _) in KEY_INDEX.items() if of == table]
        for name in indexes:
            keys = snapshots.key_rows(rows, name)
            new += write_clustered(spark, root, name, keys, KEY_BUCKETS)
        return Commit(
            kind="adopt",
            at=at,
            files=new,
            gone=tuple(f.path for f in own),
            same_rows=True,
            adopted=(table, *indexes),
        )

    return _exchanged(spark, root, attempts, work)


def touched(
    spark: SparkSession, root: str, table: str, files: Sequence[File], keys: DataFrame
) -> list[File]:
    """The files that hold one of the keys. The index rules most out; the rest are asked for
    their key column alone."""
    key = LAID_OUT_BY[table]
    keys = keys.select(F.col(key).alias("_key")).distinct()
    few = sorted(r[0] for r in keys.limit(_KEYS_LOOKED_UP + 1).collect() if r[0] is not None)
    if len(few) > _KEYS_LOOKED_UP:
        low, high = keys.agg(F.min("_key"), F.max("_key")).first()
        near = [f for f in files if f.low <= high and f.high >= low]
    else:
        near = [
            f for f in files if bisect.bisect_left(few, f.low) < bisect.bisect_right(few, f.high)
        ]
    if not near:
        return []
    rows = snapshots.read_files(spark, root, table, near)
    hit = rows.select(key, F.col("_metadata.file_path").alias("_path"))
    hit = hit.join(keys, F.col(key) == F.col("_key"), "left_semi").select("_path").distinct()
    # A path as Spark gives it is encoded; the last two parts are letters and digits.
    names = {tuple(r[0].rsplit("/", 2)[1:]) for r in hit.collect()}
    return [f for f in near if tuple(f.path.rsplit("/", 2)[1:]) in names]


def _rewritten(
    spark: SparkSession,
    root: str,
    table: str,
    at: datetime,
    keys: DataFrame,
    merged: Callable[[DataFrame], DataFrame],
    kind: str,
    attempts: int,
) -> Commit | None:
    adopt(spark, root, table, at)

    def work(state: State) -> Commit | None:
        hit = touched(spark, root, table, state.of(table), keys)
        rows = merged(snapshots.read_files(spark, root, table, hit))
        new = write_clustered(spark, root, table, rows, len(hit))
        if not new and not hit:
            return None
        gone = list(hit)
        if new:
            rows = snapshots.read_files(spark, root, table, new)
        old = snapshots.read_files(spark, root, table, hit)
        for name, (of, _) in KEY_INDEX.items():
            if of == table and name in state.adopted:
                added, replaced = _reindexed(spark, root, name, state, old, rows)
                new += added
                gone += replaced
        return Commit(
            kind=kind,
            at=at,
            files=new,
            gone=tuple(f.path for f in gone),
            # A key that comes in meanwhile would be there twice, or left.
            reads=(table,),
        )

    return _exchanged(spark, root, attempts, work)


def _reindexed(
    spark: SparkSession, root: str, index: str, state: State, old: DataFrame, new: DataFrame
) -> tuple[tuple[File, ...], list[File]]:
    """New files of a key index, and those they replace, when rows `old` become `new`."""
    before, after = (snapshots.key_rows(rows, index) for rows in (old, new))
    lost, won = before.exceptAll(after), after.exceptAll(before)
    # At most as many numbers as there are buckets.
    buckets = {r.bucket for r in lost.select("bucket").distinct().collect()}
    hit = [f for f in state.of(index) if any(f.low <= b <= f.high for b in buckets)]
    if not hit and won.isEmpty():
        return (), []
    kept = snapshots.read_files(spark, root, index, hit).join(lost, ["bucket", "key"], "left_anti")
    rows = kept.select("bucket", "key").unionByName(won)
    return write_clustered(spark, root, index, rows, max(1, len(hit))), hit


def upsert_rows(
    spark: SparkSession, root: str, table: str, new: DataFrame, at: datetime, attempts: int = 20
) -> Commit | None:
    """Put rows in by key as changes.upsert does, rewriting only the files with one of the keys.

    Rows with a new key are written beside them. `new` is read more than once.
    """
    key, as_of = LAID_OUT_BY[table], f"{at:%Y-%m-%d %H:%M:%S}"

    def merged(old: DataFrame) -> DataFrame:
        return changes.upsert(old, new, key, as_of)

    return _rewritten(spark, root, table, at, new, merged, "upsert", attempts)


def delete_rows(
    spark: SparkSession, root: str, table: str, keys: DataFrame, at: datetime, attempts: int = 20
) -> Commit | None:
    """Delete rows by key, rewriting only the files with one of them."""
    key = LAID_OUT_BY[table]

    def merged(old: DataFrame) -> DataFrame:
        return old.join(keys.select(key), key, "left_anti")

    return _rewritten(spark, root, table, at, keys, merged, "delete", attempts)


#: The parts of a path that name a whole snapshot, version, batch or rewrite.
_UNIT = r"^/((?:raw/[^/]+/[^/]+/[^/]+)|(?:warehouse/[^/]+)|(?:intake/[^/]+/[^/]+)|(?:data/[^/]+/[^/]+))/"


def sweep(spark: SparkSession, root: str, before: datetime) -> list[str]:
    """Delete what nothing names and nobody can be reading: folders that failed runs and tries
    left, last written before a time, and files that a commit has replaced before it.

    Returns the paths below `root` that went. A run that is not finished must be younger.
    """
    unit = lambda c: F.regexp_extract(F.concat(F.lit("/"), c, F.lit("/")), _UNIT, 1)
    below = commits.qualified(spark, root)
    state = commits.read(spark, root)
    log = commits.history(spark, root)
    named = [
        snapshots.manifest(spark, root).select("path"),
        snapshots.published(spark, root).select("path"),
        log.select(F.explode("files.path").alias("path")),
        log.select(F.explode(F.map_values("paths")).alias("path")),
    ]
    units = reduce(DataFrame.unionAll, named).select(unit(F.col("path")).alias("unit")).distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    written = (
        files.option("pathGlobFilter", "*.parquet")
        .load(root)
        .filter(F.col("path").startswith(f"{below}/"))
        .select(
            unit(F.substr("path", F.lit(len(below) + 2))).alias("unit"), "modificationTime"
        )
        .groupBy("unit")
        .agg(F.max("modificationTime").alias("at"))
        .filter((F.col("unit") != "") & (F.col("at") < F.lit(before)))
    )
    left = [r.unit for r in written.join(units, "unit", "left_anti").collect()]
    replaced = log.filter(F.col("at") < F.lit(before)).select(F.explode("gone").alias("path"))
    gone = [r.path for r in replaced.distinct().collect() if r.path not in state.files]
    present = [p for p in gone if commits.exists(spark, f"{root}/{p}")]
    session.remove(spark, [f"{root}/{p}" for p in [*left, *present]])
    return sorted([*left, *present])
