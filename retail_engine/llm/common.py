"""Shared helpers: tables in the cluster's shared folder, row numbers, prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from retail_engine import session

#: Words of a text: runs of anything but space and the control characters 0x09 to 0x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"

_BLOCK = 4096

_working: list[list[str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that all executors share."""
    return f"{session.shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table to the shared folder, to read on from there."""
    path = shared_folder(df.sparkSession, name)
    if _working:
        _working[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, *facts: Column) -> tuple[DataFrame, tuple]:
    """`df` stored, with its number of rows and other aggregates, which the write itself takes."""
    seen = Observation()
    named = [x.alias(f"fact{i}") for i, x in enumerate(facts)]
    table = stored(df.observe(seen, F.count("*").alias("rows"), *named), name)
    found = seen.get
    return table, (found.get("rows", 0), *[found.get(f"fact{i}") for i in range(len(facts))])


@contextlib.contextmanager
def working_tables() -> Iterator[list[str]]:
    """The folders of the tables stored within the block, for session.remove() later."""
    _working.append([])
    try:
        yield _working[-1]
    finally:
        _working.pop()


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        session.remove(table.sparkSession, {f.rsplit("/", 1)[0] for f in table.inputFiles()})


def packed(docs: DataFrame, name: str = "record"):
    """All columns of `docs` as one struct, so that no name clashes with an operator's own."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "record") -> DataFrame:
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in columns])


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """`df` stored with a number that no two rows share, not even equal ones."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def with_offsets(counts: DataFrame, key: str, count: str, offset: str) -> DataFrame:
    """Each key 0, 1, 2, ... with the sum of the counts before it.

    Two levels: sums within blocks of keys, and over the blocks, so that no task sees all keys.
    """
    block = F.floor(F.col(key) / _BLOCK)
    tops = counts.groupBy(block.alias("_block")).agg(F.sum(count).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_block", block)
        .withColumn("_within", F.coalesce(F.sum(count).over(inner), F.lit(0)))
        .join(tops, "_block")
        .withColumn(offset, F.col("_base") + F.col("_within"))
        .drop("_block", "_base", "_within")
    )


def words_of(text) -> F.Column:
    """The words of a whole text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    """Arrays of one kind of number as an Arrow column of lists."""
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate([np.empty(0, kind), *arrays]).astype(kind, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand rows to Python in batches that stay small when they hold long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system.

    Spark uses a worker again for other tasks, beside an executor that needs the memory.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def begin(operator: str) -> None:
    """A task of the module `operator` begins: what others have cached in this worker goes."""
    found = [
        cached
        for name, module in list(sys.modules.items())
        if name.startswith("retail_engine.llm.") and name != operator
        for cached in vars(module).values()
        if hasattr(cached, "cache_clear") and cached.__module__ == name
    ]
    found = [cached for cached in found if cached.cache_info().currsize]
    for cached in found:
        cached.cache_clear()
    if found:
        give_back()


def seeded_hash(rows: DataFrame, key: str, at: str, seed: int, name: str) -> DataFrame:
    """Add a hash of seed and key; rows that share a key, or have none, hash `at` as well.

    So the hash does not depend on how the input lies in files, as long as keys differ, and
    a key of very many rows still spreads evenly.
    """
    again = rows.groupBy(F.col(key).alias("_same")).count().where("count > 1")
    again = stored(again.select("_same", F.lit(True).alias("_again")), "repeated-keys")
    rows = rows.join(again, rows[key].eqNullSafe(again["_same"]), "left")
    nth = F.when(F.col("_again") | F.col(key).isNull(), F.col(at)).otherwise(F.lit(-1))
    return rows.withColumn(name, F.xxhash64(F.lit(seed), key, nth)).drop("_same", "_again")
