"""Spark session settings and the shared folder for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHARED = "spark.checkpoint.dir"

_open: list[list[str]] = []

# Runtime settings every job relies on. None of them fixes a partition count: AQE sizes
# shuffles from the cluster's own spark.sql.shuffle.partitions.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot order or product is split even when an aggregate on the same key follows the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "retail_engine") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a session on this machine alone, for tests and the bench, may go without one.
    """
    named = spark.conf.get(_SHARED, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_SHARED} to a folder all executors share")
    spark.conf.set(_SHARED, "file://" + tempfile.mkdtemp(prefix="retail-shared-"))
    return spark.conf.get(_SHARED)


@contextmanager
def working_tables() -> Iterator[list[str]]:
    """The folders of the tables checkpointed within the block, for remove() afterwards."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        made = _open.pop()
        if _open:
            _open[-1].extend(made)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` as a table to the shared folder and read on from there.

    So the rows outlive the executors that computed them, and Spark knows their size.
    """
    folder = f"{shared_folder(df.sparkSession)}/retail/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    if _open:
        _open[-1].append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete working tables that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
