"""Log files of runs as a table of lines, and snapshots found by listing their folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The run of a log file: the name of its folder, or what it has after run_id=.
RUN_OF_PATH = r"/(?:run_id=)?([^/=]+)/[^/]+$"
#: Table, load date and run of a data file below the folder of raw snapshots.
_SNAPSHOT = r"/raw/([^/]+)/(\d{4}-\d{2}-\d{2})/([^/]+)/[^/]+\.parquet$"


def read_logs(spark: SparkSession, path: str, run_of_path: str = RUN_OF_PATH) -> DataFrame:
    """run_id, at and line of every log file below a folder.

    `at` orders the lines of a run: by file name, then by the place of the block that a task
    has read, then by the line in it. So a file may be split over tasks, and a run's log may
    go on in a file with a later name.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    # A task reads a block from its first line to its last, so its row numbers rise.
    at = F.struct(
        F.element_at(F.split(file, "/"), -1).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select(
        F.url_decode(F.regexp_extract(file, run_of_path, 1)).alias("run_id"),
        at.alias("at"),
        F.col("value").alias("line"),
    )


def landed_folders(spark: SparkSession, root: str) -> DataFrame:
    """The snapshots below <root>/raw that a listing finds, as rows of a manifest.

    A snapshot is as old as its latest data file. Contents are not read; files that are being
    written, markers and other files do not count. An empty or missing folder gives no rows.
    """
    path = f"{root}/raw"
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    if name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name):
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(path)
        )
    else:
        files = spark.createDataFrame([], schema)
    part = lambda n: F.regexp_extract("path", _SNAPSHOT, n)
    return (
        files.select("path", "modificationTime", "length")
        .filter(F.col("path").rlike(_SNAPSHOT))
        .groupBy(
            part(1).alias("table_name"), part(3).alias("run_id"),
            part(2).cast("date").alias("load_date"),
        )
        .agg(
            F.max("modificationTime").alias("committed_at"),
            F.sum("length").alias("bytes"),
        )
        .withColumn(
            "path",
            F.concat_ws(
                "/", F.lit("raw"), "table_name", F.col("load_date").cast("string"), "run_id"
            ),
        )
    )
