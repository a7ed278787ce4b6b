"""Tables laid out in buckets of a key, so that joins and groupings by it move no rows.

    <path>/part-..._<bucket>.c000.parquet   one file per bucket, sorted by the key

Two tables in the same number of buckets of the same key meet bucket by bucket. A bucket is
then one task's work, which Spark cannot split: a table with a hot bucket is read as plain
files instead, and its joins shuffle, where AQE splits a hot key.
"""

from __future__ import annotations

import re
import statistics

from pyspark.sql import DataFrame, SparkSession

from retail_engine.sources import commits

BUCKETS = 64
#: A bucket is hot when it is so much larger than the median one, and no small one.
_HOT, _SMALL = 5, 64 << 20
_BUCKET = re.compile(r"_(\d{5})(?:\.c\d+)?\.")


def write(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write rows in buckets of `key`. The path must be new."""
    name = _name(path)
    dealt = rows.repartition(buckets, key)
    layout = dealt.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key)
    layout.format("parquet").option("path", path).saveAsTable(name)


def read(spark: SparkSession, path: str, schema, key: str, buckets: int = BUCKETS) -> DataFrame:
    """A table written in buckets, which any session knows by its path alone."""
    sizes: dict[int, int] = {}
    for file, size in commits.listed(spark, path).items():
        found = _BUCKET.search(file)
        if found:
            sizes[int(found[1])] = sizes.get(int(found[1]), 0) + size
    if sizes and max(sizes.values()) > max(_SMALL, _HOT * statistics.median(sizes.values())):
        return spark.read.schema(schema).parquet(path)
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) "
            f"SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def _name(path: str) -> str:
    return "buckets_" + re.sub(r"\W", "_", path)[-100:].lower()
