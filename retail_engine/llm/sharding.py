"""Two-pass external shuffle of documents into shards.

Pass one scatters the records over buckets by a seeded hash, so many that each fits into a
task's memory. Pass two shuffles each bucket by Fisher-Yates and writes it. The buckets, one
after the other, are a random order of all rows; equal stretches of it are the shards, whose
row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_engine.llm.common import packed, seeded_hash, shared_folder, stored, with_offsets


def shuffle_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 20_240,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = 16 << 20,
    path: str | None = None,
) -> DataFrame:
    """Write `docs` in random order to `shards` folders and return what was written.

    Columns: record (a struct of every column of `docs`, whatever their names), shard, slot
    (place in the shard, gapless from 0). `path` defaults to a new shared folder.

    The order depends on seed and key alone as long as keys differ. Rows that share a key
    (or have none) also take their place in the input into the hash, so that a key with a
    third of all rows spreads over all buckets. Null texts count as one byte; an empty
    table gives an empty result; a text longer than a bucket is a bucket of its own size.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "shards")
    record = packed(docs)
    total = docs.select((F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).alias("b")).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")
    ).first()
    buckets = max(1, -(-total["bytes"] // bucket_bytes))

    at = F.monotonically_increasing_id().alias("_at")
    rows = docs.select(record, F.col(key).alias("_key"), at)
    rows = seeded_hash(rows, "_key", "_at", seed, "_hash")
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))

    counts = rows.groupBy("_bucket").count()
    offsets = stored(with_offsets(counts, "_bucket", "count", "_offset").drop("count"), "offsets")
    scattered = rows.select("_bucket", "_hash", "record").join(offsets, "_bucket")
    out = T.StructType(
        [scattered.schema["record"], T.StructField("_place", T.LongType(), False)]
    )

    def fisher_yates(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(list(batches)).combine_chunks()
        hashes = bucket["_hash"].to_numpy()
        order = np.argsort(hashes, kind="stable")
        np.random.default_rng([seed, key[0].as_py()]).shuffle(order)
        first = bucket["_offset"][0].as_py()
        shuffled = bucket.select(["record"]).take(pa.array(order))
        places = pa.array(np.arange(first, first + len(order)))
        yield from shuffled.append_column("_place", places).combine_chunks().to_batches(5_000)

    placed = scattered.groupBy("_bucket").applyInArrow(fisher_yates, out)
    shard = F.expr(f"(_place * {shards}L) div {max(1, total['rows'])}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {total['rows']}L + {shards - 1}L) div {shards}L")
    placed = placed.select("record", "shard", (F.col("_place") - first).alias("slot"))
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select("record", "shard", "slot")
