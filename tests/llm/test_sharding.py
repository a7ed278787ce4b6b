from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from retail_engine.llm.queries import op1_external_shuffle
from retail_engine.llm.sharding import shuffle_shards

SMALL = "/root/testdata/sf0.001"


def _places(df):
    return sorted((r.shard, r.slot, r.record.doc_id or -1) for r in df.collect())


def test_shards_are_even_and_gapless(spark):
    rows = op1_external_shuffle(spark, SMALL).collect()
    shards = Counter(r.shard for r in rows)
    assert set(shards) == set(range(16)) and max(shards.values()) - min(shards.values()) <= 1
    for shard, n in shards.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    want = {(r[0], r[1]) for r in given.select("doc_id", crc).collect()}
    assert {(r.doc_id, r.text_crc32) for r in rows} == want


def test_order_follows_the_seed_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = _places(shuffle_shards(docs, shards=4, seed=1, bucket_bytes=50_000))
    # The same rows from other files and tasks.
    again = _places(shuffle_shards(docs.repartition(7), shards=4, seed=1, bucket_bytes=50_000))
    assert first == again
    assert first != _places(shuffle_shards(docs, shards=4, seed=2, bucket_bytes=50_000))


def test_a_key_of_many_rows_spreads_over_all_shards(documents):
    docs = documents([(1, "same", "en", "a")] * 300 + [(i, "x", "en", "a") for i in range(2, 300)])
    rows = shuffle_shards(docs, shards=8, bucket_bytes=200).collect()
    hot = Counter(r.shard for r in rows if r.record.doc_id == 1)
    assert len(hot) == 8 and max(hot.values()) < 75


def test_odd_rows(odd, empty):
    rows = shuffle_shards(odd, shards=3).collect()
    assert len(rows) == 10 and {r.record.kept for r in rows} == {"k"}
    assert shuffle_shards(empty).count() == 0
