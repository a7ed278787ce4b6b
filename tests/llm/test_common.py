from __future__ import annotations

import os
import time

import pyarrow as pa
from pyspark.sql import functions as F
from test_packing import PATTERN, RANKS

from retail_engine.llm import packing, pieces
from retail_engine.llm.common import begin
from retail_engine.llm.minhash import _sketches
from retail_engine.llm.packing import _encoded


def test_a_task_lets_go_what_other_operators_cached():
    packing._encoder(RANKS, PATTERN, ())
    begin(packing.__name__)
    assert packing._encoder.cache_info().currsize
    begin(pieces.__name__)
    assert not packing._encoder.cache_info().currsize


def test_words_of_packing_do_not_stay_beside_near_duplicates(spark, documents):
    docs = documents([(i, f"word{i} and others {i * i}", "en", "s") for i in range(400)])
    docs = docs.repartition(64)

    def seen(batches):
        for _ in batches:
            time.sleep(0.02)  # so that all workers take part
        kept = packing._encoder.cache_info().currsize
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "kept": [kept]})

    def holding():
        found = spark.range(0, 64, 1, 64).mapInArrow(seen, "pid long, kept long")
        return {r.pid for r in found.collect() if r.kept}

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    run(_encoded(docs, "doc_id", "text", RANKS, PATTERN, None))
    before = holding()
    run(_sketches(docs, "doc_id", "text", F.monotonically_increasing_id()))
    assert before and not holding() & before
