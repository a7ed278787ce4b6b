from __future__ import annotations

import pytest
from pyspark.sql import types as T
from samples import ODD

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("record", T.StringType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("kept", T.StringType()),
        T.StructField("node", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Write documents (id, text, lang, source) with extra columns to files and read them."""

    def write(rows):
        rows = [
            (i, t, lang, src, None if t is None else len(t), "r", 1, "k", "n")
            for i, t, lang, src in rows
        ]
        path = str(tmp_path_factory.mktemp("documents") / "table")
        spark.createDataFrame(rows, DOCS).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
