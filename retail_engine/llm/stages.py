"""The operators as filters and rewrites of a documents table, for the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_engine.llm import minhash, mixing, outliers, surrogates
from retail_engine.llm.common import numbered, unpacked

_WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _spare(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one if the documents have such a column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def of_quality(docs: DataFrame) -> DataFrame:
    """The documents that the quality rules keep."""
    return unpacked(outliers.quality_rules(docs).where("kept"), docs.columns)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; all without words.

    Of equal ids in a component the row that comes first stays.
    """
    row_id = _spare(docs, "row_id")
    rows = numbered(docs, row_id)
    found = minhash.near_duplicates(rows, row_id=row_id)
    single = found.where("root is null").select("at")
    first = found.where("root is not null and kept").groupBy("root").agg(F.min("at").alias("at"))
    kept = single.union(first.select("at")).withColumnRenamed("at", row_id)
    return rows.join(kept, row_id, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_personal_data(docs: DataFrame, secret: str) -> DataFrame:
    """The documents with surrogates; n_chars follows the new texts."""
    found = unpacked(surrogates.replaced(docs, secret).select("record"), docs.columns)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def at_target_weights(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    row_id, copies, nth = (_spare(docs, n) for n in ("row_id", "copies", "nth"))
    rows = numbered(docs, row_id)
    units = rows.select(
        F.col(row_id).alias("row_id"),
        F.col("doc_id").alias("key"),
        "source",
        words_in("text").alias("size"),
    )
    taken = mixing.mixed(units).where("copies > 0")
    taken = taken.select(F.col("row_id").alias(row_id), F.col("copies").alias(copies))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    again = rows.join(taken, row_id).withColumn(nth, each)
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
