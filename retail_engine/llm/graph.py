"""Connected components of links as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_engine.llm.common import forget, observed


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges stored, with their number and a sum that tells one set from another."""
    return observed(edges, "edges", F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def components(links: DataFrame) -> DataFrame:
    """Stars of the links (a, b): one row (node, root) per linked node but the roots.

    The root is the smallest node of its component. Large-star and small-star alternate
    until nothing changes; minima are taken before any join, and each round's edges are
    written to the shared folder by one plan, whose write tells whether they changed: the
    driver keeps threads and blocks for every exchange of a plan.
    """
    edges, before = _written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a and b <> m")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b"))

        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u"))
        turned = F.when(F.col("b") == F.col("m"), F.struct(F.col("a"), F.col("m").alias("b")))
        turned = turned.otherwise(F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        # An edge (a, b) to another than the smallest b becomes (b, m); (a, m) itself stays.
        grown, after = _written(small.select(turned.alias("e")).select("e.a", "e.b").distinct())
        forget(edges)
        edges = grown
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
