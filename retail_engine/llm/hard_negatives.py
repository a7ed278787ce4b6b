"""Hard negatives of anchor vectors, by exact integer scores.

Components become integers. Their scores with all anchors are matrix products modulo a few
small primes, in single precision, where every sum is an exact integer; Chinese remaindering
gives the signed score. Anchors and rows meet in cells, a bounded block of the one against a
bounded stripe of the other: cells of one label for the positives, cells of all rows for the
negatives. A cell hands on no more rows for an anchor than its result may have, and the best
of them over all cells are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_engine.llm import vectors
from retail_engine.llm.common import stored

#: Anchors and rows of a cell at most, on average; and anchors scored at a time.
BLOCK, STRIPE, _AT_A_TIME = 2048, 4096, 128
#: Squared lengths of integer vectors are below this, so that sums of doubles are exact.
_LONGEST = 1 << 53
_SINGLE = 1 << 24
_LARGEST_PRIME = 251


def primes_for(most: int) -> list[int]:
    """Primes from 251 down whose product tells all integers from -most to most apart."""
    found, n = [], _LARGEST_PRIME
    while not found or math.prod(found) < 2 * most + 1:
        if all(n % k for k in range(2, math.isqrt(n) + 1)):
            found.append(n)
        n -= 1
    return found


def _residues(q: np.ndarray, p: int) -> np.ndarray:
    """q modulo p, from -(p // 2) to p // 2."""
    return ((q + p // 2) % p - p // 2).astype(np.float32)


class Rows:
    """Integer vectors as residues of each prime, to be multiplied with others."""

    def __init__(self, q: np.ndarray, primes: list[int]):
        self.primes, self.residues = primes, [_residues(q, p) for p in primes]

    def scores(self, other: Rows, start: int, end: int) -> np.ndarray:
        """Inner products of rows start to end with all rows of `other`, as long."""
        total, product = None, 1
        for p, a, b in zip(self.primes, self.residues, other.residues, strict=True):
            # As many products as stay exact in single precision.
            step = max(1, _SINGLE // max(1, (p // 2) ** 2))
            found = np.zeros((len(a[start:end]), len(b)), np.int64)
            for at in range(0, a.shape[1], step):
                part = a[start:end, at : at + step] @ b[:, at : at + step].T
                found = (found + part.astype(np.int64)) % p
            if total is None:
                total = found
            else:
                total = total + product * ((found - total % p) * pow(product, -1, p) % p)
            product *= p
        return np.where(total > product // 2, total - product, total)


def _quantised(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """Replace `vector` by q, floor(scale * x) of every component, and its squared length."""
    kept = [f for f in rows.schema if f.name != "vector"]
    schema = T.StructType(
        [
            *kept,
            T.StructField("q", T.ArrayType(T.IntegerType())),
            T.StructField("squared", T.LongType()),
        ]
    )

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                q = np.floor(scale * vectors.matrix(batch.column("vector"), width))
                squared = (q * q).sum(axis=1)
            fits = squared < _LONGEST
            q, batch = q[fits].astype(np.int32), batch.filter(pa.array(fits))
            ends = pa.array(np.arange(len(q) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in kept],
                    pa.ListArray.from_arrays(ends, pa.array(q.ravel())),
                    pa.array(squared[fits].astype(np.int64)),
                ],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(quantise, schema)


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    flat = table["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), width)


def _in_order(table: pa.Table) -> pa.Table:
    """By key, those without one last, and row number: the order among equal scores."""
    keys = [("key", "ascending"), ("row_id", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))


def _best(scores: np.ndarray, allowed: np.ndarray, number: int) -> np.ndarray:
    """Places of the highest allowed scores, the first of equal ones first."""
    places = np.flatnonzero(allowed)
    if len(places) > 4 * number:
        # Nothing below the last score that can count needs to be sorted.
        own = scores[places]
        places = places[own >= np.partition(own, -number)[-number]]
    return places[np.argsort(-scores[places], kind="stable")[:number]]


def _dealt(
    anchors: DataFrame, rows: DataFrame, stripes: Column, blocks: Column, by: list[str]
) -> tuple:
    """Both sides grouped by cell: every anchor with every row of the same `by`."""
    spread = F.xxhash64("row_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cell = [*by, "_block", "_stripe"]
    # Columns of their own, since both sides come from one table.
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    left = anchors.withColumn("_block", F.pmod(spread, blocks)).withColumn("_stripe", every(stripes))
    right = rows.withColumn("_stripe", F.pmod(spread, stripes)).withColumn("_block", every(blocks))
    return left.groupBy(*cell), right.groupBy(*cell)


def _positives(table: DataFrame, width: int, primes: list[int], number: int) -> DataFrame:
    """row_id of every anchor, with the row, key and score of its first rows of the same label."""
    sizes = table.groupBy("label").agg(F.count("*").alias("_rows"), F.sum("anchor").alias("_asked"))
    sizes = sizes.where("_asked > 0").select(
        F.col("label").alias("_label"),
        F.ceil(F.col("_rows") / STRIPE).alias("_stripes"),
        F.ceil(F.col("_asked") / BLOCK).alias("_blocks"),
    )
    rows = table.join(sizes, F.col("label") == F.col("_label")).drop("_label")
    key = table.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("row_id", T.LongType()),
            T.StructField("positive_row", T.LongType()),
            T.StructField("positive_key", key),
            T.StructField("score", T.LongType()),
        ]
    )
    names = ["row_id", "key", "label", "q", "_stripes", "_blocks"]
    left, right = _dealt(
        rows.where("anchor = 1").select(*names),
        rows.select(*names),
        F.col("_stripes"),
        F.col("_blocks"),
        ["label"],
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = _in_order(right)
        ids, others = left["row_id"].to_numpy(), right["row_id"].to_numpy()
        a, b = Rows(_matrix(left, width), primes), Rows(_matrix(right, width), primes)
        asked, taken, found = [], [], []
        for start in range(0, len(ids), _AT_A_TIME):
            scores = a.scores(b, start, min(start + _AT_A_TIME, len(ids)))
            for own, anchor in zip(scores, ids[start:], strict=False):
                best = _best(own, others != anchor, number)
                asked.append(np.full(len(best), anchor))
                taken.append(best)
                found.append(own[best])
        taken = np.concatenate([np.empty(0, np.int64), *taken])
        return pa.table(
            {
                "row_id": np.concatenate([np.empty(0, np.int64), *asked]),
                "positive_row": others[taken],
                "positive_key": right["key"].take(pa.array(taken)),
                "score": np.concatenate([np.empty(0, np.int64), *found]),
            }
        )

    pairs = left.cogroup(right).applyInArrow(meet, schema)
    order = [F.desc("score"), F.asc_nulls_last("positive_key"), F.asc("positive_row")]
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(*order))
    return pairs.withColumn("_place", place).where(F.col("_place") <= number).drop("_place")


def mined(
    table: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `anchor` says of a row of `table` whether it is an anchor. Its positives are the first
    other rows of its label; for each, the first rows of other labels whose score is within
    `window`, in percent of the positive's, are returned. Scores are inner products of
    floor(scale * x); higher ones come first, then smaller keys, rows without a key last.

    Rows with a null label or vector, or a null or non-finite component, take no part. Nor do
    those whose integer vector has a squared length of 2^53 or more. Shorter vectors are filled
    up with zeros. Rows that share a key or are equal count one by one: each is an anchor, a
    positive or a negative of its own. A positive with a negative score has no negatives. An
    empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    rows = table.select(
        F.col(key).alias("key"),
        F.col(label).alias("label"),
        F.col(vector).alias("vector"),
        F.coalesce(anchor, F.lit(False)).cast("int").alias("anchor"),
    ).where(F.col("label").isNotNull() & vectors.finite(F.col("vector")))
    key_type = rows.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("anchor_row", T.LongType()),
            T.StructField("positive_row", T.LongType()),
            T.StructField("negative_row", T.LongType()),
            T.StructField("anchor_id", key_type),
            T.StructField("positive_id", key_type),
            T.StructField("negative_id", key_type),
            T.StructField("positive_score", T.LongType()),
            T.StructField("negative_score", T.LongType()),
        ]
    )
    result = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    width = vectors.width(rows, "vector")
    rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    rows = stored(_quantised(rows, width, scale), "integer-vectors")
    number, asked, most = rows.agg(F.count("*"), F.sum("anchor"), F.max("squared")).first()
    if not asked:
        none = spark.createDataFrame([], schema)
        return none.withColumn("rank", F.lit(0)).select(*result)
    primes = primes_for(most)
    near = stored(_positives(rows, width, primes, positives), "positives")
    near = near.groupBy("row_id").agg(
        F.collect_list(F.struct("positive_row", "positive_key", "score")).alias("near")
    )
    left, right = _dealt(
        rows.where("anchor = 1").join(near, "row_id").select("row_id", "key", "label", "q", "near"),
        rows.select("row_id", "key", "label", "q"),
        F.lit(-(-number // STRIPE)).cast("long"),
        F.lit(-(-asked // BLOCK)).cast("long"),
        [],
    )
    low, high = window

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = _in_order(right)
        labels = pa.concat_tables([left.select(["label"]), right.select(["label"])])
        codes = labels["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        mine, others = codes[: len(left)], codes[len(left) :]
        a, b = Rows(_matrix(left, width), primes), Rows(_matrix(right, width), primes)
        near = left["near"].to_pylist()
        picked, pairs, found = [], [], []
        for start in range(0, len(left), _AT_A_TIME):
            scores = a.scores(b, start, min(start + _AT_A_TIME, len(left)))
            for i, own in enumerate(scores, start):
                other = others != mine[i]
                for at, positive in enumerate(near[i]):
                    score = positive["score"]
                    allowed = other & (100 * own >= low * score) & (100 * own <= high * score)
                    best = _best(own, allowed, negatives)
                    picked.append(best)
                    pairs += [(i, at)] * len(best)
                    found.append(own[best])
        picked = pa.array(np.concatenate([np.empty(0, np.int64), *picked]))
        anchors = pa.array([i for i, _ in pairs], pa.int64())
        chosen = [near[i][at] for i, at in pairs]
        return pa.table(
            [
                left["row_id"].take(anchors),
                pa.array([c["positive_row"] for c in chosen], pa.int64()),
                right["row_id"].take(picked),
                left["key"].take(anchors),
                pa.array([c["positive_key"] for c in chosen], left["key"].type),
                right["key"].take(picked),
                pa.array([c["score"] for c in chosen], pa.int64()),
                pa.array(np.concatenate([np.empty(0, np.int64), *found])),
            ],
            names=[f.name for f in schema],
        )

    candidates = left.cogroup(right).applyInArrow(meet, schema)
    order = [F.desc("negative_score"), F.asc_nulls_last("negative_id"), F.asc("negative_row")]
    of_pair = Window.partitionBy("anchor_row", "positive_row").orderBy(*order)
    ranked = candidates.withColumn("rank", F.row_number().over(of_pair))
    return ranked.where(F.col("rank") <= negatives).select(*result)
