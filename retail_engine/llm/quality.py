"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its words hashed to `BUCKETS` numbers, with damped counts of unit
length, statistics of its structure, each also as one of a few levels, and its recorded
length. The score is the logistic of a bias, a weight for each feature and a product of two
low-rank vectors for each pair, which the identity "square of the sum less sum of the
squares" gives in time linear in the features that are there.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_engine.llm.common import small_batches, stored

BUCKETS = 4096
RANK = 8
#: Labelled rows that the model is fitted on, at most; more are drawn by a hash of their id.
FITTED = 12_000
_LEVELS = 8
_EPOCHS = 12
_LEAST_STEPS = 400
_BATCH = 128

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_MARKS = (ord("!"), ord("|"), ord("."), ord(","), ord("#"), ord("$"), ord("%"), ord("*"))
#: Numbers that structure() gives: logarithms first, then shares between 0 and 1.
LOGS, SHARES = 4, 7 + len(_MARKS)
WIDTH = BUCKETS + (LOGS + SHARES) * (1 + _LEVELS)


def structure(text: bytes, words: list[bytes], counts: Counter, chars: int | None) -> np.ndarray:
    """Statistics of a text, all between 0 and 1; `chars` is its recorded length, if any."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    log = lambda x: min(1.0, math.log1p(x) / 14)
    letters = max(1, int(seen[_LETTER].sum()))
    first = sum(w[:1].isupper() for w in words)
    return np.array(
        [
            log(len(words)),
            log(size / n) * 3,
            log(len(lines)),
            log(chars if chars is not None and chars >= 0 else len(text)),
            seen[_UPPER].sum() / letters,
            seen[_DIGIT].sum() / size,
            (size - seen[_LETTER].sum() - seen[_DIGIT].sum() - seen[_SPACE].sum()) / size,
            len(counts) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            first / n,
            *(min(1.0, 4 * seen[m] / n) for m in _MARKS),
        ]
    ).clip(0, 1)


def features(text: bytes | None, chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features that are not zero; places are in order and distinct."""
    text = text or b""
    words = text.split()
    counts, hashed = Counter(words), Counter()
    for word, n in counts.items():
        hashed[zlib.crc32(word.lower()) % BUCKETS] += n
    places = np.array(sorted(hashed), np.int64)
    values = np.log1p(np.array([hashed[p] for p in places.tolist()], float))
    values /= max(1.0, math.sqrt(values @ values))
    stats = structure(text, words, counts, chars)
    level = np.minimum((stats * _LEVELS).astype(np.int64), _LEVELS - 1)
    # Shares are mostly small, so their levels are taken of the square root.
    fine = np.minimum((np.sqrt(stats[LOGS:]) * _LEVELS).astype(np.int64), _LEVELS - 1)
    level[LOGS:] = fine
    own = BUCKETS + np.arange(len(stats))
    levels = BUCKETS + len(stats) + np.arange(len(stats)) * _LEVELS + level
    return (
        np.concatenate([places, own, levels]),
        np.concatenate([values, stats, np.full(len(stats), 0.5)]),
    )


class Machine:
    """w0 + sum w x + sum over pairs (v_i . v_j) x_i x_j."""

    def __init__(self, width: int = WIDTH, rank: int = RANK, seed: int = 6):
        self.bias = 0.0
        self.weights = np.zeros(width)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (width, rank))

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        vx = self.factors[places] * values[:, None]
        pairs = 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        x = self.bias + float(self.weights[places] @ values) + pairs
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Logistic loss by mini-batches and Adam, with a little weight decay."""
        rng, rate, step = np.random.default_rng(7), 0.02, 0
        weights = np.concatenate([self.weights[:, None], self.factors], axis=1)
        mean, square, bias = np.zeros_like(weights), np.zeros_like(weights), self.bias
        batches = max(1, len(rows) // _BATCH)
        for _ in range(max(_EPOCHS, _LEAST_STEPS // batches)):
            for batch in np.array_split(rng.permutation(len(rows)), batches):
                x = np.zeros((len(batch), len(weights)))
                for i, r in enumerate(batch):
                    x[i, rows[r][0]] = rows[r][1]
                w, v = weights[:, 0], weights[:, 1:]
                xv, x2 = x @ v, x**2
                z = bias + x @ w + 0.5 * ((xv**2).sum(axis=1) - (x2 @ (v**2)).sum(axis=1))
                gap = (1 / (1 + np.exp(-z.clip(-30, 30))) - labels[batch]) / len(batch)
                slope = np.concatenate(
                    [
                        (x.T @ gap)[:, None],
                        x.T @ (gap[:, None] * xv) - (x2.T @ gap)[:, None] * v,
                    ],
                    axis=1,
                )
                slope += 1e-5 * weights
                step += 1
                mean = 0.9 * mean + 0.1 * slope
                square = 0.999 * square + 0.001 * slope**2
                near = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                weights = weights - rate * near
                bias -= rate * 5 * float(gap.sum())
        self.bias, self.weights, self.factors = bias, weights[:, 0].copy(), weights[:, 1:].copy()


def held_out(key: str) -> F.Column:
    """Rows that are never learnt from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    chars: str = "n_chars", limit: int = FITTED,
) -> Machine:
    """The model of labels.quality, from labelled rows that are not held out.

    Of more than `limit` such rows about as many are drawn, by a hash of their id, so the
    memory of the one task that fits is bounded. Without any row all scores are 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(~held_out(key) & F.col("quality").isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.min("quality").alias("_quality"))
    number = known.count()
    share = F.pmod(F.xxhash64(F.lit(6), key), F.lit(1_000_000)) / 1_000_000
    drawn = stored(known.where(share < limit / max(1, number)), "labelled")
    read = docs.select(
        F.col(key).alias("key"),
        F.col(text).cast("binary").alias("text"),
        F.col(chars).cast("long").alias("chars"),
    )
    rows = read.join(drawn.withColumnRenamed(key, "key"), "key")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                pickle.dumps((features(r["text"], r["chars"]), r["_quality"]))
                for r in batch.to_pylist()
            ]
            keys = batch.column("key").cast(pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary())], ["key", "row"])

    def learn(table: pa.Table) -> pa.Table:
        # Order the rows so that the fit does not depend on how they arrive.
        rows = sorted(zip(table["key"].to_pylist(), table["row"].to_pylist(), strict=True))
        rows = [pickle.loads(r) for _, r in rows]
        model = Machine()
        model.fit([x for x, _ in rows], np.array([y for _, y in rows], float))
        return pa.table({"model": pa.array([pickle.dumps(vars(model))], pa.binary())})

    samples = rows.mapInArrow(featured, "key string, row binary").withColumn("one", F.lit(1))
    found = samples.groupBy("one").applyInArrow(learn, "model binary").first()
    model = Machine()
    if found is not None:
        vars(model).update(pickle.loads(bytes(found["model"])))
    else:
        model.factors[:] = 0
    return model


def scored(
    docs: DataFrame, model: Machine, key: str = "doc_id", text: str = "text", chars: str = "n_chars"
) -> DataFrame:
    """key and score (0 to 1) of every row.

    A null text is an empty one, and an empty one has the score of its few statistics; a null
    recorded length is taken from the text. Equal rows have equal scores; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(text).cast("binary").alias("text"),
        F.col(chars).cast("long").alias("chars"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "chars"))
            scores = [model.score(*features(*row)) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(scores, pa.float64())], ["key", "score"]
            )

    schema = rows.select("key").schema.add("score", "double")
    return rows.mapInArrow(score, schema)
