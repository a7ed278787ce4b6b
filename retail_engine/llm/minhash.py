"""Near-duplicate documents by fast similarity sketching.

In each round every shingle is thrown into one of `COORDINATES` bins by that round's hash; a
bin keeps the least (round, value) it got, and from round `COORDINATES` on round i throws all
shingles into bin i - COORDINATES, so every coordinate fills whatever the size of the set.
Equal coordinates are as likely as the similarity, and more concentrated than independent
minima.

Bands of four coordinates give the candidates: a pair of similarity 0.75 shares none of the
25 bands with probability 8e-5. Two bits of every coordinate then tell pairs that are far
below the threshold: a pair at 0.75 differs in 192 of 1,024 places, and in more than 242 with
probability 4e-5. Every candidate that can still join two components is confirmed on the
full shingle sets. Texts of equal words are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_engine.llm.common import begin, lists, observed, small_batches, stored
from retail_engine.llm.graph import components

WORDS = 5
PERCENT = 75
BANDS = 25
ROWS = 4
COORDINATES = 1024
#: Candidates differ in so many of the coordinates' two bits at most.
MOST_APART = 242
#: Members of a bucket are first compared with so many pivots of it.
PIVOTS = 4

_PIECE = 50_000  # words hashed at once
_LONG_WORD = 1024
_U = np.uint64
_NONE = np.empty(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes, and their sketches."""

    def __init__(self, words: int = WORDS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words = words
        self.bytes = rng.integers(0, 2**64, 256, dtype=_U)
        self.base = _U(int(rng.integers(0, 2**62)) * 4 + 1)
        self.inverse = _U(pow(int(self.base), -1, 2**64))
        self.seeds = rng.integers(0, 2**64, 2 * COORDINATES, dtype=_U)
        self.powers = self.inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 16)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, base, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))

    @staticmethod
    def normal(text: bytes | None) -> list[bytes]:
        """Words with A-Z lowered; a word beyond 1024 bytes stands as its digest."""
        words = (text or b"").lower().split()
        if words and max(map(len, words)) > _LONG_WORD:
            words = [
                w if len(w) <= _LONG_WORD else b"\0" + hashlib.blake2b(w).hexdigest().encode()
                for w in words
            ]
        return words

    @staticmethod
    def digest(words: list[bytes]) -> bytes:
        return hashlib.blake2b(b" ".join(words), digest_size=16).digest()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """The distinct shingles; fewer words than one needs are one shingle together."""
        if not words:
            return np.empty(0, _U)
        k = min(self.words, len(words))
        found = []
        for i in range(0, len(words) - k + 1, _PIECE):
            text = np.frombuffer(b" ".join(words[i : i + _PIECE + k - 1]), np.uint8)
            self._grow(len(text) + 1)
            sums = np.zeros(len(text) + 1, _U)
            np.cumsum(self.bytes[text] * self.powers[: len(text)], out=sums[1:])
            spaces = np.flatnonzero(text == 32)
            starts = np.concatenate(([0], spaces + 1))
            ends = np.concatenate((spaces, [len(text)]))
            starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
            found.append((sums[ends] - sums[starts]) * self.inverses[starts])
        return np.unique(_mix(np.concatenate(found)))

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """Each coordinate's least (round, value), as round << 48 | value."""
        t, none = COORDINATES, _U(2**64 - 1)
        out = np.full(t, none, _U)
        step = max(1, 8 * t // len(hashes))
        for first in range(0, 2 * t, step):
            rounds = np.arange(first, min(first + step, 2 * t), dtype=_U)[:, None]
            x = _mix(hashes[None, :] ^ self.seeds[rounds.ravel().astype(np.int64)][:, None])
            bins = ((x >> _U(32)) * _U(t)) >> _U(32)
            bins = np.where(rounds < t, bins, rounds - _U(t)).ravel().astype(np.int64)
            values = ((rounds << _U(48)) | (x & _U(0xFFFFFFFF))).ravel()
            np.minimum.at(out, bins, values)
            if not (out == none).any():
                break
        return out

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sketch's band hashes, and two bits of each coordinate packed into longs."""
        sketch = self.sketch(hashes)
        pairs = _mix(sketch)[None, :] >> np.array([[0], [1]], _U) & _U(1)
        bits = np.packbits(pairs.astype(np.uint8)).view(np.int64)
        rows = sketch[: BANDS * ROWS].reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=_U)
        for j in range(ROWS):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, j])
        return key.view(np.int64), bits


def _sketches(docs: DataFrame, key: str, text: str, at) -> DataFrame:
    """Per row: at (its place in the input), key, digest, n_shingles, bands, bits."""
    rows = docs.select(
        at.alias("at"),
        F.col(key).alias("key"),
        F.col(text).cast("binary").alias("text"),
    )
    schema = T.StructType(
        [
            T.StructField("at", T.LongType()),
            T.StructField("key", rows.schema["key"].dataType),
            T.StructField("digest", T.BinaryType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("bits", T.ArrayType(T.LongType())),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        shingler = Shingler()
        for batch in batches:
            digests, sizes, bands, bits = [], [], [], []
            for body in batch.column("text").to_pylist():
                words = shingler.normal(body)
                hashes = shingler.shingles(words)
                digests.append(shingler.digest(words))
                sizes.append(len(hashes))
                found = shingler.candidates(hashes) if len(hashes) else (_NONE, _NONE)
                bands.append(found[0])
                bits.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("at"),
                    batch.column("key"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    lists(bands, np.int64),
                    lists(bits, np.int64),
                ],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(sketch, schema)


def _sets(docs: DataFrame, text: str, at, nodes: DataFrame) -> DataFrame:
    """Full shingle sets of the given nodes (places of rows)."""
    rows = docs.select(at.alias("at"), F.col(text).cast("binary").alias("text"))
    rows = rows.join(nodes, F.col("at") == F.col("node"), "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        shingler = Shingler()
        for batch in batches:
            sets = [
                shingler.shingles(shingler.normal(body)).view(np.int64)
                for body in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), lists(sets, np.int64)], names=["node", "hashes"]
            )

    return rows.mapInArrow(shingle, "node long, hashes array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those similar enough on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    n, m = F.size("x"), F.size("y")
    size = sets.select(F.col("node").alias("b"), F.size("hashes").alias("m"))
    # Sets of too unequal sizes cannot link; that is seen before the second set is joined.
    near = pairs.join(size, "b").join(left, "a")
    near = near.where(100 * F.least(n, F.col("m")) >= percent * F.greatest(n, F.col("m")))
    both = near.drop("m").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (n + m - common)).select("a", "b")


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    row_id: str | None = None,
) -> DataFrame:
    """One row per row of `docs`: at, key, n_shingles, component_id, kept, root.

    component_id is the smallest key that links reach, the own one included; kept tells
    whether it is the own key. `at` is the column `row_id`, unique numbers, or else the row's
    place in the input, which must be read from files, as it is scanned twice. root is the
    smallest `at` of a component, null for rows without shingles. Null and wordless texts have no
    shingles and link with nothing; rows of equal words are one class whatever their keys,
    and may share a key. Null keys are larger than any other: a class of null keys alone
    has a null component_id and is kept. An empty table gives no rows.

    In a bucket, members are compared with a few pivots first. Pairs that the links found
    so far have already connected need no comparison; all others are compared, so no
    component is missed however large a bucket is, and a bucket of near copies costs a
    few comparisons a member instead of all its pairs.
    """
    small_batches(docs.sparkSession)
    at = F.col(row_id) if row_id else F.monotonically_increasing_id()
    rows = stored(_sketches(docs, key, text, at), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("digest")
    classes = stored(
        classes.agg(
            F.min("at").alias("node"),
            F.min("key").alias("key"),
            F.first("bands").alias("bands"),
            F.first("bits").alias("bits"),
        ),
        "classes",
    )
    members = classes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = shared.where("lo < hi").select("bucket")
    members = stored(members.join(shared, "bucket", "left_semi"), "members")
    sets = stored(_sets(docs, text, at, members.select("node").distinct()), "shingle-sets")

    # Pivots: the least number of each bucket after flipping bits, invertible and cheap to sum up.
    masks = [0] + [int(m) for m in np.random.default_rng(7).integers(0, 2**62, PIVOTS - 1)]
    pivots = members.groupBy("bucket").agg(
        *[F.min(F.col("node").bitwiseXOR(F.lit(m))).alias(f"p{i}") for i, m in enumerate(masks)]
    )
    pivots = pivots.select(
        "bucket",
        F.array_distinct(
            F.array(*[F.col(f"p{i}").bitwiseXOR(F.lit(m)) for i, m in enumerate(masks)])
        ).alias("pivots"),
    )
    tried = members.join(pivots, "bucket").select("node", F.explode("pivots").alias("pivot"))
    tried = tried.where("node <> pivot").select(*_ordered("node", "pivot")).distinct()
    tried = stored(tried, "pairs")
    roots = components(_confirmed(tried, sets, percent))

    root = F.coalesce("root", "node").alias("root")
    labelled = members.join(roots, "node", "left").select("bucket", "node", root)
    sizes = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.max_by("root", "n").alias("main")
    )
    mixed = mixed.where("parts > 1").select("bucket", "main")
    sketch = classes.select("node", "bands", "bits")
    labelled = labelled.join(mixed, "bucket").join(sketch, "node")
    labelled = stored(labelled.withColumn("rest", F.col("root") != F.col("main")), "open-buckets")
    few = labelled.where("rest").select(
        "bucket", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "bands", "bits")]
    )
    # Each pair comes up once: in the least of its buckets, and from one side.
    half = COORDINATES // 64
    differ = [F.get("bits", i).bitwiseXOR(F.get("x_bits", i)) for i in range(2 * half)]
    apart = [F.bit_count(x.bitwiseOR(y)) for x, y in zip(differ[:half], differ[half:], strict=True)]
    once = ~F.col("rest") | (F.col("node") < F.col("x_node"))
    least = F.array_min(F.array_intersect("bands", "x_bands")) == F.col("x_bucket")
    meet = (F.col("bucket") == F.col("x_bucket")) & (F.col("root") != F.col("x_root")) & once
    meet = meet & (sum(apart[1:], apart[0]) <= MOST_APART) & least
    rest = labelled.join(few.withColumnRenamed("bucket", "x_bucket"), meet)
    rest = rest.select(*_ordered("node", "x_node")).join(tried, ["a", "b"], "left_anti")
    rest, (number,) = observed(rest, "pairs")
    if number:
        links, (number,) = observed(_confirmed(rest, sets, percent), "links")
    if number:
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(links.union(stars))

    named = classes.drop("bands", "bits").join(roots, "node", "left")
    named = named.select("digest", "key", root)
    least = named.groupBy("root").agg(F.min("key").alias("component_id"))
    named = named.join(least, "root").select("digest", "root", "component_id")
    linked = rows.drop("bands", "bits").join(named, "digest", "left")
    component = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("key"))
    linked = linked.select("at", "key", "n_shingles", component.alias("component_id"), "root")
    kept = F.col("key").eqNullSafe(F.col("component_id"))
    return linked.select("at", "key", "n_shingles", "component_id", kept.alias("kept"), "root")
