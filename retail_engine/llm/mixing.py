"""Mix of sources at target weights by balanced sampling (cube method).

A source's target over its size says how often each of its documents is taken on average:
the whole part surely, the fraction as an inclusion probability. The flight moves the
probabilities of three documents at a time along the null space of the constraints (number
of documents, number of words) until one of them is 0 or 1, so both totals stay as they
are. It runs in blocks of bounded size and leaves a dozen documents of each open. Those meet
in fewer blocks, until a source has one; the landing of its last dozen takes the outcome with
the words nearest to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_engine.llm.common import seeded_hash, stored
from retail_engine.operators.ranking import with_position

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 4000
#: Documents that each flight leaves open, few enough for the landing to try all outcomes.
LANDING = 12
_ALMOST = 1e-9


def flight(
    sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator, leave: int = 0
) -> np.ndarray:
    """Chances after the flight phase, which keeps both sums.

    All are 0 or 1 but for the last `leave`, or two at most if none are to be left.
    """
    draws = iter(rng.random(len(chances) + 2).tolist())
    size, chance = sizes.tolist(), chances.astype(float).tolist()
    chance = [float(round(c)) if not _ALMOST < c < 1 - _ALMOST else c for c in chance]
    waiting = [i for i, c in enumerate(chance) if 0 < c < 1]
    active: list[int] = []

    def settle() -> None:
        for i in [i for i in active if chance[i] < _ALMOST or chance[i] > 1 - _ALMOST]:
            chance[i] = float(round(chance[i]))
            active.remove(i)

    def move(step: list[tuple[int, float]]) -> None:
        up = down = float("inf")
        for i, u in step:
            if u:
                room, depth = (1 - chance[i], chance[i]) if u > 0 else (chance[i], 1 - chance[i])
                up, down = min(up, room / abs(u)), min(down, depth / abs(u))
        way = up if next(draws) * (up + down) < down else -down
        for i, u in step:
            chance[i] += way * u
        settle()

    for done, i in enumerate(waiting):
        if len(active) + len(waiting) - done <= leave:
            return np.array(chance)
        active.append(i)
        if len(active) == 3:
            a, b, c = active
            null = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            move(list(zip(active, null if any(null) else (1, -1, 0), strict=True)))
    if len(active) == 2 and size[active[0]] == size[active[1]]:
        move([(active[0], 1), (active[1], -1)])
    return np.array(chance)


def landing(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """The few open chances as 0 or 1: the words nearest to those expected, then the documents."""
    out, rest = chances.copy(), np.flatnonzero((chances > 0) & (chances < 1))
    ways = (np.arange(2 ** len(rest))[:, None] >> np.arange(len(rest))) & 1
    gap = ways - chances[rest]
    words, docs = np.abs(gap @ sizes[rest]).round(6), np.abs(gap.sum(axis=1)).round(6)
    out[rest] = ways[np.lexsort((docs, words))[0]]
    return out


def _fly(seed: int, level: int):
    """The flight over one block, in the order of the hashes; a source's only block also lands."""

    def fly(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches)).combine_chunks()
        block = block.take(pa.array(np.argsort(block["hash"].to_numpy(), kind="stable")))
        place, number = (k.as_py() for k in key)
        land = block["blocks"][0].as_py() == 1
        sizes, chances = block["size"].to_numpy().astype(float), block["chance"].to_numpy()
        rng = np.random.default_rng([seed, level, place, number])
        chances = flight(sizes, chances, rng, LANDING)
        chances = landing(sizes, chances) if land else chances
        block = block.select(["row_id", "place", "size", "chance", "hash"])
        block = block.set_column(3, "chance", pa.array(chances))
        yield from block.combine_chunks().to_batches()

    return fly


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source its place in code point order (from 1, null last), docs, source_size, target.

    The weights repeat over the places and share the size of all sources; a target above
    `most` times its source's size stops there, and what is left over is shared by weight
    again until no target is above. Each round reads one row of sums.
    """
    sources = rows.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("size").alias("source_size")
    )
    placed = with_position(sources, [F.col("source").asc_nulls_last()], "place")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    placed = stored(placed.withColumn("weight", weight), "sources")
    cap = most * F.col("source_size")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    stopped, share = -1, 0.0
    while True:
        full = F.lit(share) * F.col("weight") >= cap if stopped >= 0 else F.lit(False)
        row = placed.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if row[0] == stopped:
            break
        stopped, share = row[0], (total - row[1]) / row[2] if row[2] else 0.0
    target = F.when(full, cap.cast("double")).otherwise(F.lit(share) * F.col("weight"))
    return placed.select("source", "place", "docs", "source_size", target.alias("target"))


def mixed(rows: DataFrame, seed: int = 9, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """How often each row is taken: row_id, key, source, size, source_size, target, copies.

    `rows` is a stored table of row_id (unique), key, source and size. Equal rows are drawn
    each on its own, empty texts (size 0) count as documents only, a null source is one
    source. Which rows are drawn depends on seed, keys and sizes; rows that share a key also
    bring their row_id in. An empty table gives no rows.
    """
    goals = stored(targets(rows, weights), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < _ALMOST, F.round(ratio)).otherwise(ratio)
    hashed = seeded_hash(rows, "key", "row_id", seed, "hash")
    goals = goals.withColumnRenamed("source", "_source")
    units = hashed.join(goals, hashed["source"].eqNullSafe(F.col("_source")))
    units = units.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio"))
    units = units.withColumn("chance", F.col("ratio") - F.col("whole"))
    units = stored(units.drop("_source", "ratio"), "units")

    levels, open_units = [], units.select("row_id", "place", "size", "chance", "hash")
    last = False
    while not last:
        counts = open_units.groupBy("place").agg(F.count("*").alias("n"))
        blocks = F.ceil(F.col("n") / BLOCK)
        counts = stored(counts.select("place", blocks.alias("blocks")), "blocks")
        last = (counts.agg(F.max("blocks")).first()[0] or 1) == 1
        # Another level, another block: the hash is stirred with the level.
        stirred = F.xxhash64(F.lit(len(levels)), "hash")
        dealt = open_units.join(counts, "place").withColumn("block", F.pmod(stirred, "blocks"))
        flown = dealt.groupBy("place", "block").applyInArrow(
            _fly(seed, len(levels)), "row_id long, place long, size long, chance double, hash long"
        )
        levels.append(stored(flown, "flight"))
        open_units = levels[-1].where("chance > 0 and chance < 1")
    settled = [x.where("chance = 0 or chance = 1").select("row_id", "chance") for x in levels]
    drawn = settled[0]
    for more in settled[1:]:
        drawn = drawn.union(more)
    copies = (F.col("whole") + F.col("drawn")).cast("long").alias("copies")
    return units.join(drawn.withColumnRenamed("chance", "drawn"), "row_id").select(
        "row_id", "key", "source", "size", "source_size", "target", copies
    )
