"""Near-duplicate vectors by NN-descent.

Vectors are compared within their label only. Equal vectors are one class from the start. A
first neighbour graph comes from sign codes of random projections, as many that two vectors
at the limit hardly ever miss each other in all of them; then the neighbours of neighbours of
each vector are compared and its list keeps the nearest, round after round. A list that is
full of linked vectors is saturated: it is enlarged to all saturated vectors that it reaches,
compared block by block. An audit compares sampled vectors with all others, counts all their
links, and asks for another round while too many are missing; after the last one, all vectors
of a label are compared in blocks.

All cosines are of doubles. Edges below `FLOOR` lead nowhere near a link and are not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_engine.llm.common import stored
from retail_engine.llm.graph import components

LIMIT = 0.93
FLOOR = 0.5
#: Length of the neighbour lists.
NEIGHBOURS = 10
#: Chance that two vectors at the limit share none of a round's codes, and vectors a bucket.
MISSED = 0.001
TABLES = 10
BUCKET = 48
CHUNK = 96
BLOCK = 512
DESCENTS = 2
MOST_ROUNDS = 5
#: The audit asks for the links of so many vectors, each time more until it has met enough
#: links, and for the share of them that must have been found.
AUDITED = (256, 2048, 16_384)
ENOUGH = 300
RECALL = 0.98

_GROUPS = 64  # lists of neighbours that one call compares


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length, in doubles; all of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _pairs(found: list[tuple]) -> pa.Table:
    empty = np.empty(0, np.int64)
    a = np.concatenate([empty, *[x[0] for x in found]])
    b = np.concatenate([empty, *[x[1] for x in found]])
    cos = np.concatenate([np.empty(0), *[x[2] for x in found]])
    return pa.table({"a": pa.array(a), "b": pa.array(b), "cos": pa.array(cos)})


def _nearest(nodes: np.ndarray, unit: np.ndarray) -> tuple:
    """Of every node its nearest others above the floor, and all that it links with."""
    cos = unit @ unit.T
    np.fill_diagonal(cos, -1)
    keep = cos >= LIMIT
    k = min(NEIGHBOURS, len(nodes) - 1)
    if k > 0:
        best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        near = np.zeros_like(keep)
        np.put_along_axis(near, best, True, axis=1)
        keep |= near & (cos >= FLOOR)
    keep &= nodes[:, None] != nodes[None]
    i, j = np.nonzero(keep)
    return nodes[i], nodes[j], cos[i, j]


def _classes(vectors: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows (at, key, node) and the classes of equal vectors (node, part, vector, size, key)."""
    numbers = F.col("vector").cast("array<double>")
    norm = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x * x)
    sound = F.col("part").isNotNull() & F.col("vector").isNotNull()
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = sound & ~F.exists("vector", odd)
    rows = vectors.select(
        F.monotonically_increasing_id().alias("at"),
        F.col(key).alias("key"),
        F.col(label).alias("part"),
        F.col(vector).alias("vector"),
    )
    sound = F.coalesce(sound & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = stored(rows.withColumn("sound", sound), "vectors")
    classes = rows.where("sound").groupBy("part", "vector").agg(
        F.min("at").alias("node"), F.count("*").alias("size"), F.min("key").alias("key")
    )
    # Only vectors of one length can be compared, so the length is part of the part.
    part = F.xxhash64("part", F.size("vector"))
    members = stored(classes, "vector-classes")
    doubles = F.col("vector").cast("array<double>").alias("vector")
    classes = members.select("node", part.alias("part"), doubles, "size", "key")
    named = members.select("part", "vector", "node")
    at = rows.where("sound").join(named, ["part", "vector"]).select("at", "key", "node")
    rest = rows.where("not sound").select("at", "key", F.lit(None).cast("long").alias("node"))
    return at.union(rest), stored(classes, "classes")


def tables_for(bits: int) -> int:
    """How many codes of so many bits leave two vectors at the limit apart in all of them with
    the chance MISSED. A bit is equal with a chance that the angle gives."""
    together = (1 - math.acos(LIMIT) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(MISSED) / math.log1p(-together))) if bits else 1


def _first_edges(classes: DataFrame, seed: int) -> DataFrame:
    """Edges between vectors that share a sign code, compared in chunks of bounded size."""
    parts = classes.groupBy("part").agg(F.count("*").alias("n"))
    bits = F.least(F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BUCKET))), F.lit(40))
    bits = bits.cast("int")
    rows = classes.join(stored(parts.select("part", bits.alias("bits")), "parts"), "part")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            part, bits = batch.column("part").to_numpy(), batch.column("bits").to_numpy()
            sizes = batch.column("vector").value_lengths().to_numpy()
            found = []
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                unit = _unit(batch.column("vector").take(pa.array(at)))
                for wanted in np.unique(bits[at]).tolist():
                    own = np.flatnonzero(bits[at] == wanted)
                    for t in range(tables_for(wanted)):
                        if (size, t) not in planes:
                            rng = np.random.default_rng([seed, size, t])
                            planes[size, t] = rng.normal(size=(size, 40))
                        signs = unit[own] @ planes[size, t][:, :wanted] > 0
                        codes = (signs * (1 << np.arange(wanted))).sum(axis=1)
                        these = at[own]
                        found.append((nodes[these], part[these], np.full(len(own), t), codes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[i] for f in found])) for i in range(4)],
                ["node", "part", "tbl", "code"],
            )

    coded = rows.select("node", "part", "bits", "vector")
    coded = stored(coded.mapInArrow(code, "node long, part long, tbl long, code long"), "codes")
    buckets = coded.groupBy("part", "tbl", "code").agg(F.count("*").alias("n")).where("n > 1")
    chunk = F.pmod(F.xxhash64("node", "tbl"), F.ceil(F.col("n") / CHUNK))
    dealt = coded.join(buckets, ["part", "tbl", "code"]).withColumn("chunk", chunk)
    dealt = dealt.join(classes.select("node", "vector"), "node")

    def compare(table: pa.Table) -> pa.Table:
        vectors = table["vector"].combine_chunks()
        return _pairs([_nearest(table["node"].to_numpy(), _unit(vectors))])

    chunks = dealt.select("part", "tbl", "code", "chunk", "node", "vector")
    return chunks.groupBy("part", "tbl", "code", "chunk").applyInArrow(
        compare, "a long, b long, cos double"
    )


def _trimmed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) found, both ways, and the lists: each vector's nearest edges."""
    edges = stored(edges.groupBy("a", "b").agg(F.max("cos").alias("cos")), "edges")
    near = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    lists = edges.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= NEIGHBOURS)
    return edges.where(F.col("cos") >= LIMIT), stored(lists.drop("nth"), "lists")


def _descent(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the neighbours of each vector, in either direction of the lists."""
    both = lists.union(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    both = both.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    near = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    both = both.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= 2 * NEIGHBOURS)
    vectors = classes.select(F.col("node").alias("b"), "vector")
    blocks = F.pmod(F.xxhash64("a"), F.lit(max(1, math.ceil(classes.count() / _GROUPS))))
    joined = both.select(blocks.alias("block"), "a", "b").join(vectors, "b")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("a")
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        vectors = table["vector"].combine_chunks()
        cuts = np.flatnonzero(np.diff(a)) + 1
        found = []
        for i, j in zip(np.append(0, cuts).tolist(), np.append(cuts, len(a)).tolist(), strict=True):
            if j - i > 1:
                found.append(_nearest(b[i:j], _unit(vectors.slice(i, j - i))))
        return _pairs(found)

    joined = joined.select("block", "a", "b", "vector")
    return joined.groupBy("block").applyInArrow(compare, "a long, b long, cos double")


def _audit(classes: DataFrame, counted: DataFrame, audited: int) -> tuple[int, int]:
    """(found, there) links of a bounded set of vectors that were compared with all others."""
    # The first so many by a hash; that many rows are all that leaves the tasks.
    asked = classes.orderBy(F.xxhash64(F.lit(11), "node"), "node").limit(audited)
    asked = asked.select("node", "part", "vector").toArrow()
    if not len(asked):
        return 0, 0
    nodes, parts = asked["node"].to_numpy(), asked["part"].to_numpy()
    sizes = asked["vector"].combine_chunks().value_lengths().to_numpy()
    vectors, units = asked["vector"].combine_chunks(), {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        units[size] = at, _unit(vectors.take(pa.array(at)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(nodes), np.int64)
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for size, (at, unit) in units.items():
                own = np.flatnonzero(lengths == size)
                if len(own):
                    cos = unit @ _unit(batch.column("vector").take(pa.array(own))).T >= LIMIT
                    cos &= parts[at][:, None] == batch.column("part").to_numpy()[own][None]
                    cos &= nodes[at][:, None] != batch.column("node").to_numpy()[own][None]
                    total[at] += cos @ batch.column("size").to_numpy()[own]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], ["node", "n"])

    rows = classes.select("node", "part", "vector", "size")
    there = rows.mapInArrow(count, "node long, n long")
    there = there.groupBy("node").agg(F.sum("n").alias("n"))
    both = there.join(counted.select("node", "linked"), "node")
    row = both.agg(F.sum(F.least("linked", "n")), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def _complete(classes: DataFrame, counted: DataFrame) -> bool:
    """Whether enough of the links are there. The audit widens until it has met some hundreds;
    where even the widest meets fewer, the chance that the codes leave has to do."""
    number = classes.count()
    for audited in AUDITED:
        found, there = _audit(classes, counted, audited)
        if there >= ENOUGH or audited >= number:
            break
    return found >= RECALL * there


def _all_links(classes: DataFrame) -> DataFrame:
    """Every link, by comparing all vectors of a label in blocks."""
    counts = classes.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = classes.join(stored(counts, "blocks"), "part")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = rows.select("part", "node", "vector", "own", other)
    dealt = dealt.select(
        "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "node", "vector",
    )

    def compare(table: pa.Table) -> pa.Table:
        nodes, unit = table["node"].to_numpy(), _unit(table["vector"].combine_chunks())
        cos = unit @ unit.T
        keep = (cos >= LIMIT) & (nodes[:, None] != nodes[None])
        i, j = np.nonzero(keep)
        return _pairs([(nodes[i], nodes[j], cos[i, j])])

    found = dealt.groupBy("part", "i", "j").applyInArrow(compare, "a long, b long, cos double")
    return stored(found.groupBy("a", "b").agg(F.max("cos").alias("cos")), "all-links")


def _enlarged(saturated: DataFrame, classes: DataFrame) -> DataFrame:
    """Per saturated vector (node, root) the rows it links with among those of its root."""
    rows = saturated.join(classes.select("node", "vector", "size"), "node")
    counts = rows.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    counts = stored(counts, "blocks")
    rows = rows.join(counts, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = stored(rows, "saturated")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = rows.select("root", "node", "vector", "size", "own", other)
    # A pair of blocks meets once, with both blocks' vectors.
    dealt = dealt.select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "node", "vector", "size",
    )

    def count(table: pa.Table) -> pa.Table:
        nodes, sizes = table["node"].to_numpy(), table["size"].to_numpy()
        unit, own = _unit(table["vector"].combine_chunks()), table["own"].to_numpy()
        linked = unit @ unit.T >= LIMIT
        same = table["i"][0].as_py() == table["j"][0].as_py()
        if not same:
            linked &= own[:, None] != own[None]
        np.fill_diagonal(linked, False)
        return pa.table({"node": pa.array(nodes), "n": pa.array(linked @ sizes)})

    counts = dealt.groupBy("root", "i", "j").applyInArrow(count, "node long, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("n"))


def _counted(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Every class (node, size) with its component_id and `linked`, the rows of others that it
    links with."""
    roots = components(links.select("a", "b"))
    full = links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= NEIGHBOURS)
    full = full.select(F.col("a").alias("node")).join(roots, "node", "left")
    full = stored(full.select("node", F.coalesce("root", "node").alias("root")), "full-lists")
    enlarged = _enlarged(full, classes)
    sizes = classes.select(F.col("node").alias("b"), "size")
    is_full = full.select(F.col("node").alias("b"), F.lit(True).alias("b_full"))
    listed = links.select("a", "b").join(sizes, "b").join(is_full, "b", "left")
    is_full = full.select(F.col("node").alias("a"), F.lit(True).alias("a_full"))
    listed = listed.join(is_full, "a", "left").where("a_full is null or b_full is null")
    listed = listed.groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("m"))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("key").alias("component_id"))
    named = named.select("node", "size", "root").join(least, "root")
    named = named.join(listed, "node", "left").join(enlarged, "node", "left")
    linked = F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))
    return stored(
        named.select("node", "size", linked.cast("long").alias("linked"), "component_id"),
        "counted",
    )


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per row of `vectors`: key, n_links, component_id, kept.

    Two rows link when their labels are equal and not null and the cosine is 0.93 or more.
    Vectors that are null, zero, or hold nulls or non-finite numbers link with nothing, and
    so do vectors of different lengths. Equal rows are rows of their own, which link;
    component_id is the smallest key reached; null keys are larger than any other. Other
    columns are not read. An empty table gives no rows.
    """
    rows, classes = _classes(vectors, key, vector, label)
    rows = stored(rows, "rows")
    edges = None
    for round_ in range(MOST_ROUNDS):
        first = _first_edges(classes, round_)
        links, lists = _trimmed(first if edges is None else edges.union(first))
        for _ in range(DESCENTS):
            edges = links.union(lists).union(_descent(lists, classes))
            links, lists = _trimmed(edges)
        edges = links.union(lists)
        named = _counted(links, classes)
        if _complete(classes, named):
            break
    else:
        named = _counted(_all_links(classes), classes)
    total = (F.col("size") - 1 + F.col("linked")).cast("long").alias("n_links")
    named = named.select("node", total, "component_id")
    out = rows.join(named.withColumn("_in", F.lit(True)), "node", "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("key"))
    out = out.select(
        "key",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
    )
    return out.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
