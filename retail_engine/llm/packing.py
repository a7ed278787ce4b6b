"""Packing of token sequences by lexical retrieval.

Every document becomes token ids and an end id. Its full windows are sequences of their own;
what is left, less than a window, meets the rests of other documents. Those are dealt over
shards of bounded size, each with a BM25 inverted index of tokens whose document frequencies
and mean length come from the whole corpus. A seed, an unused rest, fills its window with the unused
neighbours that the index ranks highest; when none fits, the best one is cut, and its
remainder seeds the next window. So only the last window of a shard has room left.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_engine.llm.common import begin, give_back, small_batches, stored

WINDOW = 1024
END = 0
SHARD = 4096
#: Token ids are below this, which bounds the table of document frequencies.
VOCABULARY = 1 << 17
_K1, _B = 1.2, 0.75
_CACHED = 1_000_000
#: Bytes of text whose words are parted and looked up at a time.
_PORTION = 4 << 20
_WORD = re.compile(r"\n?\S+").fullmatch
#: A term in more than this part of a shard's documents is a column of its matrix.
_COMMON = 16
#: How many of the best neighbours may be passed over for one that fits.
_LOOK = 24


class Encoder(dict):
    """Byte-level BPE ids as little-endian 32-bit numbers; numbers of the words met before.

    The pre-tokeniser parts a text before every single space and around every single line
    feed, so the words between them can be encoded each on its own, or many new ones as one
    text. A word that begins a line is kept with the line feed before it. Texts with any
    other white space have words that are none, and go through it whole.
    Where the text spells a token of `special`, that token's id stands for it.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None):
        super().__init__()
        import tiktoken

        lines = map(bytes.split, open(ranks_path, "rb"))
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.leads = np.zeros(max(ranks.values()) + 1, bool)
        self.leads[[i for token, i in ranks.items() if token[:1] == b" " or token == b"\n"]] = True
        #: The ids of all words met, and where those of each end, by their numbers.
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)
        self.special = {token: _binary([i]) for token, i in (special or {}).items()}
        # Of tokens that begin alike the longest counts.
        longest = sorted(self.special, key=len, reverse=True)
        self.parts = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None

    def whole(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct `words`, new ones encoded all as one text; -1 for none."""
        found = np.fromiter(map(self.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(self) + len(new) > _CACHED:
            self.clear()
            self.flat, self.ends = self.flat[:0], self.ends[:1]
            new = np.arange(len(words))
            found[:] = -1
        fresh = [words[i] for i in new.tolist()]
        new = new[[w.isalnum() or _WORD(w) is not None for w in fresh]]
        if not len(new):
            return found
        fresh = [words[i] for i in new.tolist()]
        # A space begins a word, and a line feed one that begins a line; no other id has them.
        text = (" " + " ".join(fresh)).replace(" \n", "\n")
        ids = self.encoding.encode_to_numpy(text).astype("<u4", copy=False)
        ends = np.append(np.flatnonzero(self.leads[ids])[1:], len(ids)) + len(self.flat)
        found[new] = np.arange(len(self), len(self) + len(new))
        self.update(zip(fresh, found[new].tolist(), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, ends])
        return found

    def ids(self, text: str) -> bytes:
        return self.encoded(pa.array([text], pa.string()))[0]

    def encoded(self, texts: pa.Array) -> list[bytes]:
        """The ids of each of the texts."""
        spelt = [pc.match_substring(texts, token).to_numpy(False) for token in self.special]
        spelt = np.logical_or.reduce([np.zeros(len(texts), bool), *spelt])
        # Portions of bounded size, or one text.
        portion = np.cumsum(pc.binary_length(texts).to_numpy(False), dtype=np.int64) // _PORTION
        cuts = np.flatnonzero(np.diff(portion, prepend=-1, append=-1)).tolist()
        plain = pc.if_else(pa.array(spelt), "", texts) if spelt.any() else texts
        found = [x for a, b in itertools.pairwise(cuts) for x in self.plain(plain[a:b])]
        for i in np.flatnonzero(spelt).tolist():
            parts = [part for part in self.parts.split(texts[i].as_py()) if part]
            others = pa.array([p for p in parts if p not in self.special], texts.type)
            others = iter(self.encoded(others))
            found[i] = b"".join(self.special.get(p) or next(others) for p in parts)
        return found

    def plain(self, texts: pa.Array) -> list[bytes]:
        """The ids of each of the texts, whose distinct words are looked up once."""
        blank, feed = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        lines = pc.binary_join_element_wise(blank, texts.cast(pa.large_string()), feed)
        rows = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
        words = rows.flatten().dictionary_encode()
        number = self.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        none, starts = number < 0, self.ends[number]
        sizes = np.where(none, 0, self.ends[number + 1] - starts)

        # Before each text stand an empty word and a line feed, which are not its own.
        word = words.indices.to_numpy()
        ends = rows.offsets.to_numpy().astype(np.int64)
        first, size, start, none = ends[:-1], sizes[word], starts[word], none[word]
        none[first], size[first] = False, 0
        size[first + 1] -= 1
        start[first + 1] += 1
        odd = np.add.reduceat(none, first, dtype=np.int64) > 0
        size[np.repeat(odd, np.diff(ends))] = 0
        after = np.cumsum(size)
        at = np.arange(after[-1]) + np.repeat(start - after + size, size)
        flat = self.flat[at].tobytes()
        cuts = [0, *(after[ends[1:] - 1] * 4).tolist()]
        return [
            self.whole(texts[i].as_py()) if whole else flat[a:b]
            for i, ((a, b), whole) in enumerate(
                zip(itertools.pairwise(cuts), odd.tolist(), strict=True)
            )
        ]


@functools.cache
def _encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]) -> Encoder:
    """The encoder of a Python worker, whose tasks share the words met before."""
    return Encoder(ranks_path, pattern, dict(special))


def _binary(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _counted(ids: list[bytes], sizes: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The distinct ids of every text, ascending, and how often each: ends, terms, counts.

    One sort does for all texts, whose numbers stand above their ids.
    """
    row = np.repeat(np.arange(len(ids)) * VOCABULARY, sizes)
    found = np.sort(row + np.frombuffer(b"".join(ids), "<u4"))
    last = np.flatnonzero(np.append(found[1:] != found[:-1], found[-1:] >= 0))
    counts, found = np.diff(last, prepend=-1), found[last]
    ends = np.searchsorted(found, np.arange(len(ids) + 1) * VOCABULARY)
    terms = found % VOCABULARY
    return tuple(pa.array(x.astype(np.int32)) for x in (ends, terms, counts))


def _bytes(numbers: pa.Array, ends: pa.Array) -> pa.Array:
    """32-bit numbers, parted at `ends`, as binary values: lists cost Spark work by element."""
    flat = numbers.to_numpy().tobytes()
    rows = [flat[4 * a : 4 * b] for a, b in itertools.pairwise(ends.to_pylist())]
    return pa.array(rows, pa.binary())


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all rows, from lists or binary values, and how many each row has."""
    if pa.types.is_list(column.type):
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False), sizes
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4"), np.array([len(x) // 4 for x in rows], np.int32)


def _encoded(
    docs: DataFrame,
    key: str,
    text: str,
    ranks_path: str,
    pattern: str,
    special: dict[str, int] | None,
) -> DataFrame:
    """key, ids (binary, with the end id), how many, terms and their counts (binary, too)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("key", rows.schema["key"].dataType),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("terms", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )
    end = np.array([END], "<u4").tobytes()
    tokens = tuple((special or {}).items())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(__name__)
        encoder = _encoder(ranks_path, pattern, tokens)
        for batch in batches:
            found = encoder.encoded(pc.fill_null(batch.column("text"), ""))
            sizes = np.array([len(x) // 4 for x in found], np.int64)
            ends, terms, counts = _counted(found, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([x + end for x in found], pa.binary()),
                    pa.array(sizes + 1),
                    _bytes(terms, ends),
                    _bytes(counts, ends),
                ],
                names=[f.name for f in schema],
            )
        give_back()

    return rows.mapInArrow(encode, schema)


def _frequencies(encoded: DataFrame) -> DataFrame:
    """Documents per term, summed up in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            terms, _ = _numbers(batch.column("terms"))
            total += np.bincount(terms, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    rows = encoded.select("terms").mapInArrow(count, "term long, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def _weighed(rests: DataFrame, idf: np.ndarray, mean: float) -> DataFrame:
    """Replace the counts of the terms by their BM25 weights, in lists or binary as they are."""
    names = [c for c in rests.columns if c not in ("terms", "counts")]
    kind, lists = rests.schema["terms"].dataType, T.ArrayType(T.FloatType())
    binary = isinstance(kind, T.BinaryType)
    schema = T.StructType(
        [rests.schema[c] for c in names]
        + [T.StructField("terms", kind), T.StructField("weights", kind if binary else lists)]
    )
    build = _bytes if binary else lambda numbers, ends: pa.ListArray.from_arrays(ends, numbers)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, sizes = _numbers(batch.column("terms"))
            n = _numbers(batch.column("counts"))[0].astype(float)
            long = np.repeat(batch.column("doc_tokens").to_numpy() / mean, sizes)
            w = (idf[t] * n * (_K1 + 1) / (n + _K1 * (1 - _B + _B * long))).astype(np.float32)
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [build(pa.array(x), ends) for x in (t, w)],
                names=[f.name for f in schema],
            )

    return rests.mapInArrow(weigh, schema)


class Index:
    """Postings of one shard: for each term its documents and their weights.

    Terms in more than 1/16 of the documents hold most postings and are kept as columns of a
    matrix instead: one product scores all seeds by them. It has SHARD squared numbers.
    """

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]):
        self.size = len(terms)
        flat = np.concatenate([np.empty(0, np.int32), *terms])
        worth = np.concatenate([np.empty(0, np.float32), *weights])
        docs = np.repeat(np.arange(self.size), [len(t) for t in terms])
        found, term, uses = np.unique(flat, return_inverse=True, return_counts=True)
        common = uses * _COMMON > self.size

        column = np.cumsum(common) - 1
        dense = common[term]
        weighed = np.zeros((self.size, int(common.sum())), np.float32)
        weighed[docs[dense], column[term[dense]]] = worth[dense]
        self.by_common = (weighed != 0).astype(np.float32) @ weighed.T

        docs, worth, term = docs[~dense], worth[~dense], term[~dense]
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = docs[order], worth[order]
        self.ends = np.cumsum(np.where(common, 0, uses))
        self.starts = np.append(0, self.ends[:-1])
        cuts = np.cumsum(np.bincount(docs, minlength=self.size))[:-1]
        self.terms = np.split(term, cuts)

    def scores(self, seed: int) -> np.ndarray:
        """What every document's weights of the seed's terms add up to."""
        scores = self.by_common[seed].astype(float)
        terms = self.terms[seed]
        if len(terms):
            spans = list(zip(self.starts[terms].tolist(), self.ends[terms].tolist(), strict=True))
            docs = np.concatenate([self.docs[a:b] for a, b in spans])
            weights = np.concatenate([self.weights[a:b] for a, b in spans])
            scores += np.bincount(docs, weights, self.size)
        return scores

    def ranked(self, seed: int, free: np.ndarray) -> Iterator[list[int]]:
        """All free documents that share a term with the seed, best first, in blocks."""
        scores = self.scores(seed) * free
        best = np.argpartition(scores, -min(_LOOK, self.size))[-min(_LOOK, self.size) :]
        best = best[scores[best] > 0]
        yield best[np.lexsort((best, -scores[best]))].tolist()
        scores[best] = 0
        rest = np.flatnonzero(scores > 0)
        rest = rest[np.lexsort((rest, -scores[rest]))]
        for at in range(0, len(rest), _LOOK):
            yield rest[at : at + _LOOK].tolist()

    def neighbours(self, seed: int, free: np.ndarray) -> list[int]:
        """The best free documents for the seed's terms, best first."""
        return next(self.ranked(seed, free), [])


def fill(lengths: list[int], index: Index, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Pieces (document, start, length, window number, offset) that use every token once."""
    free = np.ones(len(lengths), bool)
    start, pieces, number, seed, next_seed = [0] * len(lengths), [], 0, None, 0
    while True:
        if seed is None:
            while next_seed < len(lengths) and not free[next_seed]:
                next_seed += 1
            if next_seed == len(lengths):
                return pieces
            seed = next_seed
        free[seed] = False
        offset, cut = 0, None

        def put(doc: int, size: int) -> None:
            nonlocal offset
            pieces.append((doc, start[doc], size, number, offset))
            start[doc] += size
            offset += size

        put(seed, lengths[seed] - start[seed])
        # The scores are those of the window's start; what the window takes leaves its block.
        blocks, spare = index.ranked(seed, free.copy()), next_seed
        near = next(blocks, [])
        while offset < window:
            near = near or next(blocks, [])
            fits = (d for d in near if lengths[d] <= window - offset)
            doc = next(fits, near[0] if near else None)
            if doc is None:
                while spare < len(lengths) and not free[spare]:
                    spare += 1
                if spare == len(lengths):
                    break
                doc = spare
            else:
                near.remove(doc)
            free[doc] = False
            put(doc, min(lengths[doc], window - offset))
            if start[doc] < lengths[doc]:
                cut = doc
        number, seed = number + 1, cut


def packed(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids (little-endian 32-bit numbers) if asked for.

    `special` has the ids of strings that are one token wherever a text spells them.

    A null or empty text is the end id alone. Rows that share a key or are equal are packed
    each; other columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    encoded = stored(_encoded(docs, key, text, ranks_path, pattern, special), "encoded")
    number, total = encoded.agg(F.count("*"), F.sum("doc_tokens")).first()
    # One row a token id, so no more rows than the vocabulary has.
    frequency = np.zeros(VOCABULARY)
    table = _frequencies(encoded).toArrow()
    frequency[table["term"].to_numpy()] = table["n"].to_numpy()
    idf = np.log1p((number - frequency + 0.5) / (frequency + 0.5))

    full = (F.col("doc_tokens") / WINDOW).cast("long")
    piece = F.expr(f"substring(ids, cast(start * 4 + 1 as int), {WINDOW * 4})")
    nth = F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("nth")
    wholes = encoded.where(full > 0).select("key", "ids", "doc_tokens", nth)
    wholes = wholes.withColumn("start", F.col("nth") * WINDOW).withColumn("ids", piece)
    wholes = wholes.select(
        "key",
        "start",
        F.lit(WINDOW).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )

    shards = max(1, math.ceil(number / SHARD))
    before = full * WINDOW
    at = f"cast(doc_tokens div {WINDOW} * {WINDOW * 4} + 1 as int)"
    rest = F.expr(f"substring(ids, {at}, {WINDOW * 4})")
    rests = encoded.where(F.col("doc_tokens") > before).select(
        "key",
        rest.alias("ids"),
        before.alias("before"),
        "doc_tokens",
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard"),
        "terms",
        "counts",
    )
    rests = _weighed(rests, idf, (total or 1) / max(1, number))
    out = T.StructType([wholes.schema[c] for c in wholes.columns])

    def shard(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        ids = rows["ids"].to_pylist()
        terms, weights = (
            [np.frombuffer(x, kind) for x in rows[c].to_pylist()]
            for c, kind in (("terms", "<i4"), ("weights", "<f4"))
        )
        before = rows["before"].to_numpy()
        pieces = np.array(fill([len(x) // 4 for x in ids], Index(terms, weights)), np.int64)
        doc, start, length, window, offset = pieces.T
        bodies = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)]
        columns = {
            "key": rows["key"].take(pa.array(doc)),
            "start": pa.array(before[doc] + start),
            "length": pa.array(length),
            "ids_crc32": pa.array([zlib.crc32(b) for b in bodies], pa.int64()),
            "doc_tokens": rows["doc_tokens"].take(pa.array(doc)),
            "sequence_id": pa.array(((group[0].as_py() << 20) + window) * 2 + 1),
            "offset": pa.array(offset),
        }
        if with_ids:
            columns["ids"] = pa.array(bodies, pa.binary())
        yield from pa.table(columns).combine_chunks().to_batches()

    def pack(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shard(group, batches)
        give_back()

    return wholes.union(rests.groupBy("shard").applyInArrow(pack, out))
