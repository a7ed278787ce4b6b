"""Encoding and decoding of whole texts with a SentencePiece BPE model, by prefix tables.

The encoding of a text ends in a piece, and that piece is the same whatever follows the
prefix: so a table of the last piece of every prefix holds the whole encoding. A prefix ends
in the one piece that (a) an automaton of all pieces finds there and (b) is compatible with
the last piece of the prefix before it, that is, their two strings together encode to just
these two. The ids are recovered backwards, from the last piece of the text to the one before
it. Work and memory grow with the text's length, also for one word of millions of letters.

A text is cut first where no piece of the model can reach across: before a space that follows
another character, and around characters without a piece, which become byte ids. What lies
between is mostly a word, and words met before are looked up.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_engine.llm.common import lists, small_batches

_SPACE = "▁"
#: How many words, and pairs of pieces, are remembered before the table is begun anew.
_WORDS, _PAIRS = 1_000_000, 500_000
#: Longer runs without a space are not worth remembering.
_LONGEST = 64


class Encoder(dict):
    """Ids of a text as the library gives them.

    The dictionary holds the ids of the words met before, as little-endian 32-bit numbers.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(library.get_piece_size())
        usable = [
            i for i in ids
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
        ]
        if any(library.is_unused(i) for i in usable):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {library.id_to_piece(i): struct.pack("<I", i) for i in usable}
        self.score = {library.id_to_piece(i): library.get_score(i) for i in usable}
        self.letters = {c for piece in self.ids for c in piece}
        if not self.letters <= self.ids.keys():
            raise ValueError("every character of a piece must be a piece")
        byte = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(library.is_byte, byte)):
            raise ValueError("the model has no pieces for bytes")
        self.byte = [struct.pack("<I", i) for i in byte]
        joined = {two for piece in self.ids for two in zip(piece, piece[1:], strict=False)}
        reached = {b for a, b in joined if a.isalpha()}
        self.stops = "".join(c for c in ".,;:!?" if c not in reached)
        #: Whether two pieces are compatible: by the right one, then by the left one.
        self.pairs: dict[str, dict[str, bool]] = {piece: {} for piece in self.ids}
        self.tested = 0
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # A piece that its own characters do not merge into never comes out.
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), piece, self.pairs[piece].get))
        self.automaton.make_automaton()
        bars = "".join(c for c in "\n\r\t\v\f" if c not in self.letters)
        bars = f"[{re.escape(bars)}]" if bars else "(?!)"
        if any(_SPACE in piece.lstrip(_SPACE) for piece in self.ids):
            self.words = re.compile(f"{bars}|(?:(?!{bars}).)+", re.DOTALL).findall
        else:
            self.words = re.compile(
                f"{bars}|{_SPACE}*(?:(?!{bars})[^{_SPACE}])+|{_SPACE}+", re.DOTALL
            ).findall

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by the definition: of all neighbours that make a piece
        together, those of the best score merge first, the leftmost of equal ones."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge joins the two when they stand side by side."""
        if self.tested >= _PAIRS:
            for known in self.pairs.values():
                known.clear()
            self.tested = 0
        found = self.pairs[right][left] = self.merged(left + right) == [left, right]
        self.tested += 1
        return found

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text of known characters, from the table of its prefixes' last pieces."""
        last = [""] * (len(text) + 1)
        done = -1
        for end, (size, piece, known) in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - size
            if start:
                fits = known(last[start])
                if not (self.compatible(last[start], piece) if fits is None else fits):
                    continue
            last[end + 1] = piece
            done = end
        found, end = [], len(text)
        while end:
            piece = last[end]
            found.append(piece)
            end -= len(piece)
        found.reverse()
        return found

    def __missing__(self, word: str) -> bytes:
        body = word.rstrip(self.stops)
        if body[-1:].isalpha() and body != word:
            # No piece reaches from a letter to a stop.
            found = self[body] + self[word[len(body) :]]
        elif self.letters.issuperset(word):
            found = self.packed(word)
        else:
            found = b"".join(
                self.packed("".join(run)) if known else b"".join(map(self.bytes_of, run))
                for known, run in itertools.groupby(word, self.letters.__contains__)
            )
        if len(word) <= _LONGEST:
            if len(self) >= _WORDS:
                self.clear()
            self[word] = found
        return found

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.pieces(text)))

    def bytes_of(self, letter: str) -> bytes:
        return b"".join(map(self.byte.__getitem__, letter.encode()))

    def ids_of(self, text: str) -> np.ndarray:
        words = self.words(self.library.normalize(text))
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<i4")


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    """A worker keeps the tables of a model from task to task."""
    return Encoder(model)


def encoded(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) and decoded (the library's text of these ids) of every row.

    `model` is the model's file as bytes, so that no executor needs a path. No begin or end
    ids, nothing sampled. A null text is an empty one: no ids, decoded to an empty text. Rows
    that share a key or are equal each have a row; other columns are not read. An empty table
    gives no rows. A very long text is encoded whole, in memory proportional to its length.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("key", rows.schema["key"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            ids = [encoder.ids_of(body or "") for body in batch.column("text").to_pylist()]
            decoded = [encoder.library.decode(own.tolist()) if len(own) else "" for own in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    lists(ids, np.int32),
                    pa.array(decoded, pa.string()),
                ],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(encode, schema)
