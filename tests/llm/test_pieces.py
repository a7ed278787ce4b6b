from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from retail_engine.llm import pieces
from retail_engine.llm.pieces import Encoder, encoded
from retail_engine.llm.queries import op13_prefix_table

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def model() -> bytes:
    with open(PATH, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def encoder():
    return Encoder(model())


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "  ", "plain words", " lead", "trail ", "two  spaces", "a\n b\r\n\tc\n\n", "x\0y",
        "<s> </s> <0x41> <unk>", "▁ ▁▁a", "日本語 ÄÖ é é", "😀a😀😀 b😀", " \x0b\x0c\x85",
        " " * 17 + "a" + " " * 40, "﻿x　y z", "10000 3.14", "😀",
    ],
)
def test_ids_equal_the_library_s(encoder, text):
    assert encoder.ids_of(text).tolist() == LIBRARY.encode(text)


_ALPHABET = st.sampled_from(list("aeinrst  ▁\n\t\r.,1éж日😀\0"))


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(_ALPHABET, max_size=60)))
def test_any_text_is_encoded_as_by_the_library(encoder, text):
    assert encoder.ids_of(text).tolist() == LIBRARY.encode(text)


def test_words_of_very_many_letters(encoder):
    rng = random.Random(3)
    for letters in ("a", "ab", "etaoin", "▁", "日本a"):
        text = "".join(rng.choices(letters, k=50_000))
        assert encoder.ids_of(text).tolist() == LIBRARY.encode(text)


def test_the_last_piece_of_every_prefix_is_that_of_the_prefix_alone(encoder):
    text = "internationalisation"
    for end in range(1, len(text) + 1):
        assert encoder.pieces(text[:end]) == encoder.merged(text[:end])


def test_full_tables_begin_anew(monkeypatch):
    monkeypatch.setattr(pieces, "_WORDS", 5)
    monkeypatch.setattr(pieces, "_PAIRS", 5)
    own, rng = Encoder(model()), random.Random(1)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abcde", k=4)) for _ in range(5))
        assert own.ids_of(text).tolist() == LIBRARY.encode(text)
        assert len(own) <= 5 and sum(map(len, own.pairs.values())) <= 5


def test_all_documents_as_by_the_library(spark):
    rows = {r.doc_id: r for r in op13_prefix_table(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids, row = LIBRARY.encode(doc.text or ""), rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = LIBRARY.decode(ids) if ids else ""
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, odd, empty):
    found = encoded(odd, model()).collect()
    want = [(r.doc_id, LIBRARY.encode(r.text or "")) for r in odd.collect()]
    order = str
    assert sorted(((r.key, r.ids) for r in found), key=order) == sorted(want, key=order)
    assert all(r.decoded == (LIBRARY.decode(r.ids) if r.ids else "") for r in found)
    assert encoded(empty, model()).collect() == []
