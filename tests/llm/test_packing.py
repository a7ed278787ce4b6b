from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from retail_engine.llm import packing
from retail_engine.llm.packing import (
    WINDOW,
    Encoder,
    Index,
    _counted,
    _encoded,
    _encoder,
    _weighed,
    fill,
    packed,
)
from retail_engine.llm.queries import op7_retrieval_packing

SMALL = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(pieces, texts):
    """Every id in one piece, sequences gapless and at most a window; returns the padding."""
    ids = {k: np.array([*x, 0], "<u4") for k, x in zip(texts, reference_ids(list(texts.values())), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.key].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for key, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            body = ids[key][p.start : p.start + p.length].tobytes()
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[key])
            assert zlib.crc32(body) == p.ids_crc32 and getattr(p, "ids", body) == body
            at += p.length
        assert at == len(ids[key])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= WINDOW
        padding += WINDOW - at
    return padding


def test_ids_equal_those_of_the_tokenizer():
    texts = [
        "plain words here", " lead", "trail ", "two  spaces", "a\n b", "a \n b", "x\t y", "é ü 日本",
        "it's <|endoftext|> 'S don't", "  nb", "a b  c", "", " ", "\n\n", "12 345,678 $$$ ##",
    ]
    encoder = Encoder(RANKS, PATTERN)
    for text, want in zip(texts, reference_ids(texts), strict=True):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_special_tokens_are_one_id_wherever_they_stand():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = Encoder(RANKS, PATTERN, {"<|endoftext|>": 50256})
    texts = [
        "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x\n<|endoftext|>\ny",
        "it's <|endoftext| > a<|endoftext|>b", " <|endoftext|>\t\n z", "plain words",
    ]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_all_documents_are_packed_with_little_padding(spark):
    pieces = op7_retrieval_packing(spark, SMALL).withColumnRenamed("doc_id", "key").collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert check(pieces, {r.doc_id: r.text or "" for r in docs}) < WINDOW


def test_neighbours_are_the_lexically_nearest():
    terms = [np.array(t, np.int32) for t in ([1, 2, 3], [7, 8], [2, 3, 9], [7, 9], [1])]
    weights = [np.ones(len(t), np.float32) for t in terms]
    index = Index(terms, weights)
    assert index.neighbours(0, np.array([0, 1, 1, 1, 1], bool)) == [2, 4]
    assert index.neighbours(1, np.array([1, 0, 1, 1, 1], bool)) == [3]
    # Seed 0 takes 2 and 4, then any other; what is cut seeds the next window.
    pieces = fill([400, 500, 500, 600, 50], index, window=1000)
    assert [p[0] for p in pieces if p[3] == 0] == [0, 2, 4, 1]
    assert [p for p in pieces if p[3] == 1][0][:3] == (1, 50, 450)
    assert sum(p[2] for p in pieces) == 2050


def test_all_terms_of_a_document_are_weighed(spark):
    schema = "key long, doc_tokens long, terms array<int>, counts array<int>"
    rows = spark.createDataFrame([(1, 300, list(range(100)), [3] * 100), (2, 1, [], [])], schema)
    found = {r.key: r for r in _weighed(rows, np.linspace(1, 2, 200), 150.0).collect()}
    assert found[1].terms == list(range(100)) and len(found[1].weights) == 100
    assert min(found[1].weights) > 0 and found[2].terms == []


def test_neighbours_go_on_until_none_is_left():
    # The first 100 share nothing with the seed, which meets all of the last 100 first.
    terms = [np.array([t], np.int32) for t in [1] + [2] * 100 + [1] * 100]
    weights = [np.full(1, 1 + i / 1000, np.float32) for i in range(201)]
    pieces = fill([10] * 201, Index(terms, weights), window=1020)
    assert [p[0] for p in pieces if p[3] == 0] == [0, *range(200, 100, -1), 1]


def test_odd_rows(odd, empty):
    rows = packed(odd.where("doc_id <> 6"), RANKS, PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id not in (None, 6)}
    assert check(rows, texts) < WINDOW
    assert packed(odd, RANKS, PATTERN).where("key is null and start = 0").count() == 2
    assert packed(odd, RANKS, PATTERN).where("key = 6 and start = 0").count() == 2
    assert packed(empty, RANKS, PATTERN).count() == 0


def test_scores_are_those_of_plain_bm25():
    rng = np.random.default_rng(5)
    # Terms below 20 are in most documents, those from 1,000 on in few or one.
    drawn = [
        np.unique(np.concatenate([rng.integers(0, 20, 12), rng.integers(1000, 3000, rng.integers(9))]))
        for _ in range(300)
    ]
    drawn[7] = np.empty(0, np.int64)
    drawn[8] = drawn[9]
    terms = [t.astype(np.int32) for t in drawn]
    weights = [rng.uniform(0.1, 3, len(t)).astype(np.float32) for t in terms]
    worth = [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in zip(terms, weights, strict=True)]
    index = Index(terms, weights)
    for seed in range(300):
        plain = [sum(own.get(t, 0) for t in terms[seed].tolist()) for own in worth]
        assert np.allclose(index.scores(seed), plain, rtol=1e-5)
        blocks = [d for block in index.ranked(seed, np.ones(300, bool)) for d in block]
        assert sorted(blocks) == [d for d in range(300) if plain[d] > 0]
        assert all(plain[a] >= plain[b] - 1e-4 for a, b in zip(blocks, blocks[1:]))


def test_words_new_and_known_give_the_ids_of_the_whole_text():
    texts = [
        "a.\nb c", "a.\nb c", "\nb", "b\n", "b\n\nc", "a\rb c", "c\x0bd", "a. ", "x y", "q \n q",
        "'s 't don't", "x ...\n...y", "7 7,7\n7",
    ]
    encoder = Encoder(RANKS, PATTERN)
    for text, want in zip(texts * 2, reference_ids(texts) * 2, strict=True):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_tasks_of_a_worker_share_the_words_met_before():
    encoder = _encoder(RANKS, PATTERN, ())
    encoder.ids("a wordmetonlyhere")
    assert "wordmetonlyhere" in _encoder(RANKS, PATTERN, ())
    assert _encoder(RANKS, PATTERN, (("<|endoftext|>", 50256),)) is not encoder


def test_terms_of_a_batch_are_counted_by_text():
    texts = [[5, 3, 5], [], [131071, 0], [], [3, 3]]
    bodies = [np.array(t, "<u4").tobytes() for t in texts]
    ends, terms, counts = (x.to_pylist() for x in _counted(bodies, np.array([len(t) for t in texts])))
    assert ends == [0, 2, 2, 4, 4, 5]
    assert terms == [3, 5, 0, 131071, 3] and counts == [1, 2, 1, 1, 2]
    assert [x.to_pylist() for x in _counted([b"", b""], np.array([0, 0]))] == [[0, 0, 0], [], []]
    assert [x.to_pylist() for x in _counted([], np.array([], np.int64))] == [[0], [], []]


BATCH = [
    "one two three", "", "one\ntwo", "two  one", " one", "two\tone", "a <|endoftext|>b one", "\n\n",
    "don't, two.\nthree", "x\u00a0y two", "one\n", "<|endoftext|>", "日本 ﷺ one", "three 7,7 x\x1cy",
]


@pytest.mark.parametrize("bytes_at_a_time, cached", [(1, 1), (20, 4), (1 << 20, 1_000_000)])
def test_words_of_a_batch_are_encoded_together(monkeypatch, bytes_at_a_time, cached):
    monkeypatch.setattr(packing, "_PORTION", bytes_at_a_time)
    monkeypatch.setattr(packing, "_CACHED", cached)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in tokenizer.encode_batch(BATCH, add_special_tokens=False)]
    encoder = Encoder(RANKS, PATTERN, {"<|endoftext|>": 50256})
    for texts in (BATCH, BATCH, []):
        found = encoder.encoded(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == want[: len(texts)]


def test_a_new_word_is_encoded_once_with_all_others_of_the_batch(monkeypatch):
    encoder, calls = Encoder(RANKS, PATTERN), []
    core = encoder.encoding
    monkeypatch.setattr(core, "encode_to_numpy", lambda t, f=core.encode_to_numpy: calls.append(t) or f(t))
    texts = pa.array(["a b c", "c b\nd", "a a a"])
    encoder.encoded(texts)
    encoder.encoded(texts)
    # "a" and "c" begin a text as well as follow a space.
    assert [sorted(t.split()) for t in calls] == [["a", "a", "b", "c", "c", "d"]]


def test_terms_are_stored_and_weighed_as_binary(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    rows = _encoded(docs, "doc_id", "text", RANKS, PATTERN, None)
    assert {rows.schema[c].dataType.typeName() for c in ("ids", "terms", "counts")} == {"binary"}
    idf = np.full(1 << 17, 2.0)
    found = {r.key: r for r in _weighed(rows, idf, 4.0).collect()}
    ids = np.array(reference_ids(["a b a"])[0])
    terms, counts = np.unique(ids, return_counts=True)
    assert np.frombuffer(found[1].terms, "<i4").tolist() == terms.tolist()
    weights = 2 * counts * 2.2 / (counts + 1.2)
    assert np.allclose(np.frombuffer(found[1].weights, "<f4"), weights)
    assert found[2].terms == found[2].weights == b"" and found[2].doc_tokens == 1
