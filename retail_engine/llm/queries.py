"""The queries of the operators, over the whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_engine.llm import (
    hard_negatives,
    licenses,
    minhash,
    mixing,
    neighbours,
    outliers,
    packing,
    pieces,
    quality,
    sharding,
    surrogates,
    warc,
    whitening,
)
from retail_engine.llm.common import numbered
from retail_engine.llm.stages import words_in


#: Key of the surrogates in the queries; a real corpus brings a secret of its own.
SECRET = "test key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards in random order; law `rows`."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("record.text")
    return sharding.shuffle_shards(docs, shards=16).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and whether the quality rules keep it."""
    docs = _table(spark, sf_dir, "documents")
    found = outliers.quality_rules(docs, carry=("doc_id",))
    names = [*outliers.BASE, "base_failed", "kept"]
    return found.select(F.col("record.doc_id").alias("doc_id"), *names)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    found = neighbours.near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("key", "vec_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in the documents, with its coverage and span."""
    found = licenses.notices(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("key", "doc_id")


def op5_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fitted(docs, _table(spark, sf_dir, "labels"))
    rows = quality.scored(docs, model).withColumnRenamed("key", "doc_id")
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return rows.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", predicted)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of `docs` in windows of the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}
    found = packing.packed(
        docs, ranks, public_tokenizers.PATTERN, with_ids=False, special=special
    )
    return found.withColumnRenamed("key", "doc_id")


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1,024 tokens."""
    return packed_documents(_table(spark, sf_dir, "documents"))


def op8_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the normalised archives."""
    return warc.archived(_table(spark, sf_dir, "pages")).drop("payload")


def op9_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources takes of each document."""
    docs = _table(spark, sf_dir, "documents")
    size = words_in("text")
    rows = numbered(docs.select(F.col("doc_id").alias("key"), "source", size.alias("size")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    names = ["size", "source_size", "target", taken, "source", "copies"]
    return mixing.mixed(rows).select(F.col("key").alias("doc_id"), *names)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of its mentions."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = surrogates.replaced(docs, secret=SECRET)
    return found.select("record.doc_id", "record.text", "n_mentions")


def op11_exact_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened on the first 32 components of their integer form."""
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"), number=32)
    return found.withColumnRenamed("key", "vec_id")


def op12_residue_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, some labels being wrong."""
    wrong = F.col("vec_id") % 7 == 0
    label = F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0)


def op13_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the public SentencePiece model, and decoded again."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        found = pieces.encoded(_table(spark, sf_dir, "documents"), file.read())
    return found.select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_external_shuffle": op1_external_shuffle,
    "op2_covariance_outliers": op2_covariance_outliers,
    "op3_nn_descent": op3_nn_descent,
    "op4_license_scan": op4_license_scan,
    "op5_fast_similarity_sketch": op5_fast_similarity_sketch,
    "op6_factorisation_machine": op6_factorisation_machine,
    "op7_retrieval_packing": op7_retrieval_packing,
    "op8_gzip_normaliser": op8_gzip_normaliser,
    "op9_balanced_mix": op9_balanced_mix,
    "op10_surrogates": op10_surrogates,
    "op11_exact_polynomial": op11_exact_polynomial,
    "op12_residue_products": op12_residue_products,
    "op13_prefix_table": op13_prefix_table,
}

ORACLE_SQL: dict[str, str] = {
    "op3_nn_descent": """
        WITH RECURSIVE linked AS (
            SELECT a.vec_id AS x, b.vec_id AS y
            FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
        ), reach AS (
            SELECT vec_id AS x, vec_id AS y FROM embeddings
            UNION
            SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x
        ), counts AS (SELECT x, count(*) AS n FROM linked GROUP BY x)
        SELECT reach.x AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links,
            min(y) AS component_id, reach.x = min(y) AS kept
        FROM reach LEFT JOIN counts ON counts.x = reach.x GROUP BY reach.x
    """,
    "op5_fast_similarity_sketch": """
        WITH RECURSIVE split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3),
                    lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s
            FROM split
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
            FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ), linked AS (
            SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * k >= 75 * (p.n + q.n - k)
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION
            SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x
        )
        SELECT x AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles,
            min(y) AS component_id, x = min(y) AS kept
        FROM reach LEFT JOIN sizes ON sizes.doc_id = x GROUP BY x
    """,
    # DuckDB gives SHA-1 in hex; base32 takes the 160 bits in 32 groups of five.
    "op8_gzip_normaliser": """
        WITH body AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
        ), bits AS (
            SELECT DISTINCT hex, list_aggregate(list_transform(range(0, 40), lambda i:
                lpad(bin(('0x' || substr(hex, i + 1, 1))::INT), 4, '0')), 'string_agg', '') AS b
            FROM body
        ), digests AS (
            SELECT hex, list_aggregate(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
                    + substr(b, i * 5 + 1, 1)::INT * 16 + substr(b, i * 5 + 2, 1)::INT * 8
                    + substr(b, i * 5 + 3, 1)::INT * 4 + substr(b, i * 5 + 4, 1)::INT * 2
                    + substr(b, i * 5 + 5, 1)::INT, 1)), 'string_agg', '') AS digest
            FROM bits
        ), firsts AS (SELECT hex, min(page_id) AS first_id FROM body GROUP BY hex)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
            digest AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM body JOIN digests USING (hex) JOIN firsts USING (hex)
    """,
    "op12_residue_products": """
        WITH q AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding,
                lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                list_dot_product(a.v, b.v)::BIGINT AS score
            FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT * FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id,
            row_number() OVER (PARTITION BY p.anchor_id, p.other_id
                ORDER BY n.score DESC, n.other_id)::INT AS rank,
            p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY rank <= 3
    """,
}
