from __future__ import annotations

import math

import duckdb
import numpy as np

from retail_engine.llm.quality import Machine, features, fitted, held_out, scored
from retail_engine.llm.queries import op6_factorisation_machine

DATA = "/root/testdata/sf0.01"


def test_held_out_labels_are_foretold(spark):
    rows = {r.doc_id: r for r in op6_factorisation_machine(spark, DATA).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{DATA}/labels.parquet')").fetchall()
    kept = [(q, rows[i].predicted) for i, q in labels if rows[i].held_out]
    assert len(kept) > 40 and sum(q == p for q, p in kept) / len(kept) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_score_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    model = Machine(width=30, rank=4)
    model.weights, model.bias = rng.normal(size=30), 0.3
    model.factors = rng.normal(size=(30, 4)) * 0.3
    places, values = np.array([1, 4, 9, 17, 29]), rng.normal(size=5)
    z = model.bias + model.weights[places] @ values
    for i in range(5):
        for j in range(i):
            z += model.factors[places[i]] @ model.factors[places[j]] * values[i] * values[j]
    assert abs(model.score(places, values) - 1 / (1 + math.exp(-z))) < 1e-12


def test_held_out_rows_are_never_learnt_from(spark, documents):
    docs = documents([(i, f"good text {i}" if i % 2 else "bad bad bad", "en", "a") for i in range(80)])
    ids = [r.doc_id for r in docs.where(held_out("doc_id")).collect()]
    labels = lambda flip: spark.createDataFrame(
        [(i, (i % 2) ^ (flip and i in ids), 0) for i in range(80)], "doc_id long, quality int, toxic int"
    )
    a, b = fitted(docs, labels(False)), fitted(docs, labels(True))
    assert (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(2, 0, 0), (4, 1, 0), (6, 1, None), (6, 1, 0), (7, None, 0), (None, 1, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = scored(odd, fitted(odd, labels)).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert scored(empty, fitted(empty, labels)).count() == 0
    nothing = fitted(odd, labels.limit(0))
    assert {r.score for r in scored(odd, nothing).collect()} == {0.5}
    places, values = features(None, None)
    assert len(places) == len(values) > 0


def test_columns_of_the_names_used_inside_do_not_matter(spark, odd):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    names = {c: F.lit("x") for c in ("_quality", "key", "chars", "row", "one", "score")}
    plain = scored(odd, fitted(odd, labels)).collect()
    clash = odd.withColumns(names)
    assert sorted(map(str, scored(clash, fitted(clash, labels)).collect())) == sorted(map(str, plain))
