from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from retail_engine.llm import whitening
from retail_engine.llm.queries import op11_exact_polynomial

SMALL = "/root/testdata/sf0.001"
VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("vector", T.StringType()),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "v", 1, 2) for i, v in rows], VECTORS)


def plain(embeddings, number):
    """Exact deviations, and whitening by a library's eigenvectors."""
    x = np.floor(64 * np.array(embeddings, np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    centred = n * x - x.sum(axis=0)
    v = centred.T.astype(float) / n @ (centred / n) / n
    e, units = np.linalg.eigh(v)
    e, units = e[::-1], units[:, ::-1]
    white = centred / n @ units[:, :number] / np.sqrt(e[:number])
    return (centred.astype(object) ** 2).sum(axis=1), white, e / e.sum()


def check(rows, ids, embeddings, number):
    deviations, white, explained = plain(embeddings, number)
    by_place = {(r.vec_id if "vec_id" in r else r.key, r.component): r for r in rows}
    assert len(rows) == len(by_place) == len(ids) * number
    for k in range(number):
        own = [by_place[i, k + 1] for i in ids]
        got = np.array([r.whitened for r in own])
        sign = np.sign(got @ white[:, k])
        assert np.allclose(got, sign * white[:, k], atol=1e-9)
        assert all(r.deviation == d for r, d in zip(own, deviations, strict=True))
        assert all(abs(r.explained / explained[k] - 1) < 1e-10 for r in own)
        assert all(r.n == len(ids) and r.identity_error < 1e-9 for r in own)


def test_the_given_vectors_as_by_a_library(spark):
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = op11_exact_polynomial(spark, SMALL).collect()
    check(rows, [r.vec_id for r in given], [r.embedding for r in given], 32)


def test_polynomial_modulo_a_prime_equals_the_exact_one():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 9):
        a = rng.integers(-9, 10, (size, size))
        a[:, : size // 2] = 0  # columns without a pivot
        # Faddeev and LeVerrier, exact.
        m, want = np.zeros((size, size), object), [1]
        for k in range(1, size + 1):
            m = a.astype(object) @ m + want[-1] * np.eye(size, dtype=int).astype(object)
            want.append(-Fraction(int(np.trace(a.astype(object) @ m)), k))
        p = 2_147_483_647
        got = whitening.polynomial_modulo(a.astype(np.int64) % p, p).tolist()
        assert got == [int(c) % p for c in reversed(want)]


def test_roots_with_their_multiplicity():
    # (x - 3)^2 (x - 7) x, and two roots next to each other
    roots = whitening.Roots([0, -63, 51, -13, 1])
    one = 1 << whitening._ROOT_BITS
    assert [roots.nth(n) for n in (1, 2, 3)] == [(7 * one, 0, 1), (3 * one, 0, 2), (3 * one, 1, 2)]
    assert roots.nth(4)[0] == 0
    # x^2 - 2000001 x + 1000001000000 = (x - 1000000)(x - 1000001)
    close = whitening.Roots([1000001000000, -2000001, 1])
    assert [close.nth(n)[0] // one for n in (1, 2)] == [1000001, 1000000]


def test_equal_eigenvalues_get_orthogonal_components(spark):
    # Corners of a cross: the covariance is a multiple of the identity.
    rows = [(2 * i + s, [(-1.0) ** s if j == i else 0.0 for j in range(4)]) for i in range(4) for s in (0, 1)]
    found = whitening.whitened(table(spark, rows)).collect()
    assert len(found) == 8 * 4
    assert all(r.identity_error < 1e-12 and abs(r.explained - 0.25) < 1e-12 for r in found)


def test_missing_rank_ends_the_components(spark):
    rng = np.random.default_rng(1)
    plane = rng.normal(size=(40, 2)).round(3)
    rows = [(i, [float(a), float(b), 0.5, float(a)]) for i, (a, b) in enumerate(plane)]
    found = whitening.whitened(table(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2}
    assert all(r.identity_error < 1e-10 for r in found)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0])], [(1, [0.5]), (2, [0.5])], [(1, []), (2, None)]])
def test_without_spread_there_are_no_rows(spark, rows):
    assert whitening.whitened(table(spark, rows)).collect() == []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2, -0.7]), (1, [0.1, 0.2, -0.7]), (None, [0.9, -3.0, 0.0]), (5, [1.5]), (6, [])]
    bad = [(7, None), (8, [nan, 1.0, 2.0]), (9, [1.0, None, 2.0]), (10, [inf, 0.0, 0.0])]
    found = whitening.whitened(table(spark, good + bad)).collect()
    assert {r.n for r in found} == {5} and {r.key for r in found} == {1, None, 5, 6}
    assert {r.component for r in found} == {1, 2, 3} and len(found) == 15
    filled = [v + [0.0] * (3 - len(v)) for _, v in good]
    deviations = plain(filled, 3)[0]
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviations)


def test_very_large_entries_stay_exact(spark):
    good = [[1e5 * i, -2e5 * i * i, 7.0] for i in range(1, 6)]
    check(whitening.whitened(table(spark, list(enumerate(good)))).collect(), range(5), good, 2)
    huge = [(1, [1e30, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    found = whitening.whitened(table(spark, huge)).collect()
    assert {r.deviation for r in found if r.key != 3} == {None}
    assert {r.component for r in found} == {1, 2}
