"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers, so n, the sums S and the scatter M = n^2 V are exact integers. The
characteristic polynomial of M is found modulo many primes, by reduction to Hessenberg form,
and put together by Chinese remaindering; the primes are dealt over tasks. All its roots are
real, so the changes of sign among the coefficients of p(x + a) count the roots above a
exactly: by that the roots are told apart, each then refined to 2^-192. A component spans the
null space of M less its root, found by inverse iteration on an elimination in long integers.
Each component is a row of a job of its own. Only sums whose number the dimension bounds, and
the components, meet in the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_engine.llm import vectors

SCALE, SHIFT = 64, 1_000_000
#: Integer entries end at this size, so that they fit in a long with room for a difference.
_LARGEST = 1 << 61
_LIMB = 1 << 64
#: Bits behind the point of a root, and of the quotients of an elimination.
_ROOT_BITS, _QUOTIENT_BITS = 192, 256
_PRIMES_BELOW = 1 << 31
_PRIMES_A_BATCH = 8
_ONE = float(1 << 53)


def integers(c: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1,000,000 as long; beyond 2^61 the nearest number below that."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * c)
    return np.clip(x, -_LARGEST, _LARGEST).astype(np.int64) + SHIFT


def _exact(values: np.ndarray, most: float) -> np.ndarray:
    """`values` as long if numbers up to `most` are safe in one, else as Python's integers."""
    return values if most < float(1 << 62) else values.astype(object)


def _size(values: np.ndarray) -> float:
    return float(np.abs(values).max(initial=0))


def _scatter(y: np.ndarray) -> np.ndarray:
    """Sum over the rows of y times y transposed, exact, upper triangle by rows."""
    most = _size(y) ** 2 * len(y)
    if most < _ONE:
        found = (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    else:
        y = _exact(y, most)
        found = y.T @ y
    return found[np.triu_indices(len(found))]


def _added(rows: DataFrame, width: int, partial: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all rows, by place, of the integers that `partial` makes of a batch.

    Each task sends one row a place, as two limbs; the driver gets one row a place.
    """
    schema = "place long, high decimal(38,0), low decimal(38,0)"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = integers(vectors.matrix(batch.column("vector"), width))
                own = partial(x).astype(object)
                total = own if total is None else total + own
        if total is not None:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(total))),
                    pa.array([v // _LIMB for v in total], kind),
                    pa.array([v % _LIMB for v in total], kind),
                ],
                names=["place", "high", "low"],
            )

    sums = rows.select("vector").mapInArrow(add, schema).groupBy("place")
    found = sums.agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return [int(r.high) * _LIMB + int(r.low) for r in sorted(found, key=lambda r: r.place)]


# The characteristic polynomial


def _is_prime(n: int) -> bool:
    """Miller-Rabin, exact for numbers below 2^32 with these bases."""
    if n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 7, 61):
        x = pow(base, d, n)
        if x in (0, 1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _primes(product_above: int) -> list[int]:
    """The largest primes below 2^31 whose product is above the given number."""
    found, product, n = [], 1, _PRIMES_BELOW
    while product <= product_above:
        n -= 1
        if _is_prime(n):
            found.append(n)
            product *= n
    return found


def _hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to `a` modulo p with zeros below the first subdiagonal."""
    h, size = a.copy(), len(a)
    for k in range(size - 2):
        filled = np.flatnonzero(h[k + 1 :, k])
        if not len(filled):
            continue
        at = k + 1 + int(filled[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1]) % p
        # The inverse step on the columns; each product is reduced before they are added.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    return h


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - a) modulo p, the constant one first."""
    h, size = _hessenberg(a, p), len(a)
    # Row k is the polynomial of the leading k by k block.
    rows = np.zeros((size + 1, size + 1), np.int64)
    rows[0, 0] = 1
    for k in range(1, size + 1):
        weights, run = np.empty(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * run % p
            run = run * int(h[i, i - 1]) % p if i else 0
        rows[k, 1:] = rows[k - 1, :-1]
        rows[k] = (rows[k] - (weights[:, None] * rows[:k] % p).sum(axis=0)) % p
    return rows[size]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of the characteristic polynomial of a positive semidefinite matrix of
    Python's integers, the constant one first. Primes are dealt over tasks."""
    size, trace = len(m), int(np.trace(m))
    # Maclaurin: the k-th sum of products of the roots is at most C(d, k) (trace / d)^k.
    bound = max(math.comb(size, k) * (-(-trace // size)) ** k for k in range(size + 1))
    primes = _primes(4 * bound)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("id").to_pylist()
            found = [
                polynomial_modulo((m % primes[i]).astype(np.int64), primes[i]).tolist()
                for i in places
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "found"]
            )

    parts = -(-len(primes) // _PRIMES_A_BATCH)
    residues = spark.range(0, len(primes), 1, parts).mapInArrow(solve, "id long, found array<long>")
    by_prime = {primes[r.id]: r.found for r in residues.collect()}
    product = math.prod(primes)
    total = [0] * (size + 1)
    for p, found in by_prime.items():
        other = product // p
        weight = other * pow(other, -1, p)
        total = [t + weight * r for t, r in zip(total, found, strict=True)]
    total = [t % product for t in total]
    return [t - product if t > product // 2 else t for t in total]


# Roots and components


class Roots:
    """Roots of a polynomial with none but real ones, in units of 2^-bits."""

    def __init__(self, coefficients: list[int], bits: int = _ROOT_BITS):
        self.degree = len(coefficients) - 1
        self.c = [v << bits * (self.degree - i) for i, v in enumerate(coefficients)]
        # The sum of the roots, none of which is negative.
        self.most = -self.c[-2] if self.degree else 0

    def above(self, a: int) -> int:
        """How many roots are larger than a."""
        c = list(self.c)
        for i in range(self.degree):
            run = c[-1]
            for j in range(self.degree - 1, i - 1, -1):
                run = c[j] = c[j] + a * run
        signs = [v > 0 for v in c if v]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def value(self, a: int) -> int:
        found = 0
        for v in reversed(self.c):
            found = found * a + v
        return found

    def nth(self, n: int) -> tuple[int, int, int]:
        """(root, k, m): the n-th largest root, rounded up, is one of m that no unit parts,
        of which k are counted before it (0 to m - 1)."""
        low, high, under, over = -1, self.most, self.degree, 0
        while high - low > 1 and (under, over) != (n, n - 1):
            mid = (low + high) // 2
            count = self.above(mid)
            if count >= n:
                low, under = mid, count
            else:
                high, over = mid, count
        # A single root is left: the sign says on which side of it a number is.
        right = (-1) ** (n - 1)
        while high - low > 1:
            mid = (low + high) // 2
            value = self.value(mid)
            if value == 0 or (value > 0) == (right > 0):
                high = mid
            else:
                low = mid
        return high, n - 1 - over, under - over


def _unit(v: np.ndarray) -> np.ndarray:
    """`v` scaled to the length 2^_QUOTIENT_BITS."""
    length = math.isqrt(int((v * v).sum())) or 1
    return (v << _QUOTIENT_BITS) // length


def null_space(m: np.ndarray, root: int, count: int) -> np.ndarray:
    """`count` unit vectors (rows of doubles) that m less the root sends next to zero."""
    size, bits = len(m), _QUOTIENT_BITS
    a = m * (1 << _ROOT_BITS)
    a[np.diag_indices(size)] -= root
    order = np.arange(size)
    for k in range(size):
        at = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
        pivot = a[k, k] = a[k, k] or 1
        for i in range(k + 1, size):
            if a[i, k]:
                # The quotients stay where the zeros would be, to be used again.
                quotient = a[i, k] = (a[i, k] << bits) // pivot
                a[i, k + 1 :] -= (quotient * a[k, k + 1 :]) >> bits
    rng, found = random.Random(size), []
    for _ in range(count):
        v = np.array([rng.randrange(-(1 << bits), 1 << bits) for _ in range(size)], object)
        for _ in range(3):
            z = v[order]
            for k in range(size):
                z[k + 1 :] -= (a[k + 1 :, k] * z[k]) >> bits
            z = z << bits
            for k in range(size - 1, -1, -1):
                z[k] //= a[k, k]
                z[:k] -= a[:k, k] * z[k]
            v = _unit(z)
            for _ in range(2):
                for u in found:
                    v = v - ((int((u * v).sum()) * u) >> 2 * bits)
                v = _unit(v)
        found.append(v)
    unit = np.array([[float(Fraction(int(x), 1 << bits)) for x in v] for v in found])
    return unit / np.linalg.norm(unit, axis=1)[:, None]


def components(
    spark: SparkSession, m: np.ndarray, number: int
) -> tuple[list[Fraction], np.ndarray]:
    """The largest positive eigenvalues of m, falling, and their unit vectors as rows."""
    size = len(m)
    polynomial = characteristic(spark, m)
    rank = size - next(i for i, c in enumerate(polynomial) if c)
    number = min(number, rank)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = Roots(polynomial)
        for batch in batches:
            for n in batch.column("id").to_pylist():
                root, place, count = roots.nth(n)
                vector = null_space(m, root, count)[place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n]), pa.array([str(root)]), pa.array([vector.tolist()])],
                    names=["id", "root", "vector"],
                )

    schema = "id long, root string, vector array<double>"
    rows = spark.range(1, number + 1, 1, max(1, number)).mapInArrow(solve, schema)
    found = sorted(rows.collect(), key=lambda r: r.id)
    values = [Fraction(int(r.root), 1 << _ROOT_BITS) for r in found]
    return values, np.array([r.vector for r in found]).reshape(number, size)


# The table


class _Whitener:
    """Deviations and whitened vectors of a batch of integer vectors."""

    def __init__(self, n: int, sums: list[int], values: list[Fraction], units: np.ndarray):
        # x - S/n is x - whole - rest/n.
        self.n = n
        self.whole = np.array([round(Fraction(s, n)) for s in sums], np.int64)
        self.rest = [s - n * int(w) for s, w in zip(sums, self.whole, strict=True)]
        self.project = units.T / np.sqrt([float(v / n**2) for v in values])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        y = x - self.whole
        most = float(self.n) * (_size(y) + 1)
        rest = np.array(self.rest, np.int64 if self.n < 1 << 62 else object)
        return _exact(y, most) * self.n - rest

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.project

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Exact sums of squares; None where a long cannot hold it."""
        safe = _exact(centred, _size(centred) ** 2 * centred.shape[1])
        found = (safe * safe).sum(axis=1).tolist()
        return [d if d < 1 << 63 else None for d in found]


def _identity_error(rows: DataFrame, width: int, whitener: _Whitener, number: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(number), np.zeros((number, number))
        for batch in batches:
            x = integers(vectors.matrix(batch.column("vector"), width))
            w = whitener.whitened(whitener.centred(x))
            sums += w.sum(axis=0)
            products += w.T @ w
        total = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], names=["place", "total"]
        )

    parts = rows.select("vector").mapInArrow(add, "place long, total double")
    found = parts.groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.array([r.total for r in sorted(found, key=lambda r: r.place)]) / whitener.n
    mean, products = total[:number], total[number:].reshape(number, number)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(number)).max())


def whitened(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", number: int = 32
) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of every vector
    and each of the first `number` components.

    Rows whose vector is null or holds a null or non-finite entry take no part. Shorter vectors
    are filled up with zeros, an empty one is all zeros. Integer entries beyond 2^61 count as
    that; a deviation beyond a long is null. Components of the eigenvalue 0 cannot be whitened
    and have no rows: so equal vectors alone, a single one or an empty table give none. Among
    equal eigenvalues any orthogonal components are taken, the same at each run. Rows that
    share a key or are equal have rows each; other columns are not read.
    """
    spark = table.sparkSession
    rows = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    rows = rows.where(vectors.finite(F.col("vector")))
    schema = T.StructType(
        [
            T.StructField("key", rows.schema["key"].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    width = vectors.width(rows, "vector")
    if not width:
        return spark.createDataFrame([], schema)

    def counted(x: np.ndarray) -> np.ndarray:
        sums = _exact(x, _size(x) * len(x)).sum(axis=0)
        return np.append(sums.astype(object), len(x))

    *sums, n = _added(rows, width, counted)
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    rests = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], object)
    upper = _added(rows, width, lambda x: _scatter(x - centre))
    m = np.zeros((width, width), object)
    m[np.triu_indices(width)] = upper
    m = n * np.triu(m) + n * np.triu(m, 1).T - np.outer(rests, rests)
    trace = int(np.trace(m))
    if not trace:
        return spark.createDataFrame([], schema)
    values, units = components(spark, m, number)
    number = len(values)
    whitener = _Whitener(n, sums, values, units)
    error = _identity_error(rows, width, whitener, number)
    explained = np.array([float(v / trace) for v in values])

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = whitener.centred(integers(vectors.matrix(batch.column("vector"), width)))
            size = batch.num_rows
            each = pa.array(np.repeat(np.arange(size), number))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(each),
                    pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * number, n, np.int64)),
                    pa.array(whitener.deviations(centred), pa.int64()).take(each),
                    pa.array(whitener.whitened(centred).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * number, error)),
                ],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(whiten, schema)
