"""Quality rules: base rules per text, then multivariate outliers per language and source.

Each group's centre and scatter come from the minimum covariance determinant: concentration
steps from three deterministic starts, each keeping the three quarters of the rows nearest to
the estimate before, until the start of the least determinant is taken and reweighted. A text
whose transformed statistics lie too far from its group's centre is rejected.

All of it is DataFrame functions. Estimates are sums, so a group of any size takes part in
partial aggregation; the quantiles that the steps need come from counts of logarithmic bins.
Statistics are rounded to 1/1024, which keeps those sums exact and reruns equal.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_engine.llm.common import packed, stored, words_of

#: Base statistics, part of the result.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics, the vector that distances are taken of.
VECTOR = ("x_words", "x_length", "x_symbols", "x_upper", "x_marks")
P = len(VECTOR)
WINDOW = 5
#: Groups of fewer rows use their language's estimate, and that of all rows below it.
MIN_ROWS = 64
KEPT_SHARE = 0.75
STEPS = 3
#: Squared distance beyond which a text is rejected, 14 standard deviations. Statistics of
#: short and of mixed texts have heavy tails, so a normal quantile would reject sound ones.
FARTHEST = 200.0
#: Added to each variance: a spread of this much is no oddity, least of all in length.
_FLOOR = tuple(x**2 for x in (1.0, 0.1, 0.06, 0.08, 0.06))
_BINS = 32  # to an octave of the squared distance


def _chi2(q: float, p: int = P) -> float:
    """Quantile of the chi-squared distribution (Wilson and Hilferty)."""
    z = NormalDist().inv_cdf(q)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def _repeated(hashes: Column) -> Column:
    """Words in windows of five found twice or more, from the windows' hashes in order."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        near = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        kept = F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    # A one-element array gives the sorted windows a name, so that they are sorted once.
    found = F.transform(F.array(ranked), places)[0]
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(
        found,
        start,
        lambda a, i: F.struct(
            (a["n"] + i + WINDOW - F.greatest(a["reach"], i)).alias("n"),
            (i + WINDOW).alias("reach"),
        ),
        lambda a: a["n"],
    )


def measured(
    docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None
) -> DataFrame:
    """`record` (the carried columns, all by default), `lang`/`source` keys and statistics.

    Words are runs of [^\\x20\\x09-\\x0D]; a null text has none, and zero statistics.
    """
    record = packed(docs if carry is None else docs.select(*carry))
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(
        record, F.col("lang").alias("_lang"), F.col("source").alias("_source"), body.alias("_text")
    )
    df = df.withColumn("_words", words_of(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "record",
        "_lang",
        "_source",
        F.size("_words").alias("n"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.length("_text").alias("_chars"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).alias("_word_chars"),
        F.length(F.translate("_text", "#*$%&|<>", "")).alias("_plain"),
        F.length(F.regexp_replace("_text", r"\p{Lu}+", "")).alias("_lower"),
        F.length(F.regexp_replace("_text", r"[\p{P}\p{S}]+", "")).alias("_unmarked"),
        lines.alias("_lines"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.col("n") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]),
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_windows", F.when(F.col("n") >= WINDOW, window).otherwise(none))
    plain = F.size(F.array_distinct("_windows")) == F.size("_windows")
    df = df.withColumn("_repeats", F.when(plain, 0).otherwise(_repeated(F.col("_windows"))))
    df = df.withColumn("_dups", F.size("_lines") - F.size(F.array_distinct("_lines")))
    chars, words = F.greatest("_word_chars", F.lit(1)), F.greatest("n", F.lit(1))
    share = lambda x, of: F.asin(F.sqrt(F.least(x / of, F.lit(1.0))))
    vector = {
        "x_words": F.log1p("n"),
        "x_length": F.log1p(F.col("_word_chars") / words),
        "x_symbols": share(F.col("_chars") - F.col("_plain"), chars),
        "x_upper": share(F.col("_chars") - F.col("_lower"), chars),
        "x_marks": share(F.col("_chars") - F.col("_unmarked"), chars),
    }
    base = dict(
        n_words=F.col("n"),
        word_chars=F.col("_word_chars"),
        n_symbols=F.col("_chars") - F.col("_plain"),
        n_dup_lines=F.col("_dups"),
        n_repeat_words=F.col("_repeats"),
    )
    failed = (F.col("n") < 10) | (100 * F.col("_repeats") > 20 * F.col("n"))
    return df.select(
        "record",
        *_levels(),
        *[v.cast("long").alias(k) for k, v in base.items()],
        failed.alias("base_failed"),
        *[(F.round(v * 1024) / 1024).alias(k) for k, v in vector.items()],
    )


def _levels() -> list[Column]:
    """Numbers of the row's group, its language and all rows; nulls are values of their own."""
    lang, source = (
        [F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))]
        for c in ("_lang", "_source")
    )
    return [
        F.xxhash64(F.lit(2), *lang, *source).alias("_k2"),
        F.xxhash64(F.lit(1), *lang).alias("_k1"),
        F.xxhash64(F.lit(0)).alias("_k0"),
    ]


def _chosen(rows: DataFrame) -> DataFrame:
    """_k2 -> _k: the finest level with rows enough."""
    groups = rows.groupBy("_k2", "_k1", "_k0").agg(F.count("*").alias("n2"))
    langs = groups.groupBy("_k1").agg(F.sum("n2").alias("n1"))
    k = F.when(F.col("n2") >= MIN_ROWS, F.col("_k2")).when(F.col("n1") >= MIN_ROWS, F.col("_k1"))
    return groups.join(langs, "_k1").select("_k2", k.otherwise(F.col("_k0")).alias("_k"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _floor(i: int, j: int) -> float:
    return _FLOOR[i] if i == j else 0.0


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, the mean m0.. and the covariance c00.. of VECTOR over each key's rows."""
    x = [F.col(v) for v in VECTOR]
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _pairs()],
    )
    n = F.col("n")
    m = [F.col(f"s{i}") / n for i in range(P)]
    return sums.select(
        *by,
        *[m[i].alias(f"m{i}") for i in range(P)],
        *[
            (F.col(f"s{i}_{j}") / n - m[i] * m[j] + _floor(i, j)).alias(f"c{i}_{j}")
            for i, j in _pairs()
        ],
    )


def _whitened(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key m0.., the inverse w of the covariance's Cholesky factor, and the log determinant."""
    df = estimates
    for i, j in _pairs():
        rest = F.col(f"c{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        entry = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}")
        df = df.withColumn(f"l{i}_{j}", entry)
    for i in range(P):
        df = df.withColumn(f"w{i}_{i}", 1 / F.col(f"l{i}_{i}"))
        for j in range(i):
            total = reduce(
                lambda a, b: a + b, [F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)]
            )
            df = df.withColumn(f"w{i}_{j}", -total / F.col(f"l{i}_{i}"))
    det = reduce(lambda a, b: a + b, [F.log(f"l{i}_{i}") for i in range(P)])
    return df.select(
        *keys,
        det.alias("det"),
        *[f"m{i}" for i in range(P)],
        *[f"w{i}_{j}" for i, j in _pairs()],
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its whitened estimate."""
    gap = [F.col(v) - F.col(f"m{i}") for i, v in enumerate(VECTOR)]
    terms = []
    for i in range(P):
        y = reduce(lambda a, b: a + b, [F.col(f"w{i}_{j}") * gap[j] for j in range(i + 1)])
        terms.append(y * y)
    return reduce(lambda a, b: a + b, terms)


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(1e-6))) * _BINS).cast("int")


def _cut(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The bin up to which at least `share` of each key's rows lie."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("n").over(by.orderBy("bin")))
    counts = counts.withColumn("all", F.sum("n").over(by))
    cut = counts.where(F.col("upto") >= share * F.col("all"))
    return cut.groupBy(*keys).agg(F.min("bin").alias("cut"))


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates: medians with MADs, spatial signs around the medians, plain moments."""
    # Statistics to 1/64 have few values, which an exact median counts.
    coarse = [F.round(F.col(v) * 64) / 64 for v in VECTOR]
    mid = rows.groupBy("_k").agg(*[F.median(x).alias(f"d{i}") for i, x in enumerate(coarse)])
    rows = rows.join(stored(mid, "medians"), "_k")
    gap = [F.col(v) - F.col(f"d{i}") for i, v in enumerate(VECTOR)]
    far = [F.round(F.abs(g) * 64) / 64 for g in gap]
    mads = rows.groupBy("_k").agg(
        *[F.first(f"d{i}").alias(f"m{i}") for i in range(P)],
        *[F.median(f).alias(f"a{i}") for i, f in enumerate(far)],
    )
    mads = stored(mads, "mads")
    variance = [F.pow(1.4826 * F.col(f"a{i}"), 2) + _FLOOR[i] for i in range(P)]
    middle, spread = [f"m{i}" for i in range(P)], [f"a{i}" for i in range(P)]
    diagonal = [
        (variance[i] if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _pairs()
    ]
    first = mads.select("_k", F.lit(0).alias("start"), *middle, *diagonal)

    near = rows.drop(*[f"d{i}" for i in range(P)]).join(mads, "_k")
    z = [(F.col(v) - F.col(f"m{i}")) / F.sqrt(variance[i]) for i, v in enumerate(VECTOR)]
    norm = reduce(lambda a, b: a + b, [x * x for x in z])
    # Signs are rounded so that their sums, too, do not depend on the order of addition.
    unit = [F.round(x / F.sqrt(F.greatest(norm, F.lit(1e-9))) * 1024) / 1024 for x in z]
    units = [u.alias(f"u{i}") for i, u in enumerate(unit)]
    signs = near.select("_k", *middle, *spread, *units)
    signs = signs.groupBy("_k").agg(
        *[F.first(c).alias(c) for c in middle + spread],
        *[(P * F.avg(F.col(f"u{i}") * F.col(f"u{j}"))).alias(f"g{i}_{j}") for i, j in _pairs()],
    )
    scaled = [
        (F.col(f"g{i}_{j}") * F.sqrt(variance[i] * variance[j]) + _floor(i, j)).alias(f"c{i}_{j}")
        for i, j in _pairs()
    ]
    second = signs.select("_k", F.lit(1).alias("start"), *middle, *scaled)
    third = _moments(rows, ["_k"]).withColumn("start", F.lit(2)).select(*first.columns)
    return first.union(second).union(third)


def _mcd(rows: DataFrame) -> DataFrame:
    """Per key: the whitened reweighted estimate and `scale`, what distances are divided by."""
    keys = ["_k", "start"]
    estimate = stored(_whitened(_starts(rows), keys), "estimates")
    for _ in range(STEPS):
        placed = rows.join(estimate, "_k").withColumn("bin", _bin(_distance()))
        placed = placed.select(*keys, "bin", *VECTOR)
        cut = _cut(placed, keys, KEPT_SHARE)
        kept = placed.join(stored(cut, "cuts"), keys).where("bin <= cut")
        estimate = stored(_whitened(_moments(kept, keys), keys), "estimates")
    values = F.struct(*[F.col(c) for c in estimate.columns if c not in keys])
    best = F.min_by(values, F.struct("det", "start"))
    estimate = stored(estimate.groupBy("_k").agg(best.alias("e")).select("_k", "e.*"), "estimates")
    for last in (False, True):
        placed = rows.join(estimate, "_k").withColumn("bin", _bin(_distance()))
        placed = placed.select("_k", "bin", *VECTOR)
        middle = _cut(placed, ["_k"], 0.5)
        centre = F.pow(F.lit(2.0), (F.col("cut") + 0.5) / _BINS)
        scale = F.greatest(centre / _chi2(0.5), F.lit(0.05))
        scales = stored(middle.select("_k", scale.alias("scale")), "scales")
        if last:
            return stored(estimate.join(scales, "_k"), "estimates")
        weighed = placed.join(scales, "_k").where(
            F.col("bin") <= F.floor(F.log2(F.col("scale") * _chi2(0.975)) * _BINS)
        )
        estimate = stored(_whitened(_moments(weighed, ["_k"]), ["_k"]), "estimates")


def judged(rows: DataFrame) -> DataFrame:
    """`measured` rows, stored, with `distance` (squared, robust) and `kept`.

    Groups are estimated from the rows that pass the base rules. A row whose group has no
    estimate, all rows having failed, has a null distance and fails by the base rules.
    """
    passed = rows.where(~F.col("base_failed"))
    chosen = stored(_chosen(passed), "levels")
    used = chosen.select("_k").distinct()
    spread = passed.select(F.explode(F.array("_k2", "_k1", "_k0")).alias("_k"), *VECTOR)
    sample = stored(spread.join(used, "_k", "left_semi"), "statistics")
    estimate = _mcd(sample)
    found = rows.join(chosen, "_k2", "left").join(estimate, "_k", "left")
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    found = found.select(*rows.columns, distance.alias("distance"))
    near = F.coalesce(F.col("distance") <= FARTHEST, F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & near)


def quality_rules(
    docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per row of `docs`: record, the base statistics, base_failed, distance, kept.

    `docs` has lang and source; nulls in them form groups of their own. Null, empty and very
    short texts fail the base rules; repeated rows are judged each; an empty table gives no
    rows. Columns of `docs` are inside `record`, so their names cannot clash.
    """
    rows = stored(measured(docs, text, carry), "measured")
    return judged(rows).select("record", *BASE, "base_failed", "distance", "kept")
