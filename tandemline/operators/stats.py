"""Correlations, effect size and small-sample tests as aggregates; resampling by explode, never by a cross join."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keyed import u
from .scan import average_rank, uniform_rank

#: Normal quantile of 97.5 %.
Z975 = 1.959963984540054
#: Student's t quantiles of 97.5 % for 1 to 30 degrees of freedom; beyond them ``t975`` expands in 1 / k.
T975 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]


def t975(k: Column) -> Column:
    """Student's t quantile of 97.5 % at ``k`` degrees of freedom: the table, then the normal quantile's expansion in 1 / k."""
    z = Z975
    more = (z**3 + z) / 4 / k + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / k**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / k**3
    more = more + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160 / k**4
    return F.when(k > 0, F.coalesce(F.get(F.array(*[F.lit(x) for x in T975]), (k - 1).cast("int")), z + more))


def corr_report(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson, Spearman (ties share their mean rank), least-squares line and log-log slope of complete pairs."""
    d = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    d = average_rank(average_rank(d, "x", "rx", by), "y", "ry", by)
    both = (F.col("x") > 0) & (F.col("y") > 0)
    log = lambda c: F.when(both, F.log(c))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"),
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_slope(log("y"), log("x")).alias("log_slope"),
    )


def partial_corr(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y with z held constant, over complete rows."""
    d = df.dropna(subset=[x, y, z])
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    rest = F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))
    return g.select(*by, "n", F.when(rest > 0, (F.col("xy") - F.col("xz") * F.col("yz")) / rest).alias("partial"))


def cohens_d(df: DataFrame, by: list[str], group: Column, features: list[str]) -> DataFrame:
    """Difference of means of ``group`` true and false over the pooled SD, for each feature; one aggregate for all."""
    aggs = []
    for i, f in enumerate(features):
        for side, c in (("a", group), ("b", ~group)):
            v = F.when(c, F.col(f).cast("double"))
            aggs += [F.count(v).alias(f"n{side}{i}"), F.avg(v).alias(f"m{side}{i}"), F.var_samp(v).alias(f"v{side}{i}")]
    g = df.groupBy(*by).agg(*aggs)
    one = lambda i: F.struct(F.lit(features[i]).alias("feature"), *[F.col(f"{k}{s}{i}").alias(k + s) for s in "ab" for k in "nmv"])
    long = g.select(*by, F.inline(F.array(*[one(i) for i in range(len(features))])))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    ok = (F.col("na") > 1) & (F.col("nb") > 1) & (pooled > 0)
    return long.select(*by, "feature", F.col("na").alias("n_a"), F.col("nb").alias("n_b"), F.when(ok, (F.col("ma") - F.col("mb")) / pooled).alias("d"))


def sign_test(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """One-sided binomial tail of the number of negative differences; 1 without a difference.

    Counts up to 1,000 are summed as whole numbers, more by the incomplete beta function, which is the same tail.
    """

    @F.pandas_udf("double")
    def tail(n: pd.Series, k: pd.Series) -> pd.Series:
        def one(n: int, k: int) -> float:
            if k == 0:
                return 1.0
            return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n if n <= 1000 else _beta_share(0.5, k, n - k + 1)

        return pd.Series([one(int(a), int(b)) for a, b in zip(n, k)], dtype="float64")

    g = df.filter(F.col(d).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(d) < 0).alias("n_neg"))
    return g.select(*by, "n", "n_neg", tail("n", "n_neg").alias("p"))


def variance_ratio_perm(df: DataFrame, value: str, second: Column, key: list[str], n: int, seed: int) -> DataFrame:
    """Ratio of the variances of the ``second`` and the first group, and its share (hits + 1) / (n + 1) under random splits.

    A split takes the rows in keyed-random order, as many as the first group has for the first part.
    """
    pool = df.select(*key, F.col(value).cast("double").alias("v"), second.cast("int").alias("s")).filter("v is not null and s is not null")
    part = lambda c: F.var_samp(F.when(c, F.col("v")))
    obs = pool.agg(F.count_if(F.col("s") == 0).alias("na"), (part(F.col("s") == 1) / part(F.col("s") == 0)).alias("obs"))  # one row
    reps = pool.select(*key, "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b"))
    ranked = uniform_rank(reps.withColumn("__u", u(seed, "b", *key)), ["b"], "__u", key, "rn").crossJoin(F.broadcast(obs))
    first = F.col("rn") <= F.col("na")
    f = ranked.groupBy("b").agg((part(~first) / F.greatest(part(first), F.lit(1e-12))).alias("f"), F.first("obs").alias("obs"))
    return f.groupBy("obs").agg(((F.count_if(F.col("f") >= F.col("obs") * (1 - 1e-12)) + 1) / (n + 1)).alias("p"))


def _chi2(k: Column, z: float) -> Column:
    """Chi-squared quantile by the cube approximation of Wilson and Hilferty."""
    return k * F.pow(1 - 2 / (9 * k) + z * F.sqrt(2 / (9 * k)), F.lit(3.0))


def sd_ci(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """SD with its 95 % interval, and the 95 % interval in which a new run is expected.

    A group of one value keeps its mean; its SD and bounds are null, as are all figures of a group without a value.
    """
    g = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))
    k = F.when(F.col("n") > 1, F.col("n") - 1)
    bound = lambda z: F.col("sd") * F.sqrt(k / _chi2(k, z))
    half = t975(k) * F.col("sd") * F.sqrt(1 + 1 / F.col("n"))
    return g.select(
        *by, "n", "mean", "sd", bound(Z975).alias("sd_lo"), bound(-Z975).alias("sd_hi"), (F.col("mean") - half).alias("new_lo"), (F.col("mean") + half).alias("new_hi"),
    )


def _poisson_sf(k: Column, h: Column) -> Column:
    """Chance of fewer than ``k`` events at mean ``h``; this is also the chi-squared tail at 2h with 2k degrees.

    The terms are summed relative to the largest of their side, whose logarithm is taken on its own: downwards from k - 1
    where k is at most h, else upwards from k for the complement. Both sides fall away and end once their terms count
    for nothing (after some tens of roots of h), so no list of k values is made and nothing underflows.
    """

    @F.pandas_udf("double")
    def tail(k: pd.Series, h: pd.Series) -> pd.Series:
        def log_weight(i: int, h: float) -> float:
            return (i * math.log(h) if i else 0.0) - h - math.lgamma(i + 1)

        def run(i: int, h: float, step: int, stop: int) -> float:
            """Sum of the terms from i on by ``step`` until ``stop`` (not included), relative to that of i."""
            total, term, at = 0.0, 1.0, i
            while at != stop and term > 1e-18 * total:
                total += term
                term *= h / (at + 1) if step > 0 else at / h
                at += step
            return total

        def one(k: int, h: float) -> float:
            if h <= 0:
                return 1.0
            if k <= h:  # terms grow up to k - 1
                return math.exp(min(0.0, log_weight(k - 1, h) + math.log(run(k - 1, h, -1, -1))))
            return max(0.0, 1.0 - math.exp(log_weight(k, h) + math.log(run(k, h, 1, -1))))  # terms fall from k on

        return pd.Series([one(int(a), float(b)) for a, b in zip(k, h)])

    return F.when(F.isnan(h), h).otherwise(tail(k, F.nanvl(h, F.lit(0.0))))


def fisher_combined(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """Fisher's combination of independent p values; the tail is closed as the degrees of freedom are even.

    A value of 0 makes the combined p 0 and chi2 infinite. Null and NaN are left out; a value outside 0 to 1 ends the job.
    """
    value = F.nanvl(F.col(p).cast("double"), F.lit(None).cast("double"))
    sound = F.when((value < 0) | (value > 1), F.raise_error(F.concat(F.lit("not a p value: "), value.cast("string"))).cast("double")).otherwise(value)
    d = df.select(*by, sound.alias("__p")).filter("__p is not null")
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.count_if(F.col("__p") == 0).alias("zero"),
        F.coalesce(-F.sum(F.when(F.col("__p") > 0, F.log("__p"))), F.lit(0.0)).alias("h"))
    chi2 = F.when(F.col("zero") > 0, F.lit(float("inf"))).otherwise(2 * F.col("h"))
    return g.select(*by, "k", chi2.alias("chi2"), F.when(F.col("zero") > 0, 0.0).otherwise(_poisson_sf(F.col("k"), F.col("h"))).alias("p"))


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    below = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1 / below(1 - (a + b) * x / (a + 1))
    total, i, change = d, 0, 0.0
    while abs(change - 1) > 1e-15 and i < 100_000:
        i += 1
        for term in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1 / below(1 + term * d), below(1 + term / c)
            change = c * d
            total *= change
    return front * total


def f_ratio(df: DataFrame, by: list[str], value: str, second: Column) -> DataFrame:
    """Variance of the ``second`` group over that of the first, and its two-sided p under normal values.

    Null where a group has fewer than two values or the first does not vary.
    """

    @F.pandas_udf("double")
    def tail(f: pd.Series, ka: pd.Series, kb: pd.Series) -> pd.Series:
        one = lambda r, a, b: 2 * min(q := _beta_share(a * r / (a * r + b), a / 2, b / 2), 1 - q)
        return pd.Series([min(1.0, one(r, a, b)) if r >= 0 else None for r, a, b in zip(f, ka, kb)], dtype="float64")

    v = F.col(value).cast("double")
    part = lambda s: F.when(second if s else ~second, v)
    g = df.groupBy(*by).agg(
        F.count(part(0)).alias("n_first"), F.count(part(1)).alias("n_second"), F.var_samp(part(0)).alias("var_first"), F.var_samp(part(1)).alias("var_second"))
    g = g.withColumn("f", F.col("var_second") / F.nullif(F.col("var_first"), F.lit(0.0)))
    return g.withColumn("p", F.nullif(tail("f", F.col("n_second") - 1, F.col("n_first") - 1), F.lit(float("nan"))))


def zscore(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``df`` with ``{col}_z`` over all rows and ``{col}_zk`` within ``by``; a population SD of 0 counts as 1.

    Means and deviations are aggregated first and joined back, so no group of rows comes into one task. Rows with a null
    key form a group of their own; null values stay null.
    """
    def moments(tag: str) -> list[Column]:
        return [f(c).alias(f"__{tag}{name}{c}") for c in cols for name, f in (("m", F.avg), ("s", F.stddev_pop))]

    def z(c: str, tag: str) -> Column:
        s = F.col(f"__{tag}s{c}")
        return (F.col(c) - F.col(f"__{tag}m{c}")) / F.when(s == 0, 1.0).otherwise(s)

    groups = df.groupBy(*[F.col(k).alias(f"__k{k}") for k in by]).agg(*moments("k"))
    same = None
    for k in by:
        test = F.col(k).eqNullSafe(F.col(f"__k{k}"))
        same = test if same is None else same & test
    joined = df.crossJoin(F.broadcast(df.agg(*moments("a")))).join(groups, same)  # one row of totals
    return joined.select(*df.columns, *[z(c, "a").alias(f"{c}_z") for c in cols], *[z(c, "k").alias(f"{c}_zk") for c in cols])


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table; 1 where both are trivial in the same way."""
    two = lambda c: F.sum(c.cast("double") * (c - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda col: cells.groupBy(col).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias(f"pairs_{col}"))
    both = cells.agg(two(F.col("n")).alias("pairs"), F.sum("n").alias("n"))
    row = both.crossJoin(F.broadcast(pairs(a))).crossJoin(F.broadcast(pairs(b)))  # three tables of one row
    pa, pb, n = F.col(f"pairs_{a}"), F.col(f"pairs_{b}"), F.col("n")
    chance = F.coalesce(pa * pb / F.nullif(n.cast("double") * (n - 1) / 2, F.lit(0.0)), F.lit(0.0))
    top = (pa + pb) / 2 - chance
    return row.select("n", F.when(top == 0, 1.0).otherwise((F.col("pairs") - chance) / F.nullif(top, F.lit(0.0))).alias("ari"))


def prevalence_diff(df: DataFrame, pool: str, cluster: str, positive: Column) -> DataFrame:
    """Prevalence of ``positive`` in pools 0 and 1, their difference, and its standard error and t over clusters.

    Rows of a cluster are not independent: the error of each share comes from the clusters' deviations from it.
    """
    per = df.groupBy(pool, cluster).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("y"))
    sums = per.groupBy(pool).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("y").alias("y"),
        F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("y") * F.col("n")).alias("yn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    p = F.col("y") / F.col("n")
    spread = F.col("yy") - 2 * p * F.col("yn") + p * p * F.col("nn")
    var = F.col("k") / F.nullif(F.col("k") - 1, F.lit(0)) * spread / (F.col("n") * F.col("n"))
    at = lambda i, c: F.max(F.when(F.col(pool) == i, F.col(c)))
    out = sums.withColumns({"p": p, "var": var}).agg(
        at(0, "p").alias("p0"), at(1, "p").alias("p1"), at(0, "k").alias("k0"), at(1, "k").alias("k1"), F.sqrt(at(0, "var") + at(1, "var")).alias("se"))
    diff = F.col("p1") - F.col("p0")
    return out.select("p0", "p1", "k0", "k1", diff.alias("diff"), "se", (diff / F.nullif(F.col("se"), F.lit(0.0))).alias("t"))
