"""Literal values of the small-sample statistics, with groups too small for them."""

import math

import pytest
from pyspark.sql import functions as F

from tandemline.operators import stats as S


def test_sign_test(spark):
    df = spark.createDataFrame([("a", d) for d in (-1.0, -2.0, -0.5, 0.0, 3.0)] + [("b", 1.0), ("b", None)], "g string, d double")
    got = {r["g"]: (r["n"], r["n_neg"], round(r["p"], 9)) for r in S.sign_test(df, ["g"], "d").collect()}
    assert got == {"a": (5, 3, 0.5), "b": (1, 0, 1.0)}


def test_fisher_of_one_value_is_that_value(spark):
    df = spark.createDataFrame([("a", 0.3), ("b", 0.5), ("b", 0.5)], "g string, p double")
    got = {r["g"]: round(r["p"], 6) for r in S.fisher_combined(df, ["g"], "p").collect()}
    assert got == {"a": 0.3, "b": 0.596574}


def test_effect_size_and_partial_correlation(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", True, 3.0), ("a", False, 0.0), ("a", False, 2.0), ("b", True, 1.0)], "g string, s boolean, v double")
    got = {r["g"]: r["d"] for r in S.cohens_d(df, ["g"], F.col("s"), ["v"]).collect()}
    assert abs(got["a"] - 0.5**0.5) < 1e-9 and got["b"] is None
    z = spark.createDataFrame([(1.0, 2.0, 0.0), (2.0, 1.0, 1.0), (3.0, 4.0, 1.0), (None, 9.0, 9.0)], "x double, y double, z double")
    assert S.partial_corr(z, [], "x", "y", "z").first()["n"] == 3


def test_permutations_count_the_observed_split(spark):
    df = spark.createDataFrame([(i, i < 3, float(v)) for i, v in enumerate([0, 50, 100, 1, 2, 3])], "i long, s boolean, v double")
    r = S.variance_ratio_perm(df, "v", F.col("s"), ["i"], 60, 3).first()
    assert abs(r["obs"] - 2500.0) < 1e-6 and 1 / 61 <= r["p"] < 0.3


def test_zscore_constant_and_null_groups(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, None, 1.0), (4, None, 3.0), (5, "b", None)], "id long, g string, x double")
    got = {r.id: r.x_zk for r in S.zscore(df, ["x"], ["g"]).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: -1.0, 4: 1.0, 5: None}


def test_ari_literals(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 0), (1, 1, 1), (1, 1, 0)], "a int, b int, c int")
    assert S.ari(df, "a", "b").first().ari == 1.0
    assert abs(S.ari(df, "a", "c").first().ari + 0.5) < 1e-12
    assert S.ari(df.limit(1), "a", "b").first().ari == 1.0


def test_prevalence_difference_of_clusters(spark):
    rows = [(0, 1, 1), (0, 1, 1), (0, 2, 0), (0, 2, 0), (1, 3, 1), (1, 4, 1)]
    r = S.prevalence_diff(spark.createDataFrame(rows, "pool int, c int, y int"), "pool", "c", F.col("y") == 1).first()
    assert (r.p0, r.p1, r["diff"], r.se, r.t) == (0.5, 1.0, 0.5, 0.5, 1.0)


def test_fisher_of_large_groups(spark):
    from math import exp, factorial

    from pyspark.sql import types as T

    sizes = [(1, 700.0), (3, 2.5), (40, 30.0), (40, 41.0), (20_000, 820.0), (20_000, 20_000.0), (1_000_000, 1_000_000.0), (800, 1000.0)]
    df = spark.createDataFrame([(k, h) for k, h in sizes], T.StructType([T.StructField("k", T.LongType()), T.StructField("h", T.DoubleType())]))
    got = {(r.k, r.h): r.p for r in df.select("k", "h", S._poisson_sf(F.col("k"), F.col("h")).alias("p")).collect()}
    exact = lambda k, h: sum(exp(-h) * h**i / factorial(i) for i in range(k))
    for k, h in sizes[1:4]:
        assert abs(got[k, h] - exact(k, h)) < 1e-12
    assert got[20_000, 820.0] == 1.0 and got[1, 700.0] < 1e-300 and got[800, 1000.0] < 1e-9
    assert abs(got[20_000, 20_000.0] - 0.5) < 0.01 and abs(got[1_000_000, 1_000_000.0] - 0.5) < 0.001
    rows = spark.range(20_000).select(F.lit("a").alias("g"), F.exp(F.lit(-0.041)).alias("p"))
    assert S.fisher_combined(rows, ["g"], "p").first().p == 1.0


def test_t_quantiles_beyond_the_table(spark):
    want = {1: 12.706, 30: 2.042, 31: 2.039513, 60: 2.000298, 120: 1.979930, 100_000: 1.959988}
    rows = spark.createDataFrame([(k,) for k in [0, *want]], "k long")
    got = {r.k: r.t for r in rows.select("k", S.t975(F.col("k")).alias("t")).collect()}
    assert got.pop(0) is None and all(abs(got[k] - t) < 1e-6 for k, t in want.items())


def test_groups_of_one_value_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {r.g: (r.n, r["mean"], r.sd, r.sd_lo, r.new_hi) for r in S.sd_ci(df, ["g"], "v").collect()}
    assert got["b"] == (1, 2.0, None, None, None) and got["c"] == (0, None, None, None, None) and got["a"][2] == 2**0.5


def test_fisher_with_zero_and_odd_values(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("b", 0.5), ("b", None), ("b", float("nan"))], "g string, p double")
    got = {r.g: (r.k, r.chi2, round(r.p, 9)) for r in S.fisher_combined(df, ["g"], "p").collect()}
    assert got["a"] == (2, float("inf"), 0.0) and got["b"][::2] == (1, 0.5)
    with pytest.raises(Exception, match="not a p value"):
        S.fisher_combined(df.withColumn("p", F.lit(1.5)), ["g"], "p").collect()


def test_no_difference_is_no_evidence(spark):
    assert tuple(S.sign_test(spark.createDataFrame([], "d double"), [], "d").first()) == (0, 0, 1.0)


def test_f_ratio_against_closed_tails(spark):
    # with 2 and 2 degrees of freedom the upper tail at f is 1 / (1 + f); with 2 and 4 it is (1 + f / 2) ** -2
    rows = [(0, v) for v in (-1.0, 0.0, 1.0)] + [(1, v) for v in (-3.0, 0.0, 3.0)]
    r = S.f_ratio(spark.createDataFrame(rows, "g int, v double"), [], "v", F.col("g") == 1).first()
    assert (r.n_first, r.n_second, r.f) == (3, 3, 9.0) and abs(r.p - 0.2) < 1e-12
    rows = [(0, v) for v in (-2.0, -1.0, 0.0, 1.0, 2.0)] + rows[3:]
    r = S.f_ratio(spark.createDataFrame(rows, "g int, v double"), [], "v", F.col("g") == 1).first()
    assert abs(r.p - 2 * (1 + 3.6 / 2) ** -2) < 1e-12
    assert S.f_ratio(spark.createDataFrame(rows[:6], "g int, v double"), [], "v", F.col("g") == 1).first().p is None


def test_sign_tail_of_many_differences(spark):
    n, k = 1200, 640
    df = spark.range(n).select(F.when(F.col("id") < k, -1.0).otherwise(1.0).alias("d"))
    exact = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
    assert abs(S.sign_test(df, [], "d").first().p / exact - 1) < 1e-9
