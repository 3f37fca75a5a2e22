"""Batch operators against plain loops, with odd groups."""

import math
import statistics as st

import pytest
from pyspark.sql import functions as F

from tandemline.functions.keyed import u
from tandemline.operators import batches as B

ARMS, SEEDS = ["F", "O"], [0, 1]


@pytest.fixture(scope="module")
def wide(spark):
    cells = [F.pmod(F.xxhash64("chunk", F.lit(f"{k}{a}{s}")), F.lit(3)).alias(f"{k}_{a}{s}") for a in ARMS for s in SEEDS for k in ("tp", "fp")]
    d = spark.range(60).select(F.col("id").alias("chunk"), (F.col("id") % 6).alias("session"))
    return d.select("*", F.when(F.col("chunk") % 4 == 0, 2).otherwise(0).alias("n_gt"), *cells).cache()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_smallest_is_the_first_of_the_order(spark, parts):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("g"), (F.floor(u(1, "id") * 50) / 50).alias("r")).repartition(parts)
    got = B.smallest(df, ["g"], "r", ["id"], F.when(F.col("g") == 0, 700).otherwise(5000))
    rows = df.collect()
    want = {r.id for r in sorted((r for r in rows if r.g == 0), key=lambda r: (r.r, r.id))[:700]} | {r.id for r in rows if r.g}
    found = [r.id for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_balanced_draw_takes_copies_that_exist(spark):
    df = spark.range(200).select("id", (F.col("id") % 9).alias("unit"), (F.col("id") % 3 == 0).cast("int").alias("cls"))
    df = df.unionByName(spark.createDataFrame([(999, 3, 7)], df.schema))  # a class of one row
    draw = B.balanced_draw(df, "unit", "cls", "id", 40, 12, 5).collect()
    unit, cls = ({r.id: r[c] for r in df.collect()} for c in ("unit", "cls"))
    taken, single = {}, 0
    for r in draw:
        assert cls[r.id] == r.cls
        taken[r.b, r.cls] = taken.get((r.b, r.cls), 0) + r.w
        single += r.w if r.cls == 7 else 0
    assert all(n == 40 for (b, c), n in taken.items() if c == 0) and all(n <= 40 for n in taken.values())
    # copies come from the unit's multiplicity: nine draws a replicate, so a unit of three copies can give a row three times
    most = {}
    for r in draw:
        most[r.b, unit[r.id]] = max(most.get((r.b, unit[r.id]), 0), r.w)
    assert all(sum(most.get((b, x), 0) for x in range(9)) <= 9 for b in range(12)) and single <= 12 * 9


def test_reweighting_reaches_its_prevalence(wide):
    got = B.boot_reweighted(wide, F.col("n_gt") > 0, 0.6, 400, ARMS, SEEDS, 8, 3).collect()
    assert len(got) == 8 and abs(st.mean(r.prevalence for r in got) - 0.6) < 0.05
    only = B.boot_reweighted(wide.filter("n_gt > 0"), F.col("n_gt") > 0, 1.0, 50, ARMS, SEEDS, 3, 3).collect()
    assert {r.prevalence for r in only} == {1.0}
    with pytest.raises(ValueError):
        B.boot_reweighted(wide.filter("n_gt > 0"), F.col("n_gt") > 0, 0.5, 50, ARMS, SEEDS, 3, 3)


def test_a_batch_that_is_the_whole_pool(wide):
    r = {x.measure: x for x in B.batch_percentile(wide, wide, F.col("n_gt") > 0, ARMS, SEEDS, 5, 6, 2).collect()}
    d = r["delta"]
    assert abs(d.observed - d["mean"]) < 1e-12 and d.sd < 1e-12 and d.sd_fresh is None and d.z is None and r["se"].draws == 5
    with pytest.raises(ValueError):
        B.batch_percentile(wide.filter("chunk < 8"), wide, F.col("n_gt") > 0, ARMS, SEEDS, 5, 6, 2)


def test_order_effect_of_a_trend(spark):
    up = spark.range(12).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    r = B.order_effect(up, "i", "v", 99, 4).first()
    assert r.n == 12 and abs(r.r_trend - 1) < 1e-12 and abs(r.r_lag1 - 1) < 1e-12 and r.p_trend == 0.0 and r.p_lag1 == 0.0


def test_leaving_out_one_run(spark):
    xs, ys = [1.0, 2.0, 3.0, 5.0, 8.0], [2.0, 1.0, 4.0, 4.0, 9.0]
    mk = lambda v: spark.createDataFrame(list(enumerate(v)), "run long, f double")
    got = {r.run: r for r in B.cross_set_corr(mk([*xs, 7.0]), mk(ys), "run", "f").collect()}
    for i in range(5):
        rest = lambda v: v[:i] + v[i + 1:]
        assert abs(got[i].loo_r - st.correlation(rest(xs), rest(ys))) < 1e-12
    assert got[0].n == 5 and abs(got[0].r - st.correlation(xs, ys)) < 1e-12 and abs(got[0].r_critical - 3.182 / math.sqrt(3 + 3.182**2)) < 1e-9
    assert abs(got[0].rho - st.correlation(xs, ys, method="ranked")) < 1e-12


def test_a_negative_rest_is_kept(spark):
    rows = [(g, s, a, v) for g, s, f, o in ((0, 0, 1.0, 1.1), (0, 1, 2.0, 2.1), (1, 0, 1.0, 2.0), (1, 1, 1.0, 4.0), (1, 2, 1.0, None)) for a, v in (("F", f), ("O", o))]
    r = B.split_variance(spark.createDataFrame(rows, "g long, s long, a string, v double"), "g", "s", "a", ARMS, "v").first()
    assert (r.n_0, r.n_1) == (2, 2) and abs(r.rest + 2.0) < 1e-9 and r.share_run_0 > 0.99 and abs(r.share_run_1) < 1e-9


def test_repeats_against_configurations(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 5.0), ("b", 1, 7.0), ("c", 0, 6.0), ("c", 1, None)]
    r = B.replicate_noise(spark.createDataFrame(rows, "c string, k long, v double"), "c", "k", "v").first()
    assert (r.configs, r.repeated) == (3, 2) and abs(r.sd_repeat - 2**0.5) < 1e-12 and abs(r.sd_config - st.stdev([2, 6, 6])) < 1e-12


def test_dropping_a_node(spark):
    rows = [("A", n, v) for n, v in ((0, 1.0), (0, 2.0), (1, 4.0), (1, 9.0), (2, None))] + [("B", 0, 3.0)]
    got = {(r.s, r.n_): r for r in B.drop_group_check(spark.createDataFrame(rows, "s string, n_ long, v double"), "s", "n_", "v").collect()}
    assert abs(got["A", 0].sd_without - st.stdev([4, 9])) < 1e-12 and abs(got["A", 1].sd - st.stdev([1, 2, 4, 9])) < 1e-12
    assert got["B", 0].sd is None and got["B", 0].sd_without is None and ("A", 2) not in got
