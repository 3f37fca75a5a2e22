"""Literal cases for the rules a naive rewrite gets wrong, and brute force for the order-dependent ones."""

import random

from pyspark.sql import functions as F

from tandemline.functions import text as X
from tandemline.operators import agreement as A, frames as D, intervals as I, matching as M, sampling as G, scan as S, timeline as T


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_merge_touching(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 2.5, 3.0)], "k long, s double, e double")
    for span in (0.4, 1000.0):  # bucket size never changes the result
        assert rows(I.merge_intervals(df, ["k"], span=span), "s") == [(1, 0.0, 2.0), (1, 2.5, 3.0)]


def test_runs_bridge_gaps_and_close_open_tail(spark):
    flags = [1, 1, 0, 0, 1, 0, 0, 0, 1, 0]
    df = spark.createDataFrame([(1, i, float(i), i + 1.0, f) for i, f in enumerate(flags)], "k long, idx long, t0 double, t1 double, f int")
    ev = D.runs_to_events(df, ["k"], F.col("f") == 1, 2, span=3).select("s", "e")
    assert rows(ev, "s") == [(0.0, 5.0), (8.0, 10.0)]


def test_asof_tie_takes_earlier(spark):
    l = spark.createDataFrame([(1, 1, 1.0)], "k long, q long, t double")
    r = spark.createDataFrame([(1, 1, 0.0, "a"), (1, 2, 2.0, "b")], "k long, rid long, t double, v string")
    assert D.asof_nearest(l, r, ["k"], "t", "rid", "v", span=0.5).select("near_t", "near_v").collect()[0] == (0.0, "a")


def test_pad_merge_last_end_wins(spark):
    df = spark.createDataFrame([(1, 10.0, 50.0), (1, 20.0, 22.0)], "k long, s double, e double")
    assert rows(I.pad_merge(df, ["k"], F.lit(1000.0), 5.0, 2.0), "s") == [(1, 5.0, 27.0)]


def test_union_f1_is_not_mean_f1(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (2, 0, 3, 0)], "chunk long, tp long, fp long, n_gt long")
    pooled = M.prf(df, []).collect()[0]["f1"]
    mean = M.prf(df, ["chunk"]).agg(F.avg("f1")).collect()[0][0]
    assert abs(pooled - 0.4) < 1e-12 and abs(mean - 0.5) < 1e-12


def test_perfect_votes_give_one(spark):
    df = spark.createDataFrame([(3, 0), (0, 3), (4, 0), (1, 0)], "a long, b long")
    r = A.fleiss_and_ac1(df, ["a", "b"]).collect()[0]
    assert r["kappa"] == 1.0 and r["ac1"] == 1.0 and r["n_slots"] == 3


def test_running_matches_brute_force(spark):
    rnd = random.Random(1)
    data = [(k, i, rnd.choice([None, rnd.random()])) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(data, "k long, i long, v double").repartition(7)
    out = S.running(df, ["k"], F.floor(F.col("i") / 7), ["i"], {"mx": ("max", "v"), "last_v": ("last", "v")}).collect()
    for r in out:
        prev = [v for k, i, v in data if k == r["k"] and i < r["i"] and v is not None]
        assert r["mx"] == (max(prev) if prev else None) and r["last_v"] == (prev[-1] if prev else None)


def test_greedy_collar_matches_brute_force(spark):
    rnd = random.Random(2)
    ref = sorted(rnd.uniform(0, 60) for _ in range(30))
    hyp = sorted(rnd.uniform(0, 60) for _ in range(30))
    used, want = set(), {}
    for i, r in enumerate(ref):
        near = [(abs(h - r), j) for j, h in enumerate(hyp) if abs(h - r) <= 1.0 and j not in used]
        if near:
            used.add(min(near)[1])
            want[i] = min(near)[1]
    mk = lambda xs: spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k long, id long, t double")
    got = {r["ref_id"]: r["hyp_id"] for r in M.match_collar(mk(ref), mk(hyp), ["k"], 1.0, 10.0).collect()}
    assert got == want


def test_match_events_takes_each_window_once(spark):
    p = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.1)], "chunk long, ord long, t double")
    w = spark.createDataFrame([(1, 1, 5.0, 5.2)], "chunk long, ord long, a double, b double")
    assert tuple(M.match_events(p, w, "chunk").collect()[0]) == (1, 1, 1, 1, 2)


def test_wer_free_prefix(spark):
    df = spark.createDataFrame([("a b c d", "c d"), ("a b", "")], "r string, h string")
    out = df.select(X.wer(F.col("r"), F.col("h"), True).alias("f"), X.wer(F.col("r"), F.col("h"), False).alias("p")).collect()
    assert out[0] == (0.0, 0.5) and out[1] == (None, None)


def test_exact_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert S.exact_quantiles(df, [], "v", {"q": 0.25}).collect()[0]["q"] == 2.25


def test_session_without_user_segments(spark):
    user = spark.createDataFrame([(1, 0.0, 2.0)], "k long, u_s double, u_e double")
    agent = spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, 1.0)], "k long, a_s double, a_e double")
    r = I.turn_taking_rules(user, agent, ["k"], 60.0, 1000.0).select("k", "n_round", "n_interrupt", "n_succ", "sir", "eir")
    assert rows(r, "k") == [(1, 1, 0, 0, None, 0.0), (2, 0, 0, 0, None, None)]


def test_otsu_returns_every_group(spark):
    import math

    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 5.0), ("c", -1.0), ("c", None)], "g string, v double")
    got = dict(rows(D.otsu(df, ["g"], "v"), "g"))
    assert set(got) == {"a", "b", "c"} and got["b"] == got["c"] == 0.0
    assert abs(got["a"] - math.exp(math.log(2.0) - 0.5 + 0.5 / 256)) < 1e-9


def test_adjacent_off_the_grid(spark):
    schema = "k long, c string, t double"
    used = spark.createDataFrame([(1, "u", 450.0)], schema)
    cands = spark.createDataFrame([(1, "same", 450.0), (1, "near", 453.0), (1, "touch", 460.0), (2, "other", 453.0)], schema)
    assert rows(G.flag_adjacent(cands, used, ["k"], "t", 10.0).select("c"), "c") == [("near",)]


def test_all_rounds_are_split(spark):
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(5 - k)], "k long, i long")
    got = rows(G.split_rounds(df, ["k"], F.col("i") / 8, ["i"], 2), "batch")
    assert got == [(0, 4, 2, 1), (1, 3, 2, 0)]


def test_context_is_whole_unless_cut(spark):
    w = spark.createDataFrame([(1, 7, 10.0, 11.0)], "k long, wid long, a double, b double")
    u = spark.createDataFrame([(1, 9.0, 12.0, "x" * 900)], "k long, s double, e double, text string")
    whole = T.side_text(w, u, ["k"], "wid", 5.0, 60.0).first()
    assert whole["context"] == "[-1.0s] " + "x" * 900
    cut = T.side_text(w, u, ["k"], "wid", 5.0, 60.0, max_chars=20).first()
    assert cut["context"] == whole["context"][:20] + "…" and cut["truncated"]
