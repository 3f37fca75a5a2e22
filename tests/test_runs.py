"""Frames made from runs: the same results as by brute force, and no shuffle or broadcast of frames."""

from pyspark.sql import functions as F

from tandemline.operators import frames as D
from tandemline.plans.catalog import QUERIES, bound, load

SMALL = "/root/testdata/sf0.001"


def above_cache(df):
    """The plan's lines outside the cached runs."""
    text = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out, depth = [], None
    for line in text:
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            continue
        depth = at if "InMemoryRelation" in line else None
        out.append(line)
    return out


def query(spark, name):
    load()
    return bound(QUERIES[name])(spark, SMALL)


def test_two_channels_meet_without_a_join(spark):
    a = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.1), (2, 5, 0.7)], "k long, idx long, v double")
    b = spark.createDataFrame([(1, 5, 0.2), (1, 7, 0.8), (2, 5, None)], "k long, idx long, v double")
    rows = {tuple(r) for r in D.on_both(a, b, ["k"]).collect()}
    assert rows == {(1, 5, 0.9, 0.2), (2, 5, 0.7, None)}
    for name in ("d15_fuse", "d19_activity_states"):
        assert not [x for x in above_cache(query(spark, name)) if "Join" in x], name


def test_onsets_need_no_join_of_frames(spark):
    rows = [("a", i, int(i % 3 == 0), int(i in (1, 2, 5, 8, 15, 16, 23))) for i in range(40) if i not in (12, 13, 30)]
    f = spark.createDataFrame(rows, "k string, idx long, spk int, lis int")
    w = spark.createDataFrame([("a", 5, "yes"), ("a", 5, "no")], "k string, idx long, token string")
    want = sorted(tuple(r) for r in D.outcome_labels(f, w, "k", 2, 4, ["yes"]).collect())
    spk = {r[1] for r in rows if r[2]}
    assert [(r[1], round(r[3] * 3)) for r in want] == [(i, sum(i + d in spk for d in (2, 3, 4))) for i in (1, 5, 8, 15, 23)]
    assert sorted(tuple(r) for r in D.outcome_labels(f, w, "k", 2, 4, ["yes"], span=8).collect()) == want
    assert len([x for x in above_cache(query(spark, "d25_outcome_labels")) if "Join" in x]) == 1  # the words


def test_windows_meet_runs(spark):
    runs = spark.createDataFrame([(1, 3, 9), (1, 12, 30), (2, 0, 5)], "k long, s long, e long")
    wins = [(1, 0, 2.5, 4.0), (2, 1, 8.5, 13.5), (3, 2, 7.0, 9.0), (4, 1, 29.0, 29.0)]
    w = spark.createDataFrame([(1 if k else 1, i, a, b) if k != 2 else (2, i, a, b) for i, k, a, b in wins], "k long, wid long, a double, b double")
    p = (F.col("idx") / 100).alias("p")
    frames = {(k, i) for k, s, e in ((1, 3, 9), (1, 12, 30), (2, 0, 5)) for i in range(s, e + 1)}
    rows = [tuple(r) for r in w.collect()]
    for late in (0, 2):
        want = {(wid, i) for k, wid, a, b in rows for kk, i in frames if k == kk and i + late < b and i + 1 + late > a}
        got = D.window_frames(w, runs, ["k"], "wid", 4.0, p, late).select("wid", "idx").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    for rule, on in (("midpoint", lambda i, a, b: a <= i + 0.5 <= b), ("overlap", lambda i, a, b: i < b and i + 1 > a)):
        got = D.marked_frames(runs, w, ["k"], 4, p, rule, 10.0).select("k", "idx", "inside").collect()
        assert sorted(tuple(r) for r in got) == sorted((k, i, int(any(k == r[0] and on(i, r[2], r[3]) for r in rows))) for k, i in frames)


def test_long_runs_go_on_over_blocks(spark):
    on = {*range(2, 19), 25, 26, 40}
    f = spark.createDataFrame([(7, i, i in on) for i in range(50)], "k long, idx long, x boolean")
    r = D.realized_from_frames(f, ["k"], F.col("x"), 1.0, span=4).collect()[0]
    assert (r.frac, r.max_span) == (len(on) / 50, 17.0)


def test_auc_of_repeated_and_distinct_scores(spark):
    from tandemline.operators.agreement import auc

    for rows in ([(i * 7 % 97 / 97, i % 3 % 2) for i in range(97)], [(i % 4 / 4, i % 3 % 2) for i in range(97)]):
        pos, neg = [v for v, y in rows if y], [v for v, y in rows if not y]
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        got = auc(spark.createDataFrame(rows, "v double, y int"), "v", "y").collect()[0]
        assert (got.n_pos, got.n_neg) == (len(pos), len(neg)) and abs(got.auc - want) < 1e-12


def test_chunks_need_one_grouping(spark):
    from tandemline.operators.agreement import array_auc

    f = spark.createDataFrame([(1, i, float(i), i + 1.0, i % 7 / 7) for i in range(20) if i != 11], "k long, idx long, t0 double, t1 double, p double")
    w = spark.createDataFrame([(1, 3.5, 4.5), (1, 12.0, 14.0), (1, 70.0, 71.0)], "k long, a double, b double")
    got = {r.c0: (list(r.curve), list(r["mask"]), r.n_frames) for r in D.block_truth(f, w, ["k"], 5, 2.0, 5.0).collect()}
    have = {i: i % 7 / 7 for i in range(20) if i != 11}
    assert set(got) == {-5.0, 0.0, 5.0, 10.0, 15.0}
    for c0, (curve, mask, n) in got.items():
        lo = [int(c0) + 2 * k for k in range(5)]
        assert curve == [max([have[i] for i in (x, x + 1) if i in have], default=0.0) for x in lo]
        assert mask == [int(any(x < b and x + 2 > a for a, b in ((3.5, 4.5), (12.0, 14.0)))) for x in lo]
        assert n == sum(c0 <= i < c0 + 10 for i in have)
    a = spark.sql("select array(0.5D, 0.2D, 0.5D, 0.9D) s, array(1, 0, 0, 1) y").select(array_auc(F.col("s"), F.col("y")).alias("a"))
    assert a.collect()[0].a == 3.5 / 4
    for name in ("d10_block_curve", "d12_state_words", "e15_behavior_metrics", "e17_peak_decision", "e19_sequence_scores"):
        assert len([x for x in above_cache(query(spark, name)) if "hashpartitioning(session" in x and "REPARTITION" not in x]) == 0, name


def test_lag_sums_of_far_positions(spark):
    a = [(1, i, i * 0.37 % 1) for i in [*range(0, 40), *range(200, 230)]]
    b = [(1, i, i * 0.71 % 1) for i in [*range(5, 50), *range(190, 220)]]
    df = lambda r: spark.createDataFrame(r, "k long, idx long, v double")
    x, y = {i: v for _, i, v in a}, {i: v for _, i, v in b}
    for block in (16, 65536):
        for r in D.lag_sums(df(a), df(b), ["k"], 3, block).collect():
            pairs = [(x[i + r.lag], v) for i, v in y.items() if i + r.lag in x]
            assert r.n == len(pairs) and abs(r.sxy - sum(p * q for p, q in pairs)) < 1e-9


def test_rounded_times_agree_with_the_twin(spark):
    import duckdb

    from tandemline.plans.q_sources import CENTS_SQL

    v = [28401120.124999998, 28401120.125, 28401120.135, 28401120.134999998, 28401120.135000002, 0.005, 0.015, 1.0, 28401120.3333333]
    got = [r.t for r in spark.createDataFrame([(x,) for x in v], "s double").select(F.bround("s", 2).alias("t")).collect()]
    want = [duckdb.execute(f"SELECT {CENTS_SQL('s')} FROM (SELECT CAST(? AS DOUBLE) AS s)", [x]).fetchall()[0][0] for x in v]
    assert [round(t * 100) for t in got] == want
    assert got[0] != duckdb.execute("SELECT round_even(CAST(? AS DOUBLE), 2)", [v[0]]).fetchall()[0][0] or got[3] != duckdb.execute("SELECT round_even(CAST(? AS DOUBLE), 2)", [v[3]]).fetchall()[0][0]


def test_run_attribution_is_that_of_frames(spark):
    """frames made from runs where they are grouped give the same attribution as frames that are joined."""
    from pyspark.sql import functions as F
    from tandemline.functions.keyed import u
    from tandemline.operators import timeline as T
    from tandemline.operators.frames import run_frames

    runs = spark.createDataFrame([(1, 0, 3, 40), (1, 1, 10, 25), (1, 0, 50, 51), (2, 1, -4, 9)], "session long, ch long, s long, e long")
    utts = spark.createDataFrame([(1, 0, 2.5, 12.2), (1, 1, 11.0, 30.9), (1, 0, 12.0, 13.5), (2, 1, -9.5, 0.0)], "session long, speaker long, s double, e double")
    p = u(7, "session", "ch", "idx").alias("p")
    on = lambda k: F.coalesce(F.max(F.when(F.col("ch") == k, F.col("p"))), F.lit(0.0))
    f = run_frames(runs, p).groupBy("session", "idx").agg(on(0).alias("e_l"), on(1).alias("e_r"))
    f = f.select("*", F.col("idx").cast("double").alias("t"), (F.col("e_l") > 0.6).cast("int").alias("act_l"), (F.col("e_r") > 0.6).cast("int").alias("act_r"))
    want = sorted(map(tuple, T.channel_attribution(f, utts, "session", 1.0, 8.0).collect()))
    got = T.run_channel_attribution(runs, utts, "session", 8, p, 0.6)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 2
