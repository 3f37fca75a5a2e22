"""Operators that make frames inside their tasks, against frames written out."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemline.functions.keyed import keyed_runs, u
from tandemline.operators import frames as D, pieces as S

RUNS = [(0, 0, 0, 70), (0, 0, 73, 90), (0, 0, 120, 121), (0, 1, 60, 66), (0, 1, -40, -3), (7, 1, 9_999_990, 10_000_050), (123456, 0, 5, 5)]


def frames_of(spark):
    runs = spark.createDataFrame(RUNS, "session long, ch long, s long, e long")
    return runs, D.run_frames(runs, u(7, "session", "ch", "idx").alias("p"))


def test_keyed_runs_equals_md5_of_every_number():
    first, count = np.array([-12, 0, 95, 99_999_990, 10**12]), np.array([30, 0, 10, 20, 3])
    keys = [[1, 2, 10**15, 4, None], ["a", "b", "c", "é", "f"]]
    text = ["|".join(["3", *[str(k[r]) for k in keys if k[r] is not None], str(i)]) for r in range(5) for i in range(first[r], first[r] + count[r])]
    assert keyed_runs(3, keys, first, count).tolist() == [int(hashlib.md5(t.encode()).hexdigest()[:13], 16) for t in text]


def test_keyed_runs_equals_the_column(spark):
    rows = frames_of(spark)[1].select("session", "ch", "idx", "p").collect()
    got = {}
    for session, ch, s, e in RUNS:
        v = keyed_runs(7, [[session], [ch]], np.array([s]), np.array([e - s + 1])) / 2.0**52
        got |= {(session, ch, i): x for i, x in zip(range(s, e + 1), v)}
    assert got == {(r.session, r.ch, r.idx): r.p for r in rows}


@pytest.mark.parametrize("block, most", [(65536, 1 << 19), (16, 1 << 19), (64, 50)])
def test_run_lag_sums_equals_lag_sums_of_frames(spark, block, most):
    def two(keys, first, count):  # inside the test, as tasks cannot import it
        a, b = (keyed_runs(seed, keys, first, count) / 2.0**52 for seed in (7, 8))
        return a, a + b

    runs, f = frames_of(spark)
    a = f.select("session", "ch", "idx", F.col("p").alias("v"))
    b = f.select("session", "ch", (F.col("idx") - 3).alias("idx"), (F.col("p") + u(8, "session", "ch", "idx")).alias("v"))
    row = lambda r: ((r.session, r.ch, r.lag), r)
    want = dict(row(r) for r in D.lag_sums(a, b, ["session", "ch"], 5).collect())
    got = dict(row(r) for r in S.run_lag_sums(runs, ["session", "ch"], two, 5, 3, block, most).collect())
    assert got.keys() >= {k for k, r in want.items() if r.n}
    for k, r in got.items():
        w = want.get(k)
        assert r.n == (w.n if w else 0)
        for c in ("sx", "sy", "sxx", "syy", "sxy"):
            assert abs(r[c] - (w[c] if w else 0.0)) < 1e-9
    tot = {(r.session, r.ch): r for r in b.groupBy("session", "ch").agg(F.count("v").alias("n"), F.sum("v").alias("t"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    for (session, ch, _), r in got.items():
        w = tot[session, ch]
        assert (r.nb, r.minb, r.maxb) == (w.n, w.lo, w.hi) and abs(r.tb - w.t) < 1e-9


def test_best_lag_makes_the_sums_once(spark):
    from tandemline.plans import q_frames
    from tandemline.plans.fixtures import Tables

    plan = q_frames.d16(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("MapInArrow") + plan.count("FlatMapGroupsIn") == 1


@pytest.mark.parametrize("block, most", [(65536, 1 << 19), (16, 20)])
def test_window_percentile_equals_every_frame(spark, block, most):
    def score(keys, first, count):
        return keyed_runs(7, keys, first, count) / 2.0**52

    runs, f = frames_of(spark)
    rows = [(i, 0, 0, float(a), float(a + n)) for i, (a, n) in enumerate([(0.5, 3.0), (70.0, 3.0), (71.0, 1.5), (0.0, 200.0), (85.25, 40.0), (90.0, 0.0), (90.5, 0.0)])]
    rows += [(10, 0, 1, -41.5, -39.0), (11, 0, 1, -10.0, 61.0), (12, 7, 1, 9_999_999.5, 10_000_002.5), (13, 8, 0, 0.0, 5.0), (14, None, 0, 0.0, 5.0)]
    w = spark.createDataFrame(rows, "wid long, session long, ch long, a double, b double")
    all_p = {}
    for r in f.collect():
        all_p.setdefault((r.session, r.ch), []).append((r.idx, r.p))
    want = {}
    for wid, session, ch, a, b in rows:
        series = all_p.get((session, ch), [])
        v = [p for i, p in series if i < b and i + 1 > a]
        if v:
            want[wid] = (np.median(v), sum(p < np.median(v) for _, p in series) / len(series))
    got = {r.wid: (r.med, r.share_below) for r in S.window_percentile(w, runs, ["session", "ch"], "wid", score, block, most).collect()}
    assert got.keys() == want.keys() and len(got) == 8
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("by, block, most", [([], 65536, 1 << 19), (["session", "ch"], 65536, 1 << 19), ([], 16, 20), (["session", "ch"], 16, 20)])
def test_run_auc_equals_all_pairs(spark, by, block, most):
    def score(keys, first, count):
        return keyed_runs(7, keys, first, count) // np.uint64(2**49)  # eight values, so there are ties

    if not by:
        def score(keys, first, count):  # noqa: F811
            return keyed_runs(7, keys, first, count) // np.uint64(2**46) * np.uint64(2**46)

    runs, f = frames_of(spark)
    ranges = [(0, 0, 5, 30), (0, 0, 60, 75), (0, 1, -50, -20), (7, 1, 10_000_000, 10_000_049), (9, 9, 0, 3)]
    marks = spark.createDataFrame(ranges, "session long, ch long, lo long, hi long")
    want = {}
    for r in f.collect():
        key = (r.session, r.ch) if by else ()
        inside = any((s, c) == (r.session, r.ch) and lo <= r.idx <= hi for s, c, lo, hi in ranges)
        want.setdefault(key, ([], []))[inside].append(int(r.p * 2**52) // (2**49 if by else 2**46))
    rows = S.run_auc(runs, marks, ["session", "ch"], by, score, block, most).collect()
    got = {tuple(r[k] for k in by): r for r in rows}
    assert got.keys() == want.keys()
    for k, (neg, pos) in want.items():
        assert (got[k].n_pos, got[k].n_neg) == (len(pos), len(neg))
        won = [(p > n) + (p == n) / 2 for p in pos for n in neg]
        assert got[k].auc == (pytest.approx(sum(won) / len(won)) if won else None)


def test_boundary_report_groups_chunks_by_number_and_equals_its_twin(spark):
    import duckdb

    from tandemline.plans import catalog, q_matching
    from tandemline.plans.fixtures import Tables

    df = q_matching.e25(Tables(spark, "/root/testdata/sf0.001"))
    assert "chunk#" not in df._jdf.queryExecution().executedPlan().toString()  # no join on names of chunks
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    cur = con.execute(catalog.ORACLES["e25_boundary_report"])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(r) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == want


def test_sft_rows_do_not_shuffle_chunks(spark):
    from tandemline.plans import q_sources
    from tandemline.plans.fixtures import Tables

    df = q_sources.a13(Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Join" not in plan and "hashpartitioning(session" in plan
    assert "hashpartitioning(chunk" not in plan and ", t0" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
