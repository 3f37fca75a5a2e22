"""Quotas, strata, frozen sets and next sessions on literals."""

from pyspark.sql import functions as F

from tandemline.functions.keyed import u
from tandemline.operators import sampling as G


def test_listen_fills_what_the_other_quotas_leave(spark):
    rows = [(i, "backchannel" if i < 2 else "speak" if i < 40 else "listen") for i in range(100)]
    d = spark.createDataFrame(rows, "id long, state string")
    n = {x.state: x["count"] for x in G.select_balanced(d, "state", 24, u(1, "id"), ["id"]).groupBy("state").count().collect()}
    assert n == {"backchannel": 2, "speak": 12, "listen": 10}
    assert G.select_balanced(d.limit(0), "state", 24, u(1, "id"), ["id"]).count() == 0


def test_strata_are_of_one_size(spark):
    d = spark.range(60).select("id", (F.col("id") < 50).alias("y"))
    got = G.stratified_sample(d, F.col("y"), 20, 100, u(1, "id"), u(2, "id"), ["id"]).collect()
    assert sum(x.y for x in got) == 20 and len(got) == 30


def test_a_frozen_set_keeps_its_ids_and_positions(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    frozen = spark.createDataFrame([(7, 0), (3, 1)], "id long, pos long")
    got = {x.id: x.pos for x in G.extend_set(frozen, ids(range(10)), ids([1, 2]), "id", "pos", 5, u(1, "id")).collect()}
    assert got[7] == 0 and got[3] == 1 and sorted(got.values()) == [0, 1, 2, 3, 4] and not {1, 2} & set(got)
    assert [x.id for x in G.extend_set(frozen, ids(range(10)), ids([]), "id", "pos", 1, u(1, "id")).collect()] == [7]


def test_next_sessions_follow_the_last_used_one(spark):
    s = spark.createDataFrame([(x,) for x in ("a", "b", "b", "d", "e", "c")], "s string")
    assert sorted(x.s for x in G.next_sessions(s, s.filter("s in ('a', 'c')"), "s", 5).collect()) == ["d", "e"]


def _walk(rows, n):
    """The plain scan: rows of (id, class) in order."""
    got = {"positive": [], "hard": [], "plain": []}
    for i, c in rows:
        got[c].append(i)
        if len(got["positive"]) >= n * 3 // 4 and len(got["hard"]) + len(got["plain"]) >= n // 4:
            break
    return {*got["positive"][: n * 3 // 4], *got["hard"][: n // 8], *got["plain"][: max(0, n // 4 - len(got["hard"]))]}


def test_training_rows_stop_early_and_count_all_hard_ones(spark):
    # 24 of them: 18 positive, 3 hard, plain ones fill a quarter less every hard row read
    df = spark.range(400).select("id", F.floor(F.pmod(F.xxhash64("id"), F.lit(9))).alias("k")).withColumn("r", u(5, "id"))
    pos, hard = F.col("k") < 4, F.col("k") < 6
    rows = df.select("id", F.when(pos, "positive").when(hard, "hard").otherwise("plain").alias("c"), "r").collect()
    want = _walk([(r.id, r.c) for r in sorted(rows, key=lambda r: (r.r, r.id))], 24)
    for per in (3, 50, 4096):
        assert {r.id for r in G.select_train(df.select("id", "k"), pos, hard, 24, u(5, "id"), ["id"], per).collect()} == want
    # hard rows beyond their quota still take the place of plain ones
    many = spark.range(60).select("id", F.when(F.col("id") < 20, 0).when(F.col("id") < 50, 4).otherwise(8).alias("k"))
    order = F.col("id") / 60
    got = G.select_train(many, pos, hard, 24, order, ["id"], 7).groupBy("cls").count().collect()
    assert {r.cls: r["count"] for r in got} == {"positive": 18, "hard": 3}


def test_training_rows_of_a_short_pool(spark):
    df = spark.range(10).select("id", (F.col("id") % 9).alias("k"))
    got = G.select_train(df, F.col("k") < 4, F.col("k") < 6, 80, u(1, "id"), ["id"]).count()
    assert got == 10 and G.select_train(df.limit(0), F.col("k") < 4, F.col("k") < 6, 80, u(1, "id"), ["id"]).count() == 0


def test_chunks_of_runs_are_those_of_frames(spark):
    """F16, F32, F35, F38: chunks come from runs by arithmetic, without a row for each frame."""
    from tandemline.operators.frames import run_chunks

    rows = [(1, -7, -7), (1, -3, 2), (1, 4, 4), (1, 6, 31), (1, 40, 49), (1, 60, 74), (2, 0, 0), (2, 5, 14)]
    want = {}
    for k, s, e in rows:
        for i in range(s, e + 1):
            for t0 in (i // 5 * 5, i // 5 * 5 - 5):
                want[k, t0] = want.get((k, t0), 0) + 1
    got = run_chunks(spark.createDataFrame(rows, "k long, s long, e long"), ["k"], 10, 5).collect()
    assert {(r.k, r.t0): r.n_frames for r in got} == want and len(got) == len(want)


def test_first_unused_reads_on_until_enough_are_left(spark):
    """F32: only the first rows meet the used ones, and more are read where most of them are used."""
    pool = spark.range(500)
    order = [r.id for r in pool.orderBy(u(1, "id")).collect()]
    for used in ([], order[:3], order[:120], order[:499], order):
        got = G.first_unused(pool, spark.createDataFrame([(x,) for x in used], "id long"), "id", 5, u(1, "id")).orderBy("__u").collect()
        assert [r.id for r in got] == [x for x in order if x not in used][:5]
