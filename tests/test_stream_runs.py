"""Stateful streams equal their batch operators, with late rows and an open tail."""

import random

import pytest
from pyspark.sql import functions as F

from tandemline.operators import frames as D
from tandemline.streaming import runs as R

HOP = 0.08


def stream(spark, path, batches, schema):
    """One file a trigger, in order; ``ts`` is the frame's time after 1970, where the first watermark stands."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
        for f in os.listdir(f"{path}/b{i}"):
            os.utime(f"{path}/b{i}/{f}", (time.time() - 1000 + i * 10,) * 2)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return read.parquet(path).withColumn("ts", F.timestamp_millis(F.round(F.col("t0") * 1000).cast("long") + 1_000_000))


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(150)
    return spark.table(name)


def dealt(rows, r):
    """Three batches in rough order, one early row each arriving a batch late."""
    rows = sorted(rows, key=lambda x: x[2])
    third = len(rows) // 3
    a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third :]
    b.append(a.pop(-2))
    c.append(b.pop(-3))
    for x in (a, b, c):
        r.shuffle(x)
    return [a, b, c]


def test_runs_equal_the_batch_operator(spark, tmp_path):
    r = random.Random(3)
    schema = "k long, idx long, t0 double, t1 double, on boolean"
    rows = []
    for k in range(4):
        flags = [r.random() < 0.45 for _ in range(120)] + [True, False, False]  # an open tail: bridged, so it ends with the last frame
        if k == 3:
            flags += [False]  # a closed one
        rows += [(k, i, i * HOP, (i + 1) * HOP, f) for i, f in enumerate(flags)]
    batches = dealt(rows, r) + [[(99, 0, 900.0, 900.1, False)], [(99, 1, 990.0, 990.1, False)]]  # time goes on elsewhere
    got = drain(spark, R.runs(stream(spark, str(tmp_path / "in"), batches, schema), ["k"], "ts", "5 seconds", 20.0), "s4_runs").filter("k < 99")
    want = D.runs_to_events(spark.createDataFrame(rows, schema), ["k"], F.col("on"))
    key = lambda xs: sorted((x.k, round(x.s, 6), round(x.e, 6)) for x in xs)
    assert key(got.collect()) == key(want.collect())
    cls = lambda n: "Int" if n > 0.5 else "Backchannel" if n > 0.1 else "None"
    assert all(x.cls == cls(x.e - x.s) for x in got.collect())


def test_outcomes_equal_the_batch_operator(spark, tmp_path):
    r = random.Random(4)
    schema = "k long, idx long, t0 double, spk long, lis long"
    rows = [(k, i, i * HOP, int(r.random() < 0.6), int(r.random() < 0.3)) for k in range(3) for i in range(100) if r.random() < 0.95]
    batches = dealt(rows, r) + [[(99, 0, 900.0, 0, 0)], [(99, 1, 990.0, 0, 0)]]
    got = drain(spark, R.outcomes(stream(spark, str(tmp_path / "in"), batches, schema), "k", "ts", "5 seconds", 20.0, 6, 12), "s5_outcomes").filter("k < 99")
    words = spark.createDataFrame([], "k long, idx long, token string")
    want = D.outcome_labels(spark.createDataFrame(rows, schema), words, "k", 6, 12, ["yes"])
    key = lambda xs: sorted((x.k, x.idx, x.is_overlap, round(x.turn_hold_prob, 9), x.label) for x in xs)
    assert key(got.collect()) == key(want.collect()) and got.count() > 20


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    schema = "k long, idx long, t0 double, t1 double, on boolean"
    frame = lambda k, i: (k, i, i * HOP, (i + 1) * HOP, True)
    batches = [[frame(0, i) for i in range(10)], [frame(0, 5000)], [frame(0, 4)], [frame(0, 90_000)], [frame(0, 180_000)]]
    got = drain(spark, R.runs(stream(spark, str(tmp_path / "in"), batches, schema), ["k"], "ts", "5 seconds", 20.0), "s4_late")
    assert [(round(x.s, 6), round(x.e, 6)) for x in got.orderBy("s").collect()][:2] == [(0.0, 0.8), (400.0, 400.08)]


def test_finished_keys_are_skipped_and_scores_run(spark, tmp_path):
    rows = [("F", 1, 1, 0, 2), ("O", 2, 2, 0, 2), ("O", 3, 0, 1, 1)]
    schema = "arm string, idx long, tp long, fp long, n_gt long"
    batches = [rows[:2], rows[2:]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    left = drain(spark, R.pending_only(read(), spark.createDataFrame([(2,)], "idx long"), ["idx"]), "s7_pending")
    assert sorted(x.idx for x in left.collect()) == [1, 3]
    got = drain(spark, R.score_difference(read(), ["F", "O"], []), "s8_delta", "complete").first()
    assert got.f1_a == pytest.approx(2 / 3) and got.f1_b == pytest.approx(4 / 6) and got.delta == pytest.approx(0)
