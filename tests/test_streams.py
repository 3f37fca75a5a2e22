"""A stream over bounded input equals the batch rule."""

from pyspark.sql import functions as F

from tandemline.operators import frames as D
from tandemline.streaming import streams as S

SRC = "/root/testdata/sf0.001"


def drain(spark, df, name, mode="complete"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def events(reader):
    return reader.select((F.col("user_id") % 4).alias("k"), F.col("ts").cast("timestamp").alias("ts"), "value")


def both(spark, name, rule):
    batch = spark.read.parquet(f"{SRC}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SRC)
    got = drain(spark, rule(events(stream)), name)
    want = rule(events(batch))
    assert got.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_chunk_counts(spark):
    both(spark, "s_chunks", lambda e: S.chunk_counts(e, ["k"], "ts", "10 minutes", "5 minutes", "1 hour"))


def at(spark, rows):
    """Words (k, s, e) in seconds as timestamps, read as a stream source would give them."""
    df = spark.createDataFrame(rows, "k long, s double, e double")
    return df.select("k", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))


def test_turns_equal_the_batch_operator(spark, tmp_path):
    words = [(1, 0.0, 9.0), (1, 9.5, 10.0), (1, 11.0, 11.0), (1, 12.0, 14.0), (1, 15.001, 16.0), (1, 30.0, 31.0), (2, 5.0, 5.0), (2, 1.0, 8.0)]
    at(spark, words).coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("k long, s timestamp, e timestamp").parquet(str(tmp_path / "w"))
    turns = S.group_turns(stream, ["k"], "s", "e", 1.0, "1 hour")
    sec = lambda c: F.round(F.unix_micros(c) / 1_000_000, 6)
    got = [tuple(r) for r in drain(spark, turns, "s_turns").select("k", sec("start"), sec("end")).collect()]
    batch = D.group_turns(spark.createDataFrame(words, "k long, s double, e double"), ["k"], 1.0)
    want = [tuple(r) for r in batch.select("k", "s", "e").collect()]
    assert sorted(got) == sorted(want) == [(1, 0.0, 14.0), (1, 15.001, 16.0), (1, 30.0, 31.0), (2, 1.0, 8.0)]


def test_overlaps_and_their_side_output(spark):
    a = at(spark, [(1, 0.0, 20.0), (2, 0.0, 100.0)]).toDF("k", "a_s", "a_e")
    b = at(spark, [(1, 19.0, 39.0), (2, 50.0, 60.0)]).toDF("k", "b_s", "b_e")
    got = S.live_overlap(a, b, "k", "1 hour", "20 seconds").select("k", F.unix_timestamp("s"), F.unix_timestamp("e")).collect()
    assert [tuple(r) for r in got] == [(1, 19, 20)]
    assert [r["k"] for r in S.over_reach(a, "a_s", "a_e", "20 seconds").collect()] == [2]
    assert S.over_reach(b, "b_s", "b_e", "20 seconds").count() == 0
