"""Gates raise with the offending ids; sinks appear whole or not at all; parsers, profiles and containment on literals."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tandemline.operators import gates as Q, texts as T
from tandemline.sources import parsers as P, writers as W


def counts(spark, cells):
    return spark.createDataFrame([(a, s, c, 1, 0, 2) for a, s in cells for c in ("x", "y")], "arm string, seed long, chunk string, tp long, fp long, n_gt long")


def test_a_missing_cell_stops_the_job(spark):
    full = [(a, s) for a in "FO" for s in (0, 1)]
    assert Q.assert_complete(counts(spark, full), ["F", "O"], [0, 1]).count() == 8
    short = counts(spark, full[:-1])
    with pytest.raises(Exception, match="missing .arm, seed. cells: 1, such as O/1"):
        Q.assert_complete(short, ["F", "O"], [0, 1]).collect()
    assert {x.partial for x in Q.assert_complete(short, ["F", "O"], [0, 1], allow_partial=True).collect()} == {True}
    assert {x.partial for x in Q.assert_complete(counts(spark, full), ["F", "O"], [0, 1], allow_partial=True).collect()} == {False}


def test_sets_that_overlap_or_miss_ids_are_not_merged(spark):
    row = lambda *cs: spark.createDataFrame([("F", c) for c in cs], "arm string, chunk string")
    ids = lambda *cs: spark.createDataFrame([(c,) for c in cs], "chunk string")
    assert sorted(x.chunk for x in Q.merge_sets(row("a"), row("b", "c"), ids("a", "b", "c"), "chunk", ["arm"]).collect()) == ["a", "b", "c"]
    got = {(x.fault, x.chunk) for x in Q.merge_faults(row("a", "b"), row("b", "z"), ids("a", "b", "q"), "chunk", ["arm"]).collect()}
    assert got == {("repeated", "b"), ("unlisted", "z"), ("missing", "q")}
    with pytest.raises(Exception, match="cannot be merged: 3, such as missing/F/q, repeated/F/b, unlisted/F/z"):
        Q.merge_sets(row("a", "b"), row("b", "z"), ids("a", "b", "q"), "chunk", ["arm"]).collect()


def test_stored_aggregates_are_recomputed(spark):
    c = counts(spark, [("F", 0)])
    right = Q.recomputed(c, ["arm", "seed"])
    assert (right.first().precision, right.first().recall, right.first().f1) == (1.0, 0.5, 0.6667)
    assert Q.aggregate_faults(right, c, ["arm", "seed"]).count() == 0
    wrong = Q.aggregate_faults(right.withColumn("f1", F.lit(0.7)), c, ["arm", "seed"]).collect()
    assert [(x.field, x.stored, x.recomputed) for x in wrong] == [("f1", 0.7, 0.6667)]


def test_times_are_joined_half_to_even(spark):
    e = spark.createDataFrame([("s", 0.125), ("s", 0.375)], "session string, s double")
    t = spark.createDataFrame([("s", 0.12, "low"), ("s", 0.38, "high")], "session string, s double, text string")
    assert [x.text for x in Q.attach_by_time(e, t, ["session"], "s").orderBy("s").collect()] == ["low", "high"]


def test_frozen_ids_need_a_payload(spark):
    frozen = spark.createDataFrame([("a", 0), ("b", 1)], "cid string, pos long")
    with pytest.raises(Exception, match="without a payload: 1, such as b"):
        Q.rebuild_from_frozen(frozen, spark.createDataFrame([("a", 5)], "cid string, x long"), "cid", "pos").collect()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_positions_are_the_sorted_order(spark, parts):
    r = random.Random(1)
    xs = r.sample(range(10_000), 500)
    d = spark.createDataFrame([(x,) for x in xs], "x long").repartition(parts)
    assert {r.x: r.pos for r in W.positions(d, ["x"]).collect()} == {x: i for i, x in enumerate(sorted(xs))}


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith((".json", ".txt")))


def test_shards_are_replaced_whole_and_survive_a_failed_job(spark, tmp_path):
    to = str(tmp_path / "out")
    d = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    for _ in range(2):  # a rerun leaves one set
        W.write_sharded(d.repartition(5), to, 4, ["id"])
        got = spark.read.json(to)
        assert sorted(tuple(x) for x in got.select("id", "v", "shard").collect()) == [(i, 2 * i, i % 4) for i in range(100)]
    before = files(to)
    bad = d.select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("boom")).cast("long")).otherwise(1).alias("v"))
    with pytest.raises(Exception, match="boom"):
        W.write_sharded(bad, to, 4, ["id"])
    assert files(to) == before and os.listdir(tmp_path) == ["out"]


def test_chat_lines_read_back(spark, tmp_path):
    d = spark.createDataFrame([("a", 'say "hi"\n'), ("b", "no backchannel")], "chunk string, answer string")
    lines = d.select(W.chat_line(F.lit("Q"), F.col("answer"), F.concat(F.lit("w/"), "chunk"), 0.2).alias("line"))
    W.write_sft(lines, str(tmp_path / "sft"))
    docs = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "sft")).orderBy("value").collect()]
    assert sorted(x["messages"][1]["content"] for x in docs) == ["no backchannel", 'say "hi"\n']
    audio = json.loads(docs[0]["audio"])
    assert list(audio) == sorted(audio) and audio["token"] == W.AUDIO_PAD * 5


def test_line_transcripts_skip_what_is_not_a_line(spark):
    rows = ["# head", "", "1.5 2 A: hello: you ", "bad", "3 4.25 B:", " 5 6 C: x"]
    got = [tuple(x) for x in P.line_transcripts(spark.createDataFrame([(x,) for x in rows], "value string")).collect()]
    assert got == [(1.5, 2.0, "A", "hello: you"), (3.0, 4.25, "B", "")]


def test_votes_and_results_of_odd_documents(spark):
    docs = ['{"example_id":"e","history":[{"content":"c","boundaries":[{"total_count":3,"counts":{"a":3}},{"total_count":0,"counts":{}}]},{"content":"d","boundaries":[]}]}', "broken", None]
    got = [tuple(x) for x in P.vote_slots(spark.createDataFrame([(x,) for x in docs], "value string"), ["a", "b"]).collect()]
    assert got == [("e", 0, 0, 3, 3, 0), ("e", 0, 1, 0, 0, 0)]
    doc = '{"per_chunk":{"k":{"tp":1,"fp":0,"n_gt":2,"n_pred":1,"pred_times":[0.5],"wins":[[0.0,1.0]]}}}'
    rows = [("/p/g1_eval_left10_s3_e4x.json", doc), ("/p/g1_eval_right_c.json", doc), ("/p/other.json", doc)]
    got = {(x.arm, x.seed, x.set, x.chunk, x.tp) for x in P.eval_results(spark.createDataFrame(rows, "path string, value string")).collect()}
    assert got == {("left10", 3, "e4x", "k", 1), ("right", 42, "c", "k", 1)}


def paths(o, prefix=""):
    out = set()
    if isinstance(o, dict):
        for k, v in o.items():
            p = f"{prefix}.{k}" if prefix else k
            out |= {p} | paths(v, p)
    elif isinstance(o, list):
        for v in o[:3]:
            out |= paths(v, prefix + "[]")
    return out


def test_profile_against_recursion(spark):
    r = random.Random(5)

    def doc(depth):
        k = r.random()
        if depth == 0 or k < 0.2:
            return r.choice([1, "x", None, True])
        if k < 0.6:
            return {r.choice("abcd"): doc(depth - 1) for _ in range(r.randrange(4))}
        return [doc(depth - 1) for _ in range(r.randrange(6))]

    rows = [(r.choice("xy"), json.dumps(doc(4))) for _ in range(60)] + [("x", "not json {"), ("y", None)]
    want = {}
    for kind, d in rows:
        try:
            found = paths(json.loads(d)) if d else ()
        except ValueError:
            found = ()
        for p in found:
            want[kind, p] = want.get((kind, p), 0) + 1
    got = T.profile_json(spark.createDataFrame(rows, "kind string, doc string").repartition(3), "doc", "kind")
    assert {(x.kind, x.path): x.n for x in got.collect()} == want


def test_containment_against_search(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 5)))
    texts = [(i, " ".join(word() for _ in range(r.randrange(40)))) for i in range(60)]
    needles = [(i, " ".join(word() for _ in range(r.randrange(1, 12)))) for i in range(40)]
    needles += [(100 + i, t[k : k + 60].strip()) for i, (_, t) in enumerate(texts[:30]) for k in (r.randrange(3),)] + [(999, ""), (998, "a"), (997, "ab b")]
    want = {(n, t) for n, a in needles for t, b in texts if a[:40] and a[:40] in b}
    got = T.containment(spark.createDataFrame(needles, "n long, x string"), spark.createDataFrame(texts, "t long, x string"), "n", "t", "x", "x").collect()
    assert {(x.n, x.t) for x in got} == want and len(got) == len(want) > 30


def test_fired_is_margins_with_counts(spark):
    """the one grouping of the lines holds the margins and counts of the joined views."""
    from tandemline.plans.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    k = ["arm", "seed", "chunk"]
    want = t.margins.join(t.counts, k).selectExpr(*k, "margin", "tp", "fp", "n_gt", "cast(n_pred > 0 as int) as fire")
    got = t.fired.select(*want.columns)
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
