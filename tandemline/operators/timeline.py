"""Timeline operators built on the interval join: events, windows, coverage, block states, context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import run_frames
from .intervals import classify_duration, condition_label, interval_join, length_bucket, matched_ids, merge_intervals, rasterize
from .scan import n_parts


def cap_per_group(df: DataFrame, by: list[str], n: int, rand: Column, tie: list[str]) -> DataFrame:
    """At most ``n`` rows per group in keyed-random order.

    row_number() <= n lets Spark cut every map task to n rows per group before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy("__u", *tie)
    return df.withColumn("__u", rand).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__u", "__rn")


def overlap_summary(ov: DataFrame, keys: list[str], pre: str) -> DataFrame:
    """Count, total and class of the overlaps (columns s, e) of a key."""
    d = F.col("e") - F.col("s")
    return ov.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{pre}_events"), F.sum(d).alias(f"{pre}_total"), F.max(d).alias(f"{pre}_max")
    )


def overlap_report(meta: DataFrame, results: DataFrame, gt: DataFrame, det: DataFrame, keys: list[str]) -> DataFrame:
    """Per-file comparison: inner to results, left to metadata and to both overlap summaries.

    meta: keys, split, interruptions, backchannels, duration; results: keys, diar_error.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    zd = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    j = (
        results.join(meta, keys, "left")
        .join(overlap_summary(gt, keys, "gt"), keys, "left")
        .join(overlap_summary(det, keys, "det"), keys, "left")
    )
    return j.select(
        *keys, "split", condition_label(z("interruptions"), z("backchannels")).alias("original_label"),
        zd("duration").alias("duration"), z("gt_events").alias("gt_events"), zd("gt_total").alias("gt_total"),
        z("det_events").alias("det_events"), zd("det_total").alias("det_total"),
        classify_duration(F.col("gt_max")).alias("gt_realized"), classify_duration(F.col("det_max")).alias("det_realized"),
        "diar_error",
    )


def split_summary(report: DataFrame) -> DataFrame:
    ok = (F.col("diar_error") == 0) & (F.col("duration") > 0)
    share = lambda c: F.avg(F.when(F.col("original_label") == F.col(c), 100.0).otherwise(0.0))
    return report.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), share("gt_realized").alias("label_gt_pct"), share("det_realized").alias("label_det_pct"),
        F.corr(F.when(ok, F.col("gt_total")), F.when(ok, F.col("det_total"))).alias("r"),
        F.avg("gt_total").alias("gt_total_mean"), F.avg("det_total").alias("det_total_mean"),
        F.avg("gt_events").alias("gt_events_mean"), F.avg("det_events").alias("det_events_mean"),
    )


def starts_during(a: DataFrame, b: DataFrame, keys: list[str], ids: list[str], width: float, min_left: float = 0.1) -> DataFrame:
    """Ids of a-intervals that start strictly inside a b-interval with ``min_left`` left."""
    on = (F.col("b_s") < F.col("a_s")) & (F.col("a_s") < F.col("b_e") - min_left)
    return matched_ids(interval_join(a, b, keys, width, on=on), ids)


def overlaps_other(a: DataFrame, b: DataFrame, keys: list[str], ids: list[str], width: float, min_len: float = 0.1) -> DataFrame:
    """Ids of a-intervals that share more than ``min_len`` with a b-interval."""
    on = (F.least("a_e", "b_e") - F.greatest("a_s", "b_s")) > min_len
    return matched_ids(interval_join(a, b, keys, width, on=on), ids)


def build_events_nested(utts: DataFrame, bcs: DataFrame, file: str, width: float) -> DataFrame:
    """Events of nested dialogues, all of them; ``cap_per_group`` thins them where a set needs it.

    utts: file, uttr_idx, speaker, s, e; bcs: file, uttr_idx, bidx, speaker (of the host), s, e.
    """
    bc_dur = F.col("e") - F.col("s")
    bc = bcs.filter((bc_dur >= 0.15) & (bc_dur <= 20.0)).select(
        file, F.lit("BC").alias("cls"), (1 - F.col("speaker")).alias("speaker"), "s", "e", "uttr_idx", "bidx"
    )
    me = utts.filter(F.col("e") - F.col("s") <= 20.0).select(
        file, "uttr_idx", "speaker", (1 - F.col("speaker")).alias("other"), F.col("s").alias("a_s"), F.col("e").alias("a_e")
    )
    them = utts.select(file, F.col("speaker").alias("other"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    ids = [file, "uttr_idx", "speaker"]
    dur = F.col("a_e") - F.col("a_s")
    flags = (
        interval_join(me, them, [file, "other"], width)
        .groupBy(*ids)
        .agg(
            F.max(((F.col("b_s") < F.col("a_s")) & (F.col("a_s") < F.col("b_e") - 0.1)).cast("int")).alias("inside"),
            F.max(((F.least("a_e", "b_e") - F.greatest("a_s", "b_s")) > 0.1).cast("int")).alias("over"),
        )
    )
    j = me.join(flags, ids, "left")
    kinds = F.array_compact(
        F.array(
            F.when((F.coalesce("inside", F.lit(0)) == 1) & (dur > 0.3), "Int"),
            F.when((F.coalesce("over", F.lit(0)) == 0) & (dur > 0.5), "None"),
        )
    )
    cand = j.select(*ids, F.col("a_s").alias("s"), F.col("a_e").alias("e"), F.explode(kinds).alias("cls"))
    return bc.unionByName(cand.select(file, "cls", "speaker", "s", "e", "uttr_idx", F.lit(-1).cast("long").alias("bidx")))


def build_events_turns(turns: DataFrame, bcs: DataFrame, key: str, max_len: float) -> DataFrame:
    """Events of transcripts, all of them. turns: key, id, speaker, overlap, s, e; bcs: key, id, speaker, s, e."""
    d = F.col("e") - F.col("s")
    bc = bcs.filter((d >= 0.15) & (d <= 3.0))
    cls = F.when(F.col("overlap") & (d > 0.3), "Int").when(~F.col("overlap") & (d > 0.5), "None")
    cand = turns.filter(d <= max_len).withColumn("cls", cls).filter(F.col("cls").isNotNull())
    # a turn that starts and ends within 0.3 of a backchannel is that backchannel
    near = _near_points(cand, bc, key)
    kept = cand.join(near, [key, "id"], "left_anti")
    cols = [key, "id", "cls", "speaker", "s", "e"]
    return bc.withColumn("cls", F.lit("BC")).select(*cols).unionByName(kept.select(*cols))


def _near_points(cand: DataFrame, bc: DataFrame, key: str, tol: float = 0.3) -> DataFrame:
    a = cand.select(key, "id", (F.col("s") - tol).alias("a_s"), (F.col("s") + tol).alias("a_e"), F.col("s").alias("ts"), F.col("e").alias("te"))
    b = bc.select(key, F.col("s").alias("b_s"), F.col("s").alias("b_e"), F.col("e").alias("be"))
    on = (F.abs(F.col("ts") - F.col("b_s")) < tol) & (F.abs(F.col("te") - F.col("be")) < tol)
    return matched_ids(interval_join(a, b, [key], 4 * tol, on=on, slack=1e-9), [key, "id"])


def windows_in_chunk(
    chunks: DataFrame, windows: DataFrame, keys: list[str], length: float, require_inside: bool = False, realized_only: bool = True
) -> DataFrame:
    """Windows (a, b) of each chunk (t0) with times relative to the chunk and a kept/dropped flag."""
    w = windows.filter(F.col("realized") != "None") if realized_only else windows
    on = (F.col("b_e") > F.col("a_s")) & (F.col("b_s") < F.col("a_s") + length)
    c = chunks.withColumn("a_s", F.col("t0").cast("double")).withColumn("a_e", F.col("t0") + F.lit(float(length)))
    w = w.withColumnRenamed("a", "b_s").withColumnRenamed("b", "b_e")
    j = interval_join(c, w, keys, 4 * length, on=on)
    inside = (F.col("b_s") >= F.col("a_s") - 1e-9) & (F.col("b_e") <= F.col("a_s") + length + 1e-9)
    kept = inside if require_inside else F.lit(True)
    return j.select(
        "*", (F.col("b_s") - F.col("a_s")).alias("rel_a"), (F.col("b_e") - F.col("a_s")).alias("rel_b"), kept.alias("kept")
    ).drop("a_s", "a_e").withColumnRenamed("b_s", "a").withColumnRenamed("b_e", "b")


def covered_cells(ranges: DataFrame, runs: DataFrame, keys: list[str], ids: list[str], width: float = 5000.0) -> DataFrame:
    """Number of lit cells inside each cell range (lo, hi); zero when none."""
    j = interval_join(
        ranges.select(*keys, *ids, F.col("lo").alias("a_s"), F.col("hi").alias("a_e")),
        runs.select(*keys, F.col("lo").alias("b_s"), F.col("hi").alias("b_e")),
        keys,
        width,
    )
    return j.groupBy(*keys, *ids).agg(F.sum(F.least("a_e", "b_e") - F.greatest("a_s", "b_s") + 1).alias("covered"))


def coverage_by_length(ref: DataFrame, hyp: DataFrame, keys: list[str], tid: str, hop: float) -> DataFrame:
    """Covered (tp) and uncovered (fn) cells of reference turns by turn length."""
    turns = ref.filter(F.col("e") > F.col("s")).select(
        *keys, tid, length_bucket(F.col("e") - F.col("s")).alias("bucket"),
        F.ceil(F.col("s") / hop).alias("lo"), F.floor(F.col("e") / hop).alias("hi"),
    ).filter("hi >= lo")
    cov = covered_cells(turns, rasterize(hyp, keys, hop), keys, [tid])
    j = turns.join(cov, [*keys, tid], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return j.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("covered").cast("long").alias("tp"),
        F.sum(F.col("hi") - F.col("lo") + 1 - F.col("covered")).cast("long").alias("fn"),
    )


def coverage_decomposition(ref: DataFrame, words: DataFrame, keys: list[str], tid: str, hop: float, width: float) -> DataFrame:
    """Per reference turn: cells, covered cells, edge-shrink cells and interior-hole cells."""
    turns = ref.filter(F.col("e") > F.col("s")).select(
        *keys, tid, F.col("s").alias("a_s"), F.col("e").alias("a_e"), F.ceil(F.col("s") / hop).alias("lo"), F.floor(F.col("e") / hop).alias("hi")
    ).filter("hi >= lo")
    hit = interval_join(
        turns, words.select(*keys, F.col("s").alias("b_s"), F.col("e").alias("b_e")), keys, width,
        on=(F.col("b_s") < F.col("a_e")) & (F.col("b_e") > F.col("a_s")),
    ).groupBy(*keys, tid).agg(F.min("b_s").alias("fs"), F.max("b_e").alias("le"))
    t = turns.join(hit, [*keys, tid], "left")
    part = lambda name, lo, hi: F.struct(F.lit(name).alias("part"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    ranges = t.select(
        *keys, tid,
        F.inline(
            F.array(
                part("all", F.col("lo"), F.col("hi")),
                part("left", F.col("lo"), F.floor(F.col("fs") / hop)),
                part("right", F.ceil(F.col("le") / hop), F.col("hi")),
            )
        ),
    ).filter("hi >= lo")
    cov = covered_cells(ranges, rasterize(words, keys, hop), keys, [tid, "part"])
    r = ranges.join(cov, [*keys, tid, "part"], "left").select(
        *keys, tid, "part", (F.col("hi") - F.col("lo") + 1).alias("n"), F.coalesce("covered", F.lit(0)).alias("c")
    )
    pick = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("long")
    out = r.groupBy(*keys, tid).agg(
        pick(F.col("part") == "all", F.col("n")).alias("n_cells"), pick(F.col("part") == "all", F.col("c")).alias("covered"),
        pick(F.col("part") != "all", F.col("n") - F.col("c")).alias("edge"),
    )
    return out.withColumn("hole", F.greatest(F.lit(0), F.col("n_cells") - F.col("covered") - F.col("edge")).cast("long"))


def block_state(blocks: DataFrame, bcs: DataFrame, utts: DataFrame, keys: list[str], length: float, half: float, width: float) -> DataFrame:
    """State of each block (t): backchannel, speak or listen by the longest single overlap."""
    b = blocks.withColumn("a_s", F.col("t").cast("double")).withColumn("a_e", F.col("t") + F.lit(float(length)))
    src = bcs.select(*keys, F.col("s").alias("b_s"), F.col("e").alias("b_e"), F.lit(1).alias("is_bc")).unionByName(
        utts.select(*keys, F.col("s").alias("b_s"), F.col("e").alias("b_e"), F.lit(0).alias("is_bc"))
    )
    ov = F.least("a_e", "b_e") - F.greatest("a_s", "b_s")
    m = interval_join(b, src, keys, width, on=ov > 0).groupBy(*keys, "t").agg(
        F.max(F.when(F.col("is_bc") == 1, ov)).alias("bc"), F.max(F.when(F.col("is_bc") == 0, ov)).alias("ut")
    )
    return blocks.join(m, [*keys, "t"], "left").select(
        *keys, "t", F.when(F.col("bc") >= half, "backchannel").when(F.col("ut") >= half, "speak").otherwise("listen").alias("state")
    )


def side_text(windows: DataFrame, utts: DataFrame, keys: list[str], wid: str, margin: float, width: float, max_chars: int | None = None) -> DataFrame:
    """Context around each window: utterances with a signed relative time, joined in time order.

    With ``max_chars`` longer contexts are cut, end in an ellipsis and are flagged in ``truncated``.

    windows: keys, wid, a, b; utts: keys, s, e, text.  The rows of one window are bounded by its margin.
    """
    w = windows.select(*keys, wid, "a", (F.col("a") - margin).alias("a_s"), (F.col("b") + margin).alias("a_e"))
    u_ = utts.select(*keys, F.col("s").alias("b_s"), F.col("e").alias("b_e"), "text")
    j = interval_join(w, u_, keys, width)
    rel = F.bround(F.col("b_s") - F.col("a"), 1)
    item = F.concat(F.lit("["), F.when(rel >= 0, "+").otherwise(""), F.format_string("%.1f", rel), F.lit("s] "), F.col("text"))
    agg = j.groupBy(*keys, wid).agg(F.sort_array(F.collect_list(F.struct("b_s", "b_e", item.alias("txt")))).alias("x"))
    txt = F.array_join(F.transform("x", lambda r: r.txt), " ")
    if max_chars is None:
        return agg.select(*keys, wid, txt.alias("context"))
    long = F.length(txt) > max_chars
    cut = F.when(long, F.concat(F.substring(txt, 1, max_chars), F.lit("…"))).otherwise(txt)
    return agg.select(*keys, wid, cut.alias("context"), long.alias("truncated"))


def channel_attribution(frames: DataFrame, utts: DataFrame, key: str, hop: float, width: float) -> DataFrame:
    """Which channel is louder while speaker 0 talks, and seconds active but not annotated per channel.

    frames: key, idx, t, e_l, e_r, act_l, act_r; utts: key, speaker, s, e.
    """
    f = frames.withColumn("a_s", F.col("t")).withColumn("a_e", F.col("t"))
    on = (F.floor(F.col("b_s") / hop) <= F.col("idx")) & (F.col("idx") <= F.floor(F.col("b_e") / hop))
    spans = utts.select(key, "speaker", F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    hit = interval_join(f.select(key, "idx", "a_s", "a_e"), spans, [key], width, on=on, slack=hop).groupBy(key, "idx").agg(
        F.max((F.col("speaker") == 0).cast("int")).alias("sp0"), F.max((F.col("speaker") == 1).cast("int")).alias("sp1")
    )
    return _attributed(frames.join(hit, [key, "idx"], "left").fillna(0, ["sp0", "sp1"]), key, hop)


def _attributed(j: DataFrame, key: str, hop: float) -> DataFrame:
    on_gt = lambda act, sp: F.sum(F.when((F.col(act) == 1) & (F.col(sp) == 0), 1).otherwise(0))
    g = j.groupBy(key).agg(
        F.sum(F.when(F.col("sp0") == 1, F.col("e_l")).otherwise(0.0)).alias("el"), F.sum(F.when(F.col("sp0") == 1, F.col("e_r")).otherwise(0.0)).alias("er"),
        on_gt("act_l", "sp0").alias("l0"), on_gt("act_l", "sp1").alias("l1"), on_gt("act_r", "sp0").alias("r0"), on_gt("act_r", "sp1").alias("r1"),
    )
    left = F.col("el") >= F.col("er")
    return g.select(
        key, F.when(left, "L").otherwise("R").alias("spk0_ch"), (F.when(left, F.col("l0")).otherwise(F.col("l1")) * hop).alias("mismatch_l"),
        (F.when(left, F.col("r1")).otherwise(F.col("r0")) * hop).alias("mismatch_r"),
    )


def run_channel_attribution(runs: DataFrame, utts: DataFrame, key: str, width: int, score: Column, active: float, span: float = 1000.0) -> DataFrame:
    """``channel_attribution`` of unit frames given as runs (key, ch, first and last idx s, e), scored by ``score`` (p).

    Runs are cut at multiples of ``width`` and meet there the merged cells of each speaker; frames are made afterwards, dealt
    by key, and both channels of a frame are grouped where they are made. No frame is shuffled.
    """
    cell = lambda c: F.floor(c).cast("double").alias(c)
    m = merge_intervals(utts.select(key, "speaker", cell("s"), cell("e")), [key, "speaker"], eps=1.0, span=span)
    m = m.select(key, "speaker", F.col("s").cast("long").alias("lo"), F.col("e").cast("long").alias("hi"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("__k")
    m = m.select(key, "speaker", "lo", "hi", cells("lo", "hi")).groupBy(key, "__k").agg(F.collect_list(F.struct("speaker", "lo", "hi")).alias("__m"))
    r = runs.select(key, "ch", "s", "e", cells("s", "e")).join(m, [key, "__k"], "left")
    r = r.select(key, "ch", F.greatest("s", F.col("__k") * width).alias("s"), F.least("e", (F.col("__k") + 1) * width - 1).alias("e"), "__m")
    r = r.repartition(n_parts(runs.sparkSession), key)
    said = lambda k: F.coalesce(F.exists("__m", lambda x: (x.speaker == k) & F.col("idx").between(x.lo, x.hi)), F.lit(False)).cast("int")
    on = lambda k: F.coalesce(F.max(F.when(F.col("ch") == k, F.col("p"))), F.lit(0.0))
    f = run_frames(r, score).select(key, "idx", "ch", "p", said(0).alias("sp0"), said(1).alias("sp1"))
    f = f.groupBy(key, "idx").agg(on(0).alias("e_l"), on(1).alias("e_r"), F.max("sp0").alias("sp0"), F.max("sp1").alias("sp1"))
    return _attributed(f.withColumn("act_l", (F.col("e_l") > active).cast("int")).withColumn("act_r", (F.col("e_r") > active).cast("int")), key, 1.0)


def map_channel(turns: DataFrame, chmap: DataFrame, key: str) -> DataFrame:
    """Speaker to channel by a map (the user under L is channel 0).  Spark chooses the join by size."""
    return turns.join(chmap, key, "left").withColumn("ch", F.when(F.col("speaker") == F.col("left_user"), 0).otherwise(1).cast("long"))
