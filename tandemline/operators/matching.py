"""Timed-event matching and the scores built on matched counts.

Greedy rules depend on order: inside a chunk they are a fold over an array with the used positions as state,
along a whole key they run in blocks (``greedy``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .greedy import collar_rule, cover_rule, greedy_match
from .intervals import interval_join


def fold_match(preds: Column, wins: Column, ok) -> Column:
    """Position of the window each prediction takes (0 when none): first unused window with ``ok(pred, win)``."""
    pos = F.when(F.size(wins) > 0, F.sequence(F.lit(1), F.size(wins))).otherwise(F.array().cast("array<int>"))

    def step(acc, t):
        free = F.filter(pos, lambda j: ok(t, F.get(wins, j - 1)) & ~F.array_contains(acc, j))
        return F.array_append(acc, F.coalesce(F.get(free, F.lit(0)), F.lit(0)))

    return F.aggregate(preds, F.array().cast("array<int>"), step)


def n_matched(pos: Column) -> Column:
    return F.size(F.filter(pos, lambda j: j > 0)).cast("long")


def match_events(preds: DataFrame, windows: DataFrame, chunk: str, tol: float = 0.5) -> DataFrame:
    """tp, fp, n_gt, n_pred per chunk.  preds: chunk, ord, t; windows: chunk, ord, a, b."""
    p = preds.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("p"))
    w = windows.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct("ord", "a", "b"))).alias("w"))
    j = p.join(w, chunk, "full").select(
        chunk,
        F.coalesce(F.col("p.t"), F.array().cast("array<double>")).alias("ts"),
        F.coalesce(F.col("w"), F.array().cast(w.schema["w"].dataType)).alias("ws"),
    )
    pos = fold_match(F.col("ts"), F.col("ws"), lambda t, x: (t >= x.a - tol) & (t <= x.b + tol))
    m = j.withColumn("tp", n_matched(pos))
    return m.select(chunk, "tp", (F.size("ts") - F.col("tp")).alias("fp"), F.size("ws").cast("long").alias("n_gt"), F.size("ts").cast("long").alias("n_pred"))


def hit_any(preds: DataFrame, windows: DataFrame, keys: list[str], pid: str, tol: float, width: float) -> DataFrame:
    """Predictions within ``tol`` of any window (non-exclusive)."""
    a = preds.select(*keys, pid, F.col("t").alias("a_s"), F.col("t").alias("a_e"))
    b = windows.select(*keys, (F.col("a") - tol).alias("b_s"), (F.col("b") + tol).alias("b_e"), F.col("a").alias("wa"), F.col("b").alias("wb"))
    hit = interval_join(a, b, keys, width, on=(F.col("a_s") >= F.col("b_s")) & (F.col("a_s") <= F.col("b_e")))
    return preds.join(hit.select(pid).distinct(), pid, "left_semi")


def match_by_cover(events: DataFrame, windows: DataFrame, keys: list[str], width: float, share: float = 0.5, per: int = 512) -> DataFrame:
    """Greedy match by the share of the event inside a window, each window once; counts per key.

    Events go in the order (s, e, id) and ties to the first window of that order. ``share`` is above 0; an event of no
    length has the share 0. Rows without a start or an end count in n_pred and n_gt and match nothing.
    """
    m = greedy_match(events, windows, keys, cover_rule(share), 0.0, width, per).select(*keys, n_matched(F.col("took")).alias("matched"))
    one = lambda df, name: df.select(*keys, F.lit(0).cast("long").alias("matched"), *[F.lit(int(name == c)).cast("long").alias(c) for c in ("n_pred", "n_gt")])
    rows = one(events, "n_pred").unionByName(one(windows, "n_gt")).unionByName(m, allowMissingColumns=True)
    out = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("matched", "n_pred", "n_gt")])
    rate = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    p, r = rate("matched", "n_pred"), rate("matched", "n_gt")
    return out.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def match_collar(ref: DataFrame, hyp: DataFrame, keys: list[str], collar: float, width: float, per: int = 512) -> DataFrame:
    """Each reference point in order takes the nearest unused hypothesis within the collar; signed errors."""
    point = lambda df: df.select(*keys, "id", F.col("t").alias("s"), F.col("t").alias("e"))
    g = greedy_match(point(ref), point(hyp), keys, collar_rule(collar), collar, width, per)
    z = g.select(*keys, "y_id", "y_s", F.explode(F.arrays_zip("x_id", "x_s", "took")).alias("z")).filter("z.took > 0")
    hyp_at = lambda c: F.get(c, F.col("z.took") - 1)
    return z.select(*keys, F.col("z.x_id").alias("ref_id"), hyp_at("y_id").alias("hyp_id"), (hyp_at("y_s") - F.col("z.x_s")).alias("err"))


def iou(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(a_e, b_e) - F.greatest(a_s, b_s))
    union = (a_e - a_s) + (b_e - b_s) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def prf_columns(tp: Column, fp: Column, n_gt: Column) -> list[Column]:
    """Union-calibre precision, recall and F1 of already summed counts."""
    den = tp + fp + n_gt
    return [
        (tp / F.greatest(F.lit(1), tp + fp)).alias("precision"), (tp / F.greatest(F.lit(1), n_gt)).alias("recall"),
        F.when(den > 0, 2 * tp / den).otherwise(0.0).alias("f1"),
    ]


def prf(counts: DataFrame, by: list[str]) -> DataFrame:
    g = counts.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n_gt").alias("n_gt"))
    return g.select("*", *prf_columns(F.col("tp"), F.col("fp"), F.col("n_gt")))


def f1_of(tp: Column, fp: Column, n_gt: Column) -> Column:
    den = tp + fp + n_gt
    return F.when(den > 0, 2 * tp / den).otherwise(0.0)


def delta_f1(counts: DataFrame, arms: list[str], runs: int) -> DataFrame:
    """F1 per seed and arm and their difference, on chunks present in all ``runs`` (arm, seed) pairs."""
    runs_of = F.size(F.collect_set(F.when(F.col("arm").isNotNull() & F.col("seed").isNotNull(), F.struct("arm", "seed"))).over(Window.partitionBy("chunk")))
    p = prf(counts.withColumn("__k", runs_of).filter(F.col("__k") == runs), ["arm", "seed"])  # a chunk's rows alone are held, and read once
    w = p.groupBy("seed").pivot("arm", arms).agg(F.first("f1"))
    return w.select("seed", *[F.col(a).alias(f"f1_{a}") for a in arms], (F.col(arms[1]) - F.col(arms[0])).alias("delta"))


def hit_tiers(counts: DataFrame, by: list[str]) -> DataFrame:
    """Chunks with truth that are hit by all, none or some of the runs."""
    g = counts.filter("n_gt > 0").groupBy(*by, "chunk").agg(F.count_if(F.col("tp") > 0).alias("hits"), F.count(F.lit(1)).alias("runs"))
    return g.withColumn("tier", F.when(F.col("hits") == F.col("runs"), "always").when(F.col("hits") == 0, "never").otherwise("swing"))


def hit_overlap(counts: DataFrame) -> DataFrame:
    """Jaccard, union and intersection of the hit sets of every pair of seeds inside an arm."""
    hits = counts.filter("n_gt > 0 and tp > 0").groupBy("arm", "chunk").agg(F.array_sort(F.collect_set("seed")).alias("s"))
    sizes = hits.select("arm", F.explode("s").alias("seed")).groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n"))
    # seeds per chunk are few; pairs are expanded inside the row
    pr = hits.select("arm", F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))
    inter = pr.groupBy("arm", F.col("x.a").alias("seed_a"), F.col("x.b").alias("seed_b")).agg(F.count(F.lit(1)).alias("inter"))
    sa, sb = sizes.select("arm", F.col("seed").alias("seed_a"), F.col("n").alias("na")), sizes.select("arm", F.col("seed").alias("seed_b"), F.col("n").alias("nb"))
    j = sa.join(sb, "arm").filter("seed_a < seed_b").join(inter, ["arm", "seed_a", "seed_b"], "left")
    i = F.coalesce("inter", F.lit(0)).cast("long")
    return j.select("arm", "seed_a", "seed_b", i.alias("inter"), (F.col("na") + F.col("nb") - i).alias("union"), (i / (F.col("na") + F.col("nb") - i)).alias("jaccard"))
