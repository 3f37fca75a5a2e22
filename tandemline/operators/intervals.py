"""Interval algebra on columns ``s`` and ``e`` (double) inside equality keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scan import running


def interval_join(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    width: float,
    on: Column | None = None,
    a_iv: tuple[str, str] = ("a_s", "a_e"),
    b_iv: tuple[str, str] = ("b_s", "b_e"),
    slack: float = 0.0,
) -> DataFrame:
    """Pairs of intervals that touch, by equality on (keys, time bucket).

    Each side is exploded to the buckets it covers; a pair is kept only in the later of the two first
    buckets, so no distinct is needed and a long session is spread over many tasks.  ``slack`` widens
    the left side for predicates with a tolerance; ``on`` is the exact predicate (default: touching).
    """
    lo = F.floor((F.col(a_iv[0]) - slack) / width)
    hi = F.floor((F.col(a_iv[1]) + slack) / width)
    left = a.withColumn("__lo_a", lo).withColumn("__k", F.explode(F.sequence(lo, hi)))
    right = b.withColumn("__lo_b", F.floor(F.col(b_iv[0]) / width)).withColumn(
        "__k", F.explode(F.sequence(F.floor(F.col(b_iv[0]) / width), F.floor(F.col(b_iv[1]) / width)))
    )
    cond = on if on is not None else (F.col(a_iv[0]) <= F.col(b_iv[1])) & (F.col(b_iv[0]) <= F.col(a_iv[1]))
    joined = left.join(right, [*keys, "__k"], "inner")
    return joined.filter((F.col("__k") == F.greatest("__lo_a", "__lo_b")) & cond).drop("__k", "__lo_a", "__lo_b")


def label_islands(
    df: DataFrame, keys: list[str], eps: float = 1e-6, span: float = 1000.0, breaks: Column | None = None
) -> DataFrame:
    """Rows (s, e) with the start of their island; a start joins while ``s <= running_end + eps``.

    ``breaks`` replaces that test by another condition on ``s`` and the running end ``__m``.
    """
    bucket = F.floor(F.col("s") / span)
    r = running(df, keys, bucket, ["s", "e"], {"__m": ("max", "e")})
    new = F.col("__m").isNull() | (breaks if breaks is not None else F.col("s") > F.col("__m") + eps)
    start = F.when(new, F.col("s"))
    return running(r.withColumn("__st", start).drop("__m"), keys, bucket, ["s", "e"], {"island": ("last", "__st")}, inclusive=True).drop("__st")


def merge_intervals(
    df: DataFrame,
    keys: list[str],
    s: str = "s",
    e: str = "e",
    eps: float = 1e-6,
    span: float = 1000.0,
    breaks: Column | None = None,
) -> DataFrame:
    """Union of intervals per key."""
    base = df.select(*keys, F.col(s).alias("s"), F.col(e).alias("e"))
    r = label_islands(base, keys, eps, span, breaks)
    return r.groupBy(*keys, "island").agg(F.max("e").alias("e")).select(*keys, F.col("island").alias("s"), "e")


def cross_overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: float, min_len: float = 0.1) -> DataFrame:
    """Intersections longer than ``min_len`` between two sides (columns a_s, a_e and b_s, b_e)."""
    s, e = F.greatest("a_s", "b_s"), F.least("a_e", "b_e")
    j = interval_join(a, b, keys, width, on=(e - s) > min_len)
    return j.select("*", s.alias("s"), e.alias("e"))


def classify_duration(dur: Column, hi: float = 0.5, lo: float = 0.1) -> Column:
    """Class of the longest overlap of a key."""
    return F.when(dur > hi, "Interruption").when(dur > lo, "Backchannel").otherwise("None")


def condition_label(interruptions: Column, backchannels: Column) -> Column:
    return F.when(interruptions > 0, "Interruption").when(backchannels > 0, "Backchannel").otherwise("None")


def overlap_seconds(
    a: DataFrame, b: DataFrame, keys: list[str], width: float, span: float = 1000.0
) -> DataFrame:
    """Total time covered by both lists per key; each list is merged first."""
    am = merge_intervals(a, keys, span=span).select(*keys, F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    bm = merge_intervals(b, keys, span=span).select(*keys, F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return cross_overlaps(am, bm, keys, width, 0.0).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("seconds"))


def matched_ids(joined: DataFrame, ids: list[str]) -> DataFrame:
    return joined.select(*ids).distinct()


def pad_merge(df: DataFrame, keys: list[str], total: Column, margin: float, gap: float, span: float = 1000.0) -> DataFrame:
    """Pad, clip to [0, total], merge when the start is less than ``gap`` after the last end.

    The last window's end replaces the region end, so the comparison is with the directly preceding
    window, and a region ends where its last window ends.
    """
    base = df.select(
        *keys,
        F.greatest(F.lit(0.0), F.col("s") - margin).alias("s"),
        F.least(total, F.col("e") + margin).alias("e"),
    )
    bucket = F.floor(F.col("s") / span)
    r = running(base, keys, bucket, ["s", "e"], {"__p": ("last", "e")})
    r = r.withColumn("__new", F.col("__p").isNull() | ~((F.col("s") - F.col("__p")) < gap))
    r = running(
        r,
        keys,
        bucket,
        ["s", "e"],
        {"__g": ("sum", F.col("__new").cast("long"))},
        inclusive=True,
    )
    return (
        r.groupBy(*keys, "__g")
        .agg(F.min("s").alias("__s0"), F.max_by("e", F.struct("s", "e")).alias("e"))
        .select(*keys, F.col("__s0").alias("s"), "e")
    )


def turn_taking_rules(user: DataFrame, agent: DataFrame, keys: list[str], width: float, span: float = 1000.0) -> DataFrame:
    """Success, wrong and noise interruptions with their rates.

    user: keys, u_s, u_e; agent: keys, a_s, a_e.
    """
    pairs = interval_join(
        agent.select(*keys, "a_s", "a_e"), user.select(*keys, F.col("u_s").alias("b_s"), F.col("u_e").alias("b_e")), keys, width
    )
    counts = pairs.groupBy(*keys).agg(
        F.count_if(
            (F.col("a_s") < F.col("b_s")) & (F.col("b_s") < F.col("a_e")) & (F.col("a_e") < F.col("b_e"))
        ).alias("n_succ"),
        F.count_if((F.col("b_s") < F.col("a_s")) & (F.col("a_s") < F.col("b_e") - 0.5)).alias("n_wrong"),
    )
    sides = user.select(*keys, F.lit(1).alias("__u")).unionByName(agent.select(*keys, F.lit(0).alias("__u")))
    rounds = sides.groupBy(*keys).agg(F.sum("__u").alias("n_round"))  # a key without user segments has no round

    # next user start at or after the agent end, and the last user (by start) that ended by the agent start
    nul = F.lit(None).cast("double")
    marks = (
        user.select(*keys, F.col("u_s").alias("t"), F.lit(1).alias("o"), F.col("u_s").alias("nu"), nul.alias("a_s"), nul.alias("a_e"))
        .unionByName(agent.select(*keys, F.col("a_e").alias("t"), F.lit(0).alias("o"), nul.alias("nu"), "a_s", "a_e"))
        .withColumn("z", F.coalesce("a_s", "nu"))
    )
    nxt = running(marks, keys, F.floor(F.col("t") / span), ["t", "o", "z"], {"next_u": ("min", "nu")}, reverse=True)
    cand = nxt.filter(
        F.col("a_s").isNotNull()
        & (F.col("next_u") - F.col("a_e") >= 2.5)
        & ((F.col("a_e") - F.col("a_s")) < 5.5)
    ).select(*keys, "a_s", "a_e")
    no_user = F.lit(None).cast("struct<us:double,ue:double>")
    ends = user.select(
        *keys, F.col("u_e").alias("t"), F.lit(0).alias("o"),
        F.struct(F.col("u_s").alias("us"), F.col("u_e").alias("ue")).alias("pu"), nul.alias("a_s"), nul.alias("a_e"),
    ).unionByName(cand.select(*keys, F.col("a_s").alias("t"), F.lit(1).alias("o"), no_user.alias("pu"), "a_s", "a_e"))
    prev = running(ends, keys, F.floor(F.col("t") / span), ["t", "o", "a_e"], {"prev_u": ("max", "pu")})
    noise = (
        prev.filter(F.col("a_s").isNotNull() & (F.col("prev_u.ue") < F.col("a_s")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_noise"))
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = rounds.join(counts, keys, "left").join(noise, keys, "left").select(
        *keys, "n_round", F.greatest(F.lit(0), F.col("n_round") - 1).alias("n_interrupt"), z("n_succ").alias("n_succ"),
        z("n_wrong").alias("n_wrong"), z("n_noise").alias("n_noise"),
    )
    ratio = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    return out.select(
        "*", ratio("n_succ", "n_interrupt").alias("sir"), ratio("n_wrong", "n_round").alias("eir"),
        ratio("n_noise", "n_interrupt").alias("nir"),
    )


def rasterize(df: DataFrame, keys: list[str], hop: float, n_cells: Column | None = None) -> DataFrame:
    """Merged runs of lit cells ``[lo, hi]`` per key, one row per run (cells ceil(s/hop)..floor(e/hop)).

    An interval between two cells lights the one nearest its start, clamped to the grid.
    """
    lo, hi = F.ceil(F.col("s") / hop), F.floor(F.col("e") / hop)
    near = F.rint(F.col("s") / hop)
    if n_cells is not None:
        near = F.greatest(F.lit(0), F.least(near, n_cells - 1))
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, n_cells - 1)
    cells = df.filter(F.col("e") > F.col("s")).select(
        *keys,
        F.when(hi >= lo, lo).otherwise(near).cast("double").alias("s"),
        F.when(hi >= lo, hi).otherwise(near).cast("double").alias("e"),
    )
    m = merge_intervals(cells, keys, eps=1.0, span=max(1.0, 5000.0))
    return m.select(*keys, F.col("s").cast("long").alias("lo"), F.col("e").cast("long").alias("hi"))


def cell_count() -> Column:
    return F.sum(F.col("hi") - F.col("lo") + 1)


def grid_prf(ref: DataFrame, hyp: DataFrame, keys: list[str], hop: float, width_cells: float = 5000.0) -> DataFrame:
    """Cell agreement per key from merged runs: tp is the overlap of two run lists, never one row per cell."""
    r, h = rasterize(ref, keys, hop), rasterize(hyp, keys, hop)
    inter = interval_join(
        r.select(*keys, F.col("lo").alias("a_s"), F.col("hi").alias("a_e")),
        h.select(*keys, F.col("lo").alias("b_s"), F.col("hi").alias("b_e")),
        keys,
        width_cells,
    )
    tp = inter.groupBy(*keys).agg(F.sum(F.least("a_e", "b_e") - F.greatest("a_s", "b_s") + 1).alias("tp"))
    nr = r.groupBy(*keys).agg(cell_count().alias("nr"))
    nh = h.groupBy(*keys).agg(cell_count().alias("nh"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = nr.join(nh, keys, "full").join(tp, keys, "left").select(
        *keys, z("tp").alias("tp"), (z("nh") - z("tp")).alias("fp"), (z("nr") - z("tp")).alias("fn")
    )
    return out


def with_prf(df: DataFrame) -> DataFrame:
    """precision, recall, F1 and covered-area ratio from tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    return df.select(
        "*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + fp, tp + fn).alias("area_ratio"),
    )


def length_bucket(dur: Column) -> Column:
    return F.when(dur < 1, "0-1").when(dur < 3, "1-3").when(dur < 10, "3-10").otherwise("10+")


def tile_stats(df: DataFrame, keys: list[str], order: list[str], span: float = 1000.0) -> DataFrame:
    """Gaps and overlaps between neighbours of placed segments (columns s, e)."""
    r = running(df, keys, F.floor(F.col("s") / span), order, {"prev_e": ("last", "e")})
    gap = F.col("s") - F.col("prev_e")
    return r.groupBy(*keys).agg(
        F.count("prev_e").alias("n_pairs"),
        F.count_if(gap >= 0).alias("n_gaps"),
        F.count_if(gap < 0).alias("n_overlaps"),
        F.sum(F.when(gap > 0, gap).otherwise(0.0)).alias("gap_time"),
        F.sum(F.when(gap < 0, -gap).otherwise(0.0)).alias("overlap_time"),
    )
