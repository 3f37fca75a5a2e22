"""Resampling over pre-aggregated counts: one wide row per unit, weights per replicate, weighted sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keyed import u
from .matching import f1_of
from .scan import dense_index, n_parts, sized_rank, uniform_rank


def cells(arms: list[str], seeds: list[int]) -> list[str]:
    return ["n_gt"] + [f"{k}_{a}{s}" for a in arms for s in seeds for k in ("tp", "fp")]


def delta_of(arms: list[str], seeds: list[int]) -> Column:
    """Mean over seeds of F1(second arm) - F1(first arm) from summed columns."""
    f1 = lambda a, s: f1_of(F.col(f"tp_{a}{s}"), F.col(f"fp_{a}{s}"), F.col("n_gt"))
    d = [f1(arms[1], s) - f1(arms[0], s) for s in seeds]
    return sum(d[1:], d[0]) / len(seeds)


def draws(spark, reps: int, n: int, slots: int, seed: int) -> DataFrame:
    """Multiplicity w of unit idx in replicate b after ``slots`` keyed draws from ``n`` units."""
    d = spark.range(reps * slots).select(F.expr(f"id div {slots}").alias("b"), (F.col("id") % slots).alias("slot"))
    return d.select("b", F.floor(u(seed, "b", "slot") * n).alias("idx")).groupBy("b", "idx").agg(F.count(F.lit(1)).alias("w"))


def boot_units(units: DataFrame, key: str, cols: list[str], reps: int, seed: int, slots: int | None = None) -> DataFrame:
    """Weighted column sums per replicate.  The unit count is one number read to size the draw."""
    n = units.count()
    idx = dense_index(units.select(key, *cols), [key], u("idx", key))
    w = draws(units.sparkSession, reps, n, slots or n, seed)
    return w.join(idx, "idx").groupBy("b").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])


def boot_chunks(wide: DataFrame, arms, seeds, reps: int, seed: int, slots: int | None = None) -> DataFrame:
    s = boot_units(wide, "chunk", cells(arms, seeds), reps, seed, slots)
    return s.select("b", delta_of(arms, seeds).alias("delta"))


def to_sessions(wide: DataFrame, arms, seeds) -> DataFrame:
    return wide.groupBy("session").agg(*[F.sum(c).alias(c) for c in cells(arms, seeds)])


def boot_cluster(wide: DataFrame, arms, seeds, reps: int, seed: int) -> DataFrame:
    """Sessions are summed first, so the resample works on one row per session."""
    s = boot_units(to_sessions(wide, arms, seeds), "session", cells(arms, seeds), reps, seed)
    return s.select("b", delta_of(arms, seeds).alias("delta"))


def seed_weights(seeds: list[int], seed) -> list[Column]:
    """How often each seed is taken in replicate ``b``, as columns."""
    n = len(seeds)
    slots = [F.floor(u(f"{seed}s", "b", F.lit(k)) * n) for k in range(n)]
    return [sum((F.when(s == i, 1).otherwise(0) for s in slots[1:]), F.when(slots[0] == i, 1).otherwise(0)) for i in range(n)]


def delta_weighted(arms: list[str], seeds: list[int], weights: list[Column], pre: str = "") -> Column:
    """As ``delta_of`` over columns with prefix ``pre``, each seed as often as it was drawn."""
    f1 = lambda a, s: f1_of(F.col(f"{pre}tp_{a}{s}"), F.col(f"{pre}fp_{a}{s}"), F.col(f"{pre}n_gt"))
    d = [w * (f1(arms[1], s) - f1(arms[0], s)) for s, w in zip(seeds, weights)]
    return sum(d[1:], d[0]) / len(seeds)


def _delta(arms, seeds, seed, levels, pre: str = "") -> Column:
    return delta_weighted(arms, seeds, seed_weights(seeds, seed) if "seed" in levels else [F.lit(1)] * len(seeds), pre)


def weight_arrays(spark, reps: int, n: int, seed) -> DataFrame:
    """(idx, w): how often unit idx is drawn in each replicate, as an array over replicates."""
    d = draws(spark, reps, n, n, seed).groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("__m"))
    at = lambda b: F.coalesce(F.try_element_at("__m", b), F.lit(0).cast("long"))
    return d.select("idx", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long")), at).alias("w"))


def boot_crossed(wide: DataFrame, arms, seeds, reps: int, seed: int, levels: tuple[str, ...] = ("session", "block", "seed")) -> DataFrame:
    """Three-level bootstrap with one draw of block positions shared by all sessions; any subset of levels.

    All sessions must have the same number of chunks (see ``truncate_balanced``); positions follow the chunk's order. A
    chunk's weight is the product of its session's and its position's, both arrays over replicates that are joined to the
    chunk; the products are summed before the shuffle, so no row is written for each replicate and chunk.
    """
    cols = cells(arms, seeds)
    size = wide.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    low, high, ns = size.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    if low != high:
        raise ValueError(f"sessions of {low} to {high} chunks; the crossed bootstrap needs equal ones")
    x = wide.select("session", "chunk", *cols)
    if "session" in levels:
        sidx = dense_index(size.select("session"), ["session"], u("idx", "session"), "idx")
        ws = sidx.join(weight_arrays(wide.sparkSession, reps, ns, seed), "idx", "left").select("session", F.col("w").alias("__ws"))
        x = x.join(ws, "session")
    if "block" in levels:
        pos = F.row_number().over(Window.partitionBy("session").orderBy("chunk")) - 1  # sessions are of one size, none is hot
        wb = weight_arrays(wide.sparkSession, reps, low, f"{seed}b").select(F.col("idx").alias("__pos"), F.col("w").alias("__wb"))
        x = x.withColumn("__pos", pos).join(wb, "__pos", "left")
    one = F.array_repeat(F.lit(1).cast("long"), reps)
    none = F.array_repeat(F.lit(0).cast("long"), reps)
    s = F.coalesce("__ws", none) if "session" in levels else one
    b = F.coalesce("__wb", none) if "block" in levels else one
    x = x.select(*cols, F.posexplode(F.zip_with(s, b, lambda p, q: p * q)).alias("b", "w")).filter("w > 0")
    out = x.groupBy(F.col("b").cast("long").alias("b")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])
    return out.select("b", _delta(arms, seeds, seed, levels).alias("delta"))


#: Draws of a copy that are made in one row.
BLOCK = 65536


def nested_draws(wide: DataFrame, reps: int, seeds: list, levels: tuple[str, ...] = ("session", "block")) -> DataFrame:
    """(draw, b, session, pos), a row for each chunk drawn: sessions are drawn, then each drawn copy redraws its own chunks;
    sessions may be ragged. ``draw`` counts ``seeds``, each a resample of its own.

    Without the session level every session is one copy; without the block level a copy takes each chunk once. Draws are
    made in blocks that are dealt over the tasks, so a long session is not drawn in one.
    """
    size = wide.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    ns = size.count()
    sidx = dense_index(size, ["session"], u("idx", "session"), "sidx")
    d = wide.sparkSession.range(len(seeds) * reps * ns).select(
        F.expr(f"id div {reps * ns}").alias("draw"), F.expr(f"id div {ns} % {reps}").alias("b"), (F.col("id") % ns).alias("copy"))
    named = F.get(F.array(*[F.lit(str(s)) for s in seeds]), F.col("draw").cast("int"))
    d = d.withColumn("sidx", F.floor(u(named, "b", "copy") * ns) if "session" in levels else F.col("copy")).join(sidx, "sidx")
    d = d.select("draw", "b", "copy", "session", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("__k"))
    d = d.repartition(n_parts(wide.sparkSession), "draw", "b", "copy", "__k")
    slots = F.sequence(F.col("__k") * BLOCK + 1, F.least("n", (F.col("__k") + 1) * BLOCK))
    d = d.select("draw", "b", "copy", "session", "n", F.explode(slots).alias("slot"))
    pos = F.floor(u(named, "b", "copy", "slot") * F.col("n")) + 1 if "block" in levels else F.col("slot")
    return d.select("draw", "b", "session", pos.alias("pos"))


def drawn_sums(wide: DataFrame, reps: int, seeds: list, levels: tuple[str, ...], cols: list[str], sums) -> DataFrame:
    """Sums over the drawn chunks of each (draw, b).

    Every draw is a narrow row that meets its chunk by (session, pos) in one of many hashed parts; the chunks, fewer and
    wide, are the side in memory, and neither side is sorted or grouped.
    """
    n = n_parts(wide.sparkSession)
    at = block_positions(wide, cols).repartition(n, "session", "pos")
    d = nested_draws(wide, reps, seeds, levels).repartition(n, "session", "pos")
    return d.join(at.hint("shuffle_hash"), ["session", "pos"]).groupBy("draw", "b").agg(*sums)


def block_positions(wide: DataFrame, cols: list[str]) -> DataFrame:
    """Chunks with their keyed position 1..n in the session."""
    return uniform_rank(wide.select("session", "chunk", *cols).withColumn("__u", u("pos", "chunk")), ["session"], "__u", ["chunk"], "pos")


def boot_nested(wide: DataFrame, arms, seeds, reps: int, seed: int, levels: tuple[str, ...] = ("session", "block")) -> DataFrame:
    """Three-level bootstrap of the difference, nested; any subset of session, block and seed."""
    cols = cells(arms, seeds)
    s = drawn_sums(wide, reps, [seed], levels, cols, [F.sum(c).alias(c) for c in cols])
    return s.select("b", _delta(arms, seeds, seed, levels).alias("delta"))


def boot_paired(wide: DataFrame, thin: Column, arms, seeds, reps: int, seed: int, levels: tuple[str, ...] = ("session", "block", "seed")) -> DataFrame:
    """(b, full, thin, diff): the difference read on all chunks and on those that ``thin`` keeps, under one resample."""
    return boot_paired_draws(wide, [thin], arms, seeds, reps, [seed], levels).drop("draw")


def boot_paired_draws(wide: DataFrame, thins: list[Column], arms, seeds, reps: int, draw_seeds: list, levels: tuple[str, ...] = ("session", "block", "seed")) -> DataFrame:
    """(draw, b, full, thin, diff): ``boot_paired`` for each thinning with its own seed, in one pass over the chunks."""
    cols = cells(arms, seeds)
    keep = F.get("__keep", F.col("draw").cast("int"))
    sums = [*[F.sum(c).alias(c) for c in cols], *[F.sum(F.when(keep, F.col(c)).otherwise(0)).alias(f"t_{c}") for c in cols]]
    s = drawn_sums(wide.withColumn("__keep", F.array(*thins)), reps, draw_seeds, levels, [*cols, "__keep"], sums)
    of = lambda pre: reduce(lambda e, k: e.when(F.col("draw") == k, _delta(arms, seeds, draw_seeds[k], levels, pre)), range(1, len(thins)), F.when(F.col("draw") == 0, _delta(arms, seeds, draw_seeds[0], levels, pre)))
    d = s.select("draw", "b", of("").alias("full"), of("t_").alias("thin"))
    return d.withColumn("diff", F.col("thin") - F.col("full"))


def pooled_draws(boot: DataFrame) -> DataFrame:
    """One row from (draw, b, diff): mean over draws, within and between variance and the SE of their sum."""
    per = boot.groupBy("draw").agg(F.avg("diff").alias("m"), F.var_pop("diff").alias("v"))
    g = per.agg(F.count(F.lit(1)).alias("draws"), F.avg("m").alias("mean"), F.avg("v").alias("within"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"))
    return g.withColumn("se", F.sqrt(F.col("within") + F.col("between")))


def boot_stratified(wide: DataFrame, key: str, per: int, arms, seeds, reps: int, seed: int) -> DataFrame:
    """``per`` chunks drawn from every key with replacement: the null model of one more set built the same way."""
    cols = cells(arms, seeds)
    size = wide.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rep = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    d = size.select(key, "n", rep(reps).alias("b")).select("*", rep(per).alias("slot"))
    d = d.select("b", key, (F.floor(u(seed, "b", key, "slot") * F.col("n")) + 1).alias("pos")).groupBy("b", key, "pos").agg(F.count(F.lit(1)).alias("w"))
    x = wide.select(key, "chunk", *cols).join(size, key).withColumn("__u", u("pos", "chunk"))
    pos = sized_rank(x, [key], "__u", ["chunk"], "n", "pos")
    s = d.join(pos, [key, "pos"]).groupBy("b").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])
    return s.select("b", delta_of(arms, seeds).alias("delta"))


def boot_mc_error(wide: DataFrame, arms, seeds, reps: int, seed: int, times: int) -> DataFrame:
    """SE of the session bootstrap in ``times`` independent runs of one draw table: the first, their mean and SD."""
    boot = boot_cluster(wide, arms, seeds, reps * times, seed)
    run = boot.groupBy(F.expr(f"b div {reps}").alias("run")).agg(F.stddev_samp("delta").alias("se"))
    return run.agg(F.count(F.lit(1)).alias("runs"), F.min_by("se", "run").alias("se"), F.avg("se").alias("mean_se"), F.stddev_samp("se").alias("mc_sd"))


def se_without_replacement(rounds: DataFrame, sizes: list[int], arms, seeds, reps: int, seed: int) -> DataFrame:
    """SE of the difference over ``n`` of all rounds drawn without replacement, for each n of ``sizes``.

    ``sigma`` takes the finite population out: sd / sqrt((R - n) / (n (R - 1))); null at n = R. One keyed order of the
    rounds in a replicate serves all sizes, each taking its first n. A round is one row, so a replicate is R rows.
    """
    cols = cells(arms, seeds)
    total = rounds.count()
    d = rounds.select("round", *cols, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("b"))
    d = d.withColumn("__u", u(seed, "b", "round")).withColumn("__r", F.lit(total))
    d = sized_rank(d, ["b"], "__u", ["round"], "__r", "k")
    d = d.select("b", "k", *cols, F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("n")).filter("k <= n")
    s = d.groupBy("n", "b").agg(*[F.sum(c).alias(c) for c in cols]).select("n", "b", delta_of(arms, seeds).alias("delta"))
    g = s.groupBy("n").agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"))
    free = (F.lit(total) - F.col("n")) / (F.col("n") * (F.lit(total) - 1))
    return g.select("n", F.lit(total).cast("long").alias("n_rounds"), "mean", "sd", F.when(free > 0, F.col("sd") / F.sqrt(free)).alias("sigma"))


def summarise(boot: DataFrame) -> DataFrame:
    """Mean, SE, percentile interval and share above zero; one row per replicate comes in."""
    q = lambda p: F.percentile("delta", p)
    return boot.agg(
        F.count(F.lit(1)).alias("reps"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("se"), q(0.025).alias("lo"), q(0.975).alias("hi"),
        F.avg(F.when(F.col("delta") > 0, 1.0).otherwise(0.0)).alias("p_pos"),
    )


def jackknife(wide: DataFrame, arms, seeds) -> DataFrame:
    """Leave-one-session-out difference and influence: total minus own sums, no second scan per session."""
    cols = cells(arms, seeds)
    s = to_sessions(wide, arms, seeds)
    tot = s.agg(*[F.sum(c).alias(f"t_{c}") for c in cols])  # one row
    full = tot.select(*[F.col(f"t_{c}").alias(c) for c in cols]).select(delta_of(arms, seeds).alias("full"))
    loo = s.crossJoin(F.broadcast(tot)).select("session", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in cols])
    return loo.select("session", delta_of(arms, seeds).alias("loo")).crossJoin(F.broadcast(full)).withColumn("influence", F.col("full") - F.col("loo"))


def signflip_test(d: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Exact two-sided sign-flip test over all 2^n sign vectors (n <= 16); ``key`` is 0..n-1."""
    if n > 16:
        raise ValueError("exact test needs n <= 16")
    masks = F.explode(F.sequence(F.lit(0), F.lit(2**n - 1)))
    x = d.select(F.col(key).cast("int").alias("k"), F.col(value).alias("v"), masks.alias("m"))
    bit = F.expr("shiftright(m, k) & 1")
    means = x.groupBy("m").agg(F.avg(F.when(bit == 1, F.col("v")).otherwise(-F.col("v"))).alias("s"))
    obs = d.agg(F.avg(value).alias("observed"))  # one row
    return means.crossJoin(F.broadcast(obs)).groupBy("observed").agg(
        F.avg(F.when(F.abs("s") >= F.abs("observed") - 1e-12, 1.0).otherwise(0.0)).alias("p"), F.count(F.lit(1)).alias("n_perm")
    )


def variance_components(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Two-way random effects without replication: row, column and residual variance (one value per cell)."""
    r, c = Window.partitionBy(row), Window.partitionBy(col)
    x = df.select(row, col, F.col(value).alias("v"), F.avg(value).over(r).alias("rm"), F.avg(value).over(c).alias("cm"))
    g = x.agg(F.avg("v").alias("g"), F.countDistinct(row).alias("a"), F.countDistinct(col).alias("b"))
    y = x.crossJoin(F.broadcast(g)).agg(
        F.max("a").alias("a"), F.max("b").alias("b"), F.sum(F.pow(F.col("rm") - F.col("g"), 2)).alias("ssr"), F.sum(F.pow(F.col("cm") - F.col("g"), 2)).alias("ssc"),
        F.sum(F.pow(F.col("v") - F.col("rm") - F.col("cm") + F.col("g"), 2)).alias("sse"),
    )
    mse = F.col("sse") / ((F.col("a") - 1) * (F.col("b") - 1))
    return y.select(
        ((F.col("ssr") / (F.col("a") - 1) - mse) / F.col("b")).alias("var_row"), ((F.col("ssc") / (F.col("b") - 1) - mse) / F.col("a")).alias("var_col"), mse.alias("var_res")
    )
