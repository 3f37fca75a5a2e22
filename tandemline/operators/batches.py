"""Is a new batch of chunks like the old ones, and where does the spread of repeated runs come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keyed import u
from .resample import cells, delta_of, draws, weight_arrays
from .scan import dense_index, sized_rank
from .stats import t975

_CELLS = 1024


def _each(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def smallest(df: DataFrame, by: list[str], rand: str, tie: list[str], quota: Column) -> DataFrame:
    """The ``quota`` rows of each group with the smallest ``rand`` (uniform on [0, 1)).

    Rows are counted in fixed cells of ``rand`` first. Whole cells below the one in which the quota ends are kept without
    ordering; only that cell's rows, a thousandth of a group, are ranked. Groups are few (replicate and class).
    """
    d = df.withColumn("__q", quota).withColumn("__c", F.floor(F.col(rand) * _CELLS))
    below = F.sum("__n").over(Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    hist = d.groupBy(*by, "__c").agg(F.count(F.lit(1)).alias("__n"), F.first("__q").alias("__q"))
    room = hist.withColumn("__below", F.coalesce(below, F.lit(0))).filter("__below < __q")
    room = room.select(*by, "__c", (F.col("__q") - F.col("__below")).alias("__room"), (F.col("__below") + F.col("__n") <= F.col("__q")).alias("__whole"))
    j = d.drop("__q").join(room, [*by, "__c"])
    w = Window.partitionBy(*by).orderBy(rand, *tie)
    edge = j.filter("not __whole").withColumn("__k", F.row_number().over(w)).filter("__k <= __room")
    return j.filter("__whole").select(*df.columns).unionByName(edge.select(*df.columns))


def balanced_draw(df: DataFrame, unit: str, cls: str, key: str, n: int, reps: int, seed: int) -> DataFrame:
    """(b, class, key, w): units are resampled with replacement, then ``n`` rows a class without replacement from the
    repeated rows; ``w`` is how many of a row's copies were taken. A class with fewer rows gives all it has.

    A copy is a number made where the row is read, so of the copies only those taken and one boundary cell are shuffled.
    """
    units = df.select(unit).distinct()
    total = units.count()
    mult = draws(df.sparkSession, reps, total, total, seed).join(dense_index(units, [unit], u("idx", unit)), "idx").select("b", unit, "w")
    copies = df.select(unit, cls, key).join(mult, unit).select("b", cls, key, F.explode(F.sequence(F.lit(1).cast("long"), "w")).alias("copy"))
    taken = smallest(copies.withColumn("__u", u(f"{seed}c", "b", key, "copy")), ["b", cls], "__u", [key, "copy"], F.lit(n))
    return taken.groupBy("b", cls, key).agg(F.count(F.lit(1)).alias("w"))


def boot_reweighted(wide: DataFrame, positive: Column, share: float, slots: int, arms, seeds, reps: int, seed: int) -> DataFrame:
    """(b, prevalence, delta): each of ``slots`` draws takes a positive chunk with probability ``share``, else a negative one."""
    cols = cells(arms, seeds)
    x = wide.select("chunk", *cols, positive.cast("int").alias("pos"))
    size = {r.pos: r.n for r in x.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers
    if (share > 0 and not size.get(1)) or (share < 1 and not size.get(0)):
        raise ValueError("a pool to draw from is empty")
    n = F.when(F.col("pos") == 1, size.get(1, 0)).otherwise(size.get(0, 0))
    pool = sized_rank(x.withColumn("__u", u("idx", "chunk")).withColumn("__n", n), ["pos"], "__u", ["chunk"], "__n", "idx")
    d = wide.sparkSession.range(reps * slots).select(F.expr(f"id div {slots}").alias("b"), (F.col("id") % slots).alias("slot"))
    d = d.withColumn("pos", (u(f"{seed}p", "b", "slot") < share).cast("int"))
    d = d.select("b", "pos", (F.floor(u(seed, "b", "slot") * n) + 1).alias("idx")).groupBy("b", "pos", "idx").agg(F.count(F.lit(1)).alias("w"))
    s = d.join(pool, ["pos", "idx"]).groupBy("b").agg(
        (F.sum(F.col("w") * F.col("pos")) / F.lit(slots)).alias("prevalence"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])
    return s.select("b", "prevalence", delta_of(arms, seeds).alias("delta"))


def _chunk_se(sub: DataFrame, arms, seeds, size: int, boot: int, seed: int) -> DataFrame:
    """(b, se): SE over ``boot`` resamples of the ``size`` chunks of each b; ``k`` is the chunk's position from 1."""
    cols = cells(arms, seeds)
    w = weight_arrays(sub.sparkSession, boot, size, f"{seed}w").select((F.col("idx") + 1).alias("k"), "w")
    x = sub.join(w, "k").select("b", *cols, F.posexplode("w").alias("r", "w")).filter("w > 0")
    s = x.groupBy("b", "r").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])
    return s.select("b", delta_of(arms, seeds).alias("d")).groupBy("b").agg(F.stddev_samp("d").alias("se"))


def batch_percentile(old: DataFrame, new: DataFrame, positive: Column, arms, seeds, reps: int, boot: int, seed: int) -> DataFrame:
    """A new batch's difference and its chunk SE within those of batches drawn from the old pool.

    Draws have the new batch's size and its number of positive chunks, without replacement. They spread less than fresh
    batches would: ``sd_fresh`` is sd * sqrt((N - 1) / (N - K)), and z is taken with it; null where K = N. ``percentile``
    is the share of draws below the new batch's value.
    """
    cols = cells(arms, seeds)
    pick = lambda df: df.select("chunk", *cols, positive.cast("int").alias("pos"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("y")).first()
    o, b = pick(old), pick(new)
    (n, y), (k, q) = count(o), count(b)
    if not k or q > y or k - q > n - y:
        raise ValueError(f"no {k} chunks with {q} positive ones among {n} with {y}")
    d = o.select("*", F.explode(_each(reps)).alias("b")).withColumn("__u", u(seed, "b", "chunk"))
    d = smallest(d, ["b", "pos"], "__u", ["chunk"], F.when(F.col("pos") == 1, q).otherwise(k - q))
    both = d.unionByName(b.withColumn("b", F.lit(-1).cast("long")).withColumn("__u", u(seed, "b", "chunk")))
    sub = sized_rank(both.withColumn("__k", F.lit(k)), ["b"], "__u", ["chunk"], "__k", "k")
    delta = sub.groupBy("b").agg(*[F.sum(c).alias(c) for c in cols]).select("b", delta_of(arms, seeds).alias("delta"))
    long = delta.join(_chunk_se(sub, arms, seeds, k, boot, seed), "b").select("b", F.inline(F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("delta", "se")])))
    now = long.filter("b = -1").select("measure", F.col("v").alias("observed"))  # two rows
    g = long.filter("b >= 0").join(F.broadcast(now), "measure").groupBy("measure", "observed").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
        F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"), (100 * F.avg((F.col("v") < F.col("observed")).cast("double"))).alias("percentile"))
    fresh = F.when(F.lit(n > k), F.col("sd") * F.sqrt(F.lit((n - 1) / max(n - k, 1))))
    return g.withColumn("sd_fresh", fresh).withColumn("z", (F.col("observed") - F.col("mean")) / F.nullif(F.col("sd_fresh"), F.lit(0.0)))


def order_effect(df: DataFrame, at: str, value: str, reps: int, seed: int) -> DataFrame:
    """Correlation of a batch's position with its value, correlation with the next batch, and the share of random orders
    whose correlation is at least as strong; one row a batch, positions 0 to R - 1.

    The neighbour test keeps the batches in place and shuffles their successors.
    """
    x = df.select(F.col(at).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    n = x.count()
    d = x.select("i", "v", F.explode(_each(reps)).alias("b")).withColumn("__u", u(seed, "b", "i")).withColumn("__n", F.lit(n))
    shuffled = sized_rank(d, ["b"], "__u", ["i"], "__n", "k").select("b", (F.col("k") - 1).alias("j"), F.col("v").alias("y"))
    same = x.select("i", "v", F.lit(-1).cast("long").alias("b")).select("b", F.col("i").alias("j"), F.col("v").alias("y"))
    y = shuffled.unionByName(same)  # b = -1 is the order as it is
    pair = y.join(F.broadcast(x.select((F.col("i") + 1).alias("j"), F.col("v").alias("before"))), "j", "left")  # one row a batch
    r = pair.groupBy("b").agg(F.corr("j", "y").alias("trend"), F.corr("before", "y").alias("lag1"))
    seen = r.filter("b = -1").select(F.col("trend").alias("r_trend"), F.col("lag1").alias("r_lag1"))
    strong = lambda c: F.avg((F.abs(c) >= F.abs(f"r_{c}") - 1e-12).cast("double"))
    out = r.filter("b >= 0").crossJoin(F.broadcast(seen)).groupBy("r_trend", "r_lag1").agg(strong("trend").alias("p_trend"), strong("lag1").alias("p_lag1"))
    return out.select(F.lit(n).cast("long").alias("n"), "*")


def cross_set_corr(a: DataFrame, b: DataFrame, run: str, value: str) -> DataFrame:
    """The same runs on two sets: a row per run with the correlation without it, and r, rank r and critical r of all.

    Sums without a run are the totals less its own terms, taken about the means. Runs on one side alone, or without a
    value, are left out.
    """
    j = a.select(run, F.col(value).cast("double").alias("x")).join(b.select(run, F.col(value).cast("double").alias("y")), run).dropna()
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2  # noqa: E731 - runs, not corpus rows
    j = j.withColumn("rx", rank("x")).withColumn("ry", rank("y"))
    tot = j.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.corr("rx", "ry").alias("rho"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = j.crossJoin(F.broadcast(tot)).select(run, "n", "r", "rho", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    sums = d.agg(*[F.sum(e).alias(k) for k, e in (("xx", F.col("x") ** 2), ("yy", F.col("y") ** 2), ("xy", F.col("x") * F.col("y")))])
    m = F.col("n") - 1  # about the mean the total is 0, so the rest's is minus the run's own
    less = lambda s, p, q: F.col(s) - F.col(p) * F.col(q) - F.col(p) * F.col(q) / F.nullif(m, F.lit(0))
    spread = less("xx", "x", "x") * less("yy", "y", "y")
    loo = F.when((F.col("n") > 2) & (spread > 0), less("xy", "x", "y") / F.sqrt(spread))
    t = t975(F.when(F.col("n") > 2, F.col("n") - 2))
    return d.crossJoin(F.broadcast(sums)).select(run, "n", "r", "rho", loo.alias("loo_r"), (t / F.sqrt(F.col("n") - 2 + t * t)).alias("r_critical"))


def split_variance(df: DataFrame, group: str, run: str, arm: str, arms: list[str], value: str) -> DataFrame:
    """Variance of the arms' difference over the runs of two groups, 0 and 1: what group 0 varies beyond group 1.

    ``rest`` is never cut at 0: a negative one says that the two cannot be told apart. ``share_run`` is the part of a
    group's spread that both arms have in common, from the variances of their sums and differences over runs.
    """
    side = lambda k: F.max(F.when(F.col(arm) == arms[k], F.col(value)))
    w = df.groupBy(group, run).agg(side(0).alias("p"), side(1).alias("q")).dropna()
    plus, minus = F.var_samp(F.col("p") + F.col("q")), F.var_samp(F.col("q") - F.col("p"))
    g = w.groupBy(group).agg(F.count(F.lit(1)).alias("n"), minus.alias("var_diff"), plus.alias("var_sum"))
    at = lambda k, c: F.max(F.when(F.col(group) == k, F.col(c)))
    common = lambda k: (at(k, "var_sum") - at(k, "var_diff")) / F.nullif(at(k, "var_sum") + at(k, "var_diff"), F.lit(0.0))
    out = g.agg(*[at(k, c).alias(f"{c}_{k}") for k in (0, 1) for c in ("n", "var_diff")], *[common(k).alias(f"share_run_{k}") for k in (0, 1)])
    return out.withColumn("rest", F.col("var_diff_0") - F.col("var_diff_1")).withColumn("ratio", F.col("var_diff_1") / F.nullif(F.col("var_diff_0"), F.lit(0.0)))


def replicate_noise(df: DataFrame, config: str, replicate: str, value: str) -> DataFrame:
    """Spread of repeats of one configuration (pooled over those with several) against that of the configurations' means."""
    g = df.filter(F.col(value).isNotNull()).groupBy(config).agg(F.countDistinct(replicate).alias("k"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    twice = F.col("k") > 1
    pooled = F.sum(F.when(twice, F.col("v") * (F.col("k") - 1))) / F.sum(F.when(twice, F.col("k") - 1))
    out = g.agg(F.count(F.lit(1)).alias("configs"), F.count_if(twice).alias("repeated"), F.sqrt(pooled).alias("sd_repeat"), F.stddev_samp("m").alias("sd_config"))
    return out.withColumn("ratio", F.col("sd_repeat") / F.nullif(F.col("sd_config"), F.lit(0.0)))


def drop_group_check(df: DataFrame, source: str, node: str, value: str) -> DataFrame:
    """SD of each source's runs, and what it is without the runs of each node; one row per (source, node).

    A node's part is taken off the source's count, sum and squares about the source's mean.
    """
    mean = df.groupBy(source).agg(F.avg(value).alias("__m"))
    c = df.join(mean, source).withColumn("__v", F.col(value) - F.col("__m")).filter("__v is not null")
    part = c.groupBy(source, node).agg(F.count(F.lit(1)).alias("n_node"), F.sum("__v").alias("__s"), F.sum(F.col("__v") ** 2).alias("__q"))
    tot = part.groupBy(source).agg(F.sum("n_node").alias("n"), F.sum("__s").alias("__ts"), F.sum("__q").alias("__tq"))
    j = part.join(tot, source)
    sd = lambda n, s, q: F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), q - s * s / n) / (n - 1)))
    full = sd(F.col("n"), F.col("__ts"), F.col("__tq"))
    rest = sd(F.nullif(F.col("n") - F.col("n_node"), F.lit(0)), F.col("__ts") - F.col("__s"), F.col("__tq") - F.col("__q"))
    return j.select(source, node, "n", "n_node", full.alias("sd"), rest.alias("sd_without"), (rest / F.nullif(full, F.lit(0.0))).alias("ratio"))
