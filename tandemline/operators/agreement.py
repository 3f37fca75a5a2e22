"""Agreement and scoring: AUC, kappa, confusion, thresholds, consensus, hit tiers."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keyed import u
from .scan import in_cells, n_parts, uniform_rank, value_cuts


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Exact rank-sum AUC with average ranks on ties; null when a class is missing.

    Rows are ranked inside value cells and the cells' counts are carried on, so a row is shuffled once at most; scores that
    repeat much are collapsed to distinct values first.
    """
    by = by or []
    one = lambda k: F.count_if(F.col("__y") == k).alias("__p" if k else "__n")
    d = df.filter(F.col(score).isNotNull()).select(
        *by, F.col(score).cast("double").alias("__v"), F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0).cast("tinyint").alias("__y")
    )
    cuts = value_cuts(d, "__v")
    if by or cuts != sorted(set(cuts)):
        v = in_cells(d.groupBy(*by, "__v").agg(one(1), one(0)), "__v", cuts, "__c")
    else:
        v = in_cells(d, "__v", cuts, "__c").repartition(n_parts(df.sparkSession), "__c").groupBy("__c", "__v").agg(one(1), one(0))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("__w", F.col("__p") * (before(Window.partitionBy(*by, "__c").orderBy("__v")) + F.col("__n") / 2))
    return auc_of_cells(v.groupBy(*by, "__c").agg(*[F.sum(x).alias(x) for x in ("__p", "__n", "__w")]), by)


def auc_of_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """AUC from a row per cell of values __c: positives __p, negatives __n, and the pairs of the cell won by positives __w."""
    below = F.sum("__n").over(Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    c = cells.withColumn("__w", F.col("__w") + F.col("__p") * F.coalesce(below, F.lit(0)))
    g = c.groupBy(*by).agg(F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"), F.sum("__w").alias("__w"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(*by, "n_pos", "n_neg", F.when(ok, F.col("__w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def array_auc(scores: Column, labels: Column) -> Column:
    """AUC of one row's short arrays of scores and labels (0/1), ties counted half; null when a class is missing."""
    z = F.arrays_zip(scores.alias("v"), labels.alias("y"))
    of = lambda k: F.transform(F.filter(z, lambda x: x["y"] == k), lambda x: x["v"])
    add = lambda a, v: F.aggregate(a, F.lit(0.0), lambda s, x: s + v(x))
    won = add(of(1), lambda p: add(of(0), lambda n: F.when(p > n, 1.0).when(p == n, 0.5).otherwise(0.0)))
    return won / F.nullif(F.size(of(1)) * F.size(of(0)), F.lit(0))


def response_and_alignment(df: DataFrame, tau: float, by: list[str]) -> DataFrame:
    """Share of windows with wscore >= tau, and AUC of wscore against realized."""
    d = df.withColumn("__y", (F.col("realized") != "None").cast("int"))
    rate = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("wscore") >= tau, 1.0).otherwise(0.0)).alias("response_rate"))
    a = auc(d, "wscore", "__y", by).select(*by, F.col("auc").alias("alignment"))
    return rate.join(a, by) if by else rate.crossJoin(F.broadcast(a))


def cap_negatives(df: DataFrame, label: str, n: int | None, rand: Column, tie: list[str]) -> DataFrame:
    """All positives and the first ``n`` negatives in keyed-random order, or every row that has a label if ``n`` is None."""
    if n is None:
        return df.filter(F.col(label).isin(0, 1))
    neg = uniform_rank(df.filter(F.col(label) == 0).withColumn("__u", rand), [], "__u", tie).filter(F.col("rn") <= n)
    return df.filter(F.col(label) == 1).unionByName(neg.drop("__u", "rn"))


def threshold_sweep(scores: DataFrame, score: str, truth: Column, taus: list[float]) -> DataFrame:
    """Coverage of positives, precision, recall and F1 for each threshold in one scan."""
    x = scores.select(F.col(score).alias("__s"), truth.cast("int").alias("__y"), F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    hit = F.col("__s") >= F.col("tau")
    g = x.groupBy("tau").agg(
        F.count_if(hit & (F.col("__y") == 1)).alias("tp"), F.count_if(hit & (F.col("__y") == 0)).alias("fp"), F.count_if(~hit & (F.col("__y") == 1)).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rate = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return g.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts and row shares of every pair of labels."""
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))  # rows are label pairs


def best_relabelling(df: DataFrame, a: str, b: str, labels: list) -> DataFrame:
    """Agreement share under the best one-to-one renaming of ``a``'s labels (at most a few labels)."""
    perms = [list(p) for p in permutations(labels)]
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    maps = F.array(*[F.struct(F.lit(i).alias("perm"), F.create_map(*[F.lit(v) for pair in zip(labels, p) for v in pair]).alias("m")) for i, p in enumerate(perms)])
    x = g.select("*", F.inline(maps))
    s = x.groupBy("perm").agg((F.sum(F.when(F.try_element_at("m", F.col(a)) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    return s.agg(F.max("agreement").alias("agreement"))


def cohen_kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa from one count table; null when expected agreement is one."""
    by = by or []
    g = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    tot = g.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(a).eqNullSafe(F.col(b)), F.col("n")).otherwise(0)) / F.sum("n")).alias("po"))
    ma = g.groupBy(*by, F.col(a).cast("string").alias("lab")).agg(F.sum("n").alias("na"))
    mb = g.groupBy(*by, F.col(b).cast("string").alias("lab")).agg(F.sum("n").alias("nb"))
    pe = ma.join(mb, [*by, "lab"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("__e"))
    j = tot.join(pe, by, "left") if by else tot.crossJoin(F.broadcast(pe))
    e = F.coalesce("__e", F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select(*by, "n", "po", e.alias("pe"), F.when(e < 1, (F.col("po") - e) / (1 - e)).alias("kappa"))


def pairwise_kappa(df: DataFrame, sources: list[str], strict_drop: str | None = None, lenient_none: str = "None") -> DataFrame:
    """Kappa of every pair of sources; strict drops a class, lenient maps it to None.  One scan for all pairs."""
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1 :]]
    arr = F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])
    x = df.select(F.inline(arr))
    if strict_drop is None:
        return cohen_kappa(x, "x", "y", ["pair"]).withColumn("variant", F.lit("plain"))
    strict = x.filter((F.col("x") != strict_drop) & (F.col("y") != strict_drop)).withColumn("variant", F.lit("strict"))
    soft = lambda c: F.when(F.col(c) == strict_drop, lenient_none).otherwise(F.col(c)).alias(c)
    lenient = x.select("pair", soft("x"), soft("y")).withColumn("variant", F.lit("lenient"))
    return cohen_kappa(strict.unionByName(lenient), "x", "y", ["pair", "variant"])


def consensus(df: DataFrame, sources: list[str], outcome: Column) -> DataFrame:
    """Groups by which sources fired, with size, realized share and coverage of all realized rows."""
    g = df.groupBy(*sources).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome.cast("long")).alias("n_real"))
    tot = Window.partitionBy()  # at most 2^k rows here
    return g.select(*sources, "n", (F.col("n_real") / F.col("n")).alias("real_share"), (F.col("n_real") / F.sum("n_real").over(tot)).alias("coverage"))


def set_scores(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Precision, recall and F1 of two sets per row, then their mean over rows (a mean of ratios)."""
    both = F.size(F.array_intersect(pred, truth))
    p = F.when(F.size(pred) > 0, both / F.size(pred)).otherwise(0.0)
    r = F.when(F.size(truth) > 0, both / F.size(truth)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"))


def fleiss_and_ac1(slots: DataFrame, cats: list[str], by: list[str] | None = None) -> DataFrame:
    """Fleiss' kappa and Gwet's AC1 with varying numbers of raters in one pass; single-rater slots dropped."""
    by = by or []
    m = sum((F.col(c) for c in cats[1:]), F.col(cats[0]))
    s = slots.withColumn("__m", m).filter("__m >= 2")
    sq = sum((F.col(c) * F.col(c) for c in cats[1:]), F.col(cats[0]) * F.col(cats[0]))
    pi = (sq - F.col("__m")) / (F.col("__m") * (F.col("__m") - 1))
    g = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_slots"), F.sum("__m").alias("n_votes"), F.avg(pi).alias("p_bar"),
        *[F.sum(c).alias(f"__{c}") for c in cats],
    )
    return kappa_columns(g, cats, by)


def kappa_columns(g: DataFrame, cats: list[str], keep: list[str]) -> DataFrame:
    q = [F.col(f"__{c}") / F.col("n_votes") for c in cats]
    pe = sum((x * x for x in q[1:]), q[0] * q[0])
    pg = (1 - pe) / (len(cats) - 1)
    return g.select(
        *keep, "n_slots", "n_votes", "p_bar", pe.alias("p_e"), F.when(pe < 1, (F.col("p_bar") - pe) / (1 - pe)).alias("kappa"),
        F.when(pg < 1, (F.col("p_bar") - pg) / (1 - pg)).alias("ac1"),
    )
