"""Evaluation-set construction: exclusion by time, round-robin, prevalence, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .scan import running, uniform_rank


def near_used(cands: DataFrame, used: DataFrame, keys: list[str], t: str, length: float, apart: bool = False, how: str = "left_semi") -> DataFrame:
    """Candidates with a used chunk of the same key closer than ``length`` (without, if ``how`` says so): an equi-join on time cells.

    ``apart`` leaves out used chunks at the very same time. Chunks that just touch are not closer, whatever the rounding.
    """
    k = F.floor(F.col(t) / length)
    a = cands.withColumn("__k", k)
    b = used.select(*keys, F.col(t).alias("__ut"), F.explode(F.array(k - 1, k, k + 1)).alias("__k"))
    dist = F.abs(F.col(f"a.{t}") - F.col("__ut"))
    near = (dist < length - 1e-9) & (dist > 0) if apart else dist < length - 1e-9
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*keys, "__k"]]
    return a.alias("a").join(b.alias("b"), [*same, near], how).drop("__k")


def exclude_overlapping(cands: DataFrame, used: DataFrame, keys: list[str], cid: str, t: str, length: float) -> DataFrame:
    """Candidates that are neither used nor closer than ``length`` to a used chunk of the same key. Ids are unique."""
    return near_used(cands.join(used.select(cid), cid, "left_anti"), used, keys, t, length, how="left_anti")


def flag_adjacent(cands: DataFrame, used: DataFrame, keys: list[str], t: str, length: float) -> DataFrame:
    """Candidates that overlap a used chunk at another time."""
    return near_used(cands, used, keys, t, length, apart=True)


def split_rounds(df: DataFrame, key: list[str], rand: Column, tie: list[str], per: int) -> DataFrame:
    """All rounds in batches of ``per``; a batch is complete if every key has a row in each of its rounds."""
    r = uniform_rank(df.withColumn("__u", rand), key, "__u", tie, "__rnd")
    g = r.groupBy(F.expr(f"(__rnd - 1) div {per}").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*key).alias("n_keys"))
    keys = df.agg(F.countDistinct(*key).alias("__keys"))  # one row
    return g.crossJoin(F.broadcast(keys)).select("batch", "n", "n_keys", (F.col("n") == per * F.col("__keys")).cast("long").alias("complete"))


def round_robin(df: DataFrame, key: list[str], n: int, rand: Column, tie: list[str]) -> DataFrame:
    """One row per key per round in keyed-random order until ``n`` rows; prefix-stable."""
    r = uniform_rank(df.withColumn("__u", rand), key, "__u", tie, "round")
    out = running(r, [], F.col("round"), ["round", *key], {"pick": ("count", F.lit(1))}, inclusive=True)
    return out.filter(F.col("pick") <= n).drop("__u")


def thin_to_prevalence(df: DataFrame, positive: Column, target: float, rand: Column, tie: list[str]) -> DataFrame:
    """All negatives and the prefix of shuffled positives whose prevalence is nearest the target."""
    x = df.withColumn("__pos", positive)
    pos = uniform_rank(x.filter("__pos").withColumn("__u", rand), [], "__u", tie, "k")
    n_neg = x.filter(~F.col("__pos")).agg(F.count(F.lit(1)).alias("n_neg"))  # one row
    gap = F.abs(F.col("k") / (F.col("k") + F.col("n_neg")) - target)
    best = pos.crossJoin(F.broadcast(n_neg)).agg(F.min_by("k", F.struct(gap, F.col("k"))).alias("cut"))
    kept = pos.crossJoin(F.broadcast(best)).filter("k <= cut").drop("k", "cut", "__u")
    return x.filter(~F.col("__pos")).unionByName(kept).drop("__pos")


def truncate_balanced(df: DataFrame, key: str, rand: Column, tie: list[str]) -> DataFrame:
    """Every session cut to the size of the smallest one."""
    m = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m"))  # one row
    r = uniform_rank(df.withColumn("__u", rand), [key], "__u", tie, "rn")
    return r.crossJoin(F.broadcast(m)).filter("rn <= m").drop("__u", "rn", "m")


def raise_prevalence(df: DataFrame, positive: Column, current: float, target: float, rand: Column) -> DataFrame:
    """Drop negatives at random to raise the positive share; a lower target is refused."""
    if target < current:
        raise ValueError("a lower prevalence needs thin_to_prevalence")
    q = current * (1 - target) / (target * (1 - current))
    return df.filter(positive | (rand < q))


def first_by(df: DataFrame, n: int, rand: Column, tie: list[str]) -> DataFrame:
    """The first ``n`` rows in keyed-random order: each task keeps its own first n, nothing is ranked as a whole."""
    return df.withColumn("__u", rand).orderBy("__u", *tie).limit(n).drop("__u")


def select_train(df: DataFrame, pos: Column, hard: Column, n: int, rand: Column, tie: list[str], per: int = 4096) -> DataFrame:
    """Rows in keyed-random order with their class: 3/4 positive, 1/8 hard negative, plain negatives for the rest.

    The order is read up to the first row at which the positive quota is full and the negatives of both kinds are a quarter
    of ``n``; later rows count for nothing. The plain quota is a quarter less all hard negatives read, also those beyond
    their own quota. A row that is both counts as positive. Rows are counted in cells of about ``per`` first, so only cells
    up to the one that holds the stop are put in order.
    """
    cls = F.when(pos, "positive").when(hard, "hard").otherwise("plain")
    d = cut_lineage(df.withColumn("cls", cls).withColumn("__u", rand))  # read four times below
    cells = max(1, -(-d.count() // per))
    one = lambda c: F.col("cls").isin(*c).cast("long")
    d = d.withColumn("__c", F.floor(F.col("__u") * cells))
    kinds = {"__p": ("positive",), "__h": ("hard",), "__n": ("plain",)}
    hist = d.groupBy("__c").agg(*[F.sum(one(c)).alias(k) for k, c in kinds.items()])
    upto = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    below = hist.select("__c", *[F.coalesce(F.sum(k).over(upto), F.lit(0)).alias(f"{k}0") for k in kinds])  # a row a cell
    full = lambda tag="": (F.col(f"__p{tag}") >= n * 3 // 4) & (F.col(f"__h{tag}") + F.col(f"__n{tag}") >= n // 4)
    need = d.join(below.filter(~full("0")), "__c")
    w = Window.partitionBy("__c").orderBy("__u", *tie).rowsBetween(Window.unboundedPreceding, 0)
    run = need.select(*df.columns, "cls", "__u", *[(F.col(f"{k}0") + F.sum(one(c)).over(w)).alias(k) for k, c in kinds.items()])
    read = F.coalesce(F.min(F.when(full(), F.col("__p") + F.col("__h") + F.col("__n"))), F.max(F.col("__p") + F.col("__h") + F.col("__n")))
    stop = run.agg(read.alias("__stop"))
    seen = run.crossJoin(F.broadcast(stop)).filter("__p + __h + __n <= __stop")  # one row
    left = seen.agg(F.greatest(F.lit(0), n // 4 - F.coalesce(F.max("__h"), F.lit(0))).alias("__left"))
    keep = F.when(F.col("cls") == "positive", F.col("__p") <= n * 3 // 4).when(F.col("cls") == "hard", F.col("__h") <= n // 8).otherwise(F.col("__n") <= F.col("__left"))
    return seen.crossJoin(F.broadcast(left)).filter(keep).select(*df.columns, "cls")


def select_balanced(df: DataFrame, cls: str, n: int, rand: Column, tie: list[str]) -> DataFrame:
    """A sixth backchannel and half speak, at most what there is of them and at least one row's quota; listen fills up to ``n``."""
    part = lambda name, k: first_by(df.filter(F.col(cls) == name), k, rand, tie)
    bc, speak = part("backchannel", max(1, n // 6)), part("speak", max(1, n // 2))
    left = n - bc.count() - speak.count()  # two numbers of at most n
    return bc.unionByName(speak).unionByName(part("listen", max(1, left)))


def stratified_sample(df: DataFrame, positive: Column, per: int, n: int, rand: Column, again: Column, tie: list[str]) -> DataFrame:
    """Up to ``per`` rows of each stratum, shuffled together, the first ``n`` of them. A null truth belongs to neither."""
    both = first_by(df.filter(positive), per, rand, tie).unionByName(first_by(df.filter(~positive), per, rand, tie))
    return first_by(both, n, again, tie)


def extend_set(frozen: DataFrame, pool: DataFrame, used: DataFrame, key: str, pos: str, total: int, rand: Column) -> DataFrame:
    """(key, pos): the frozen ids at their positions, then ids of the pool in keyed order that are neither frozen nor used,
    up to ``total``. A frozen set of ``total`` ids or more is cut to its first."""
    frozen = cut_lineage(frozen.select(key, pos))  # a set of about ``total`` rows, read several times
    have = frozen.count()
    if have >= total:
        return frozen.orderBy(pos).limit(total)
    new = first_unused(pool.select(key), frozen.select(key).unionByName(used.select(key)), key, total - have, rand)
    w = Window.orderBy("__u", key)  # at most ``total`` rows
    return frozen.unionByName(new.select(key, (F.row_number().over(w) + have - 1).cast("long").alias(pos)))


def first_unused(pool: DataFrame, used: DataFrame, key: str, n: int, rand: Column) -> DataFrame:
    """(key, __u): the first ``n`` rows of the pool in keyed order whose key is not used.

    Only the first rows are compared with the used ones. If too few of them are left, four times as many are read, up to
    the whole pool.
    """
    pool, read = pool.withColumn("__u", rand), 4 * n
    while True:
        head = cut_lineage(pool.orderBy("__u", key).limit(read))
        hit = used.join(F.broadcast(head.select(key)) if read <= 100_000 else head.select(key), key, "left_semi").distinct()
        left = cut_lineage(head.join(hit, key, "left_anti").orderBy("__u", key).limit(n))
        if left.count() == n or head.count() < read:
            return left
        read *= 4


def next_sessions(sessions: DataFrame, used: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` sessions that follow the last used one in sorted order; none of them is used."""
    last = used.agg(F.max(key).alias("__last"))  # one row
    after = sessions.select(key).distinct().crossJoin(F.broadcast(last)).filter(F.col("__last").isNull() | (F.col(key) > F.col("__last")))
    return after.select(key).orderBy(key).limit(n)


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, as a map-side combined aggregate rather than a window."""
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return g.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def pending(todo: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Keys that lack any of the outputs."""
    have = done[0].select(key).distinct()
    for d in done[1:]:
        have = have.join(d.select(key), key, "left_semi")
    return todo.join(have, key, "left_anti")


def check_prefix_unique(df: DataFrame, col: str, n: int) -> DataFrame:
    """Prefixes shared by more than one id."""
    return df.groupBy(F.substring(col, 1, n).alias("prefix")).agg(F.countDistinct(col).alias("n_ids")).filter("n_ids > 1")


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Status of each key of two listings: only_left, only_right, mismatch or same."""
    j = a.select(key, F.col(value).alias("x"), F.lit(1).alias("l")).join(b.select(key, F.col(value).alias("y"), F.lit(1).alias("r")), key, "full")
    st = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(~F.col("x").eqNullSafe(F.col("y")), "mismatch").otherwise("same")
    return j.select(key, st.alias("status"))


def write_shards(df: DataFrame, n: int, rand: Column, tie: list[str]) -> DataFrame:
    """Shard number by row position modulo n, stable across reruns."""
    r = uniform_rank(df.withColumn("__u", rand), [], "__u", tie, "__rn")
    return r.withColumn("shard", (F.col("__rn") - 1) % n).drop("__u", "__rn")
