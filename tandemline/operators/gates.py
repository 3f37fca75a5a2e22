"""Checks that name the offending rows, and gates that refuse a table while a check finds any."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Offending rows that an error message names.
NAMED = 20


def gated(df: DataFrame, faults: DataFrame, what: str, key: list[str]) -> DataFrame:
    """``df`` as it is; the job fails with the number and the first keys of ``faults`` if there are any.

    The check is part of the plan: one row with the count and at most ``NAMED`` keys is joined to every row of ``df``.
    """
    named = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key]).alias("__k")
    some = faults.select(named).orderBy("__k").limit(NAMED).agg(F.array_join(F.array_sort(F.collect_list("__k")), ", ").alias("__names"))
    state = faults.agg(F.count(F.lit(1)).alias("__n")).crossJoin(some)  # one row
    text = F.concat(F.lit(f"{what}: "), F.col("__n").cast("string"), F.lit(", such as "), F.col("__names"))
    ok = F.when(F.col("__n") > 0, F.raise_error(text).cast("boolean")).otherwise(True)
    return df.crossJoin(F.broadcast(state)).filter(ok).drop("__n", "__names")


def missing_cells(df: DataFrame, arms: list[str], seeds: list[int]) -> DataFrame:
    """(arm, seed) pairs of the grid without a row."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, s) for a in arms for s in seeds], "arm string, seed long")
    return grid.join(df.select("arm", "seed").distinct(), ["arm", "seed"], "left_anti")


def assert_complete(df: DataFrame, arms: list[str], seeds: list[int], allow_partial: bool = False) -> DataFrame:
    """``df``, refused at run time if a cell of the grid is missing; ``allow_partial`` lets it pass, marked ``partial``."""
    gone = missing_cells(df, arms, seeds)
    if allow_partial:
        n = gone.agg((F.count(F.lit(1)) > 0).alias("partial"))  # one row
        return df.crossJoin(F.broadcast(n))
    return gated(df, gone, "missing (arm, seed) cells", ["arm", "seed"])


def merge_faults(a: DataFrame, b: DataFrame, ids: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(fault, by..., key): keys in both sets, keys that the id list lacks, and listed keys that neither set has.

    The sets must be disjoint, and their union must be the id list, for each group of ``by``.
    """
    cols = [*by, key]
    both = a.select(*cols).unionByName(b.select(*cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    twice = both.filter("n > 1").select(F.lit("repeated").alias("fault"), *cols)
    extra = both.join(ids.select(key), key, "left_anti").select(F.lit("unlisted").alias("fault"), *cols)
    groups = both.select(*by).distinct()
    absent = groups.crossJoin(ids.select(key)).join(both.select(*cols), cols, "left_anti") if by else ids.select(key).join(both, key, "left_anti")
    return twice.unionByName(extra).unionByName(absent.select(F.lit("missing").alias("fault"), *cols))


def merge_sets(a: DataFrame, b: DataFrame, ids: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Union of two sets, refused while ``merge_faults`` finds any."""
    return gated(a.unionByName(b), merge_faults(a, b, ids, key, by), "sets that cannot be merged", ["fault", *by, key])


def recomputed(counts: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """Aggregates of a set from its chunks: sums first, then ratios with max(1, .) guards."""
    g = counts.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n_gt").alias("n_gt"), F.count(F.lit(1)).alias("n_chunks"))
    p = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1), F.col("n_gt"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return g.select(*by, "tp", "fp", "n_gt", "n_chunks", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def aggregate_faults(stored: DataFrame, counts: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """(by..., field, stored, recomputed) of every stored aggregate that its chunks do not give."""
    fields = [c for c in ("tp", "fp", "n_gt", "n_chunks", "precision", "recall", "f1") if c in stored.columns]
    long = lambda d, name: d.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias(name)) for c in fields])))
    j = long(stored, "stored").join(long(recomputed(counts, by, digits), "recomputed"), [*by, "field"], "full")
    return j.filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


def arm_parity(a: DataFrame, b: DataFrame, pos: str, same: list[str], payload: str) -> DataFrame:
    """One row: rows of each side and how many positions differ in each column of ``same``, or agree in the payload."""
    x = a.select(pos, *[F.col(c).alias(f"a_{c}") for c in [*same, payload]], F.lit(1).alias("__a"))
    y = b.select(pos, *[F.col(c).alias(f"b_{c}") for c in [*same, payload]], F.lit(1).alias("__b"))
    j = x.join(y, pos, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    diff = [F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"diff_{c}") for c in same]
    return j.agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), *diff, F.count_if(both & F.col(f"a_{payload}").eqNullSafe(F.col(f"b_{payload}"))).alias("same_payload"))


def rebuild(meta: DataFrame, key: str, a: DataFrame, b: DataFrame, error: str = "error") -> DataFrame:
    """(key, status): ok, error where either source reports one, missing where either has no row."""
    side = lambda d, n: d.select(key, F.lit(True).alias(f"__{n}"), F.col(error).isNotNull().alias(f"__e{n}"))
    j = meta.join(side(a, "a"), key, "left").join(side(b, "b"), key, "left")
    gone = F.col("__a").isNull() | F.col("__b").isNull()
    return j.select(*meta.columns, F.when(gone, "missing").when(F.col("__ea") | F.col("__eb"), "error").otherwise("ok").alias("status"))


def rebuild_from_frozen(frozen: DataFrame, payload: DataFrame, key: str, pos: str) -> DataFrame:
    """The frozen rows in their order with a new payload; refused if a frozen id has none."""
    lost = frozen.join(payload, key, "left_anti").select(key)
    return gated(frozen.join(payload, key), lost, "frozen ids without a payload", [key])


def attach_by_time(events: DataFrame, texts: DataFrame, keys: list[str], t: str, digits: int = 2) -> DataFrame:
    """Events with the text of the same keys and rounded time, half to even as decimal text reads it; first text wins."""
    at = F.bround(F.col(t), digits)
    first = texts.withColumn("__t", at).groupBy(*keys, "__t").agg(F.min_by("text", F.struct(t, "text")).alias("text"))
    return events.withColumn("__t", at).join(first, [*keys, "__t"], "left").drop("__t")
