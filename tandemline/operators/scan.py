"""Ordered operators that never put a whole group into one task.

A window over ``partitionBy(key)`` sends every row of a hot key to one task.  Here each key is cut
into buckets along its order (time span, uniform key range or value range): a window runs inside a
bucket, one summary row per bucket is scanned over the key, and the carry is joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_SUM_LIKE = {"sum", "count"}


def _cols(names):
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _local(kind: str, col: Column) -> Column:
    return {
        "sum": F.sum,
        "count": F.count,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }[kind](col)


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    outputs: dict[str, tuple[str, Column | str]],
    inclusive: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Running aggregates of each row's predecessors (or of its successors with ``reverse``).

    ``outputs`` maps a new column to (kind, column), kind one of sum, count, max, min, last
    (last non-null).  ``order`` must be total inside a key for "last" to be deterministic.
    """
    src = df.withColumn("__b", bucket.cast("long"))
    named = {n: (k, F.col(c) if isinstance(c, str) else c) for n, (k, c) in outputs.items()}
    src = src.select("*", *[c.alias(f"__v_{n}") for n, (_, c) in named.items()])

    end = 0 if inclusive else -1
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    w = Window.partitionBy(*keys, "__b").orderBy(*sort).rowsBetween(Window.unboundedPreceding, end)
    local = src.select("*", *[_local(k, F.col(f"__v_{n}")).over(w).alias(f"__l_{n}") for n, (k, _) in named.items()])

    aggs = []
    for n, (k, _) in named.items():
        v = F.col(f"__v_{n}")
        if k == "last":
            pick = F.min_by if reverse else F.max_by
            aggs.append(pick(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__s_{n}"))
        else:
            aggs.append(_local(k, v).alias(f"__s_{n}"))
    bsort = F.col("__b").desc() if reverse else F.col("__b").asc()
    wb = Window.partitionBy(*keys).orderBy(bsort).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        src.groupBy(*keys, "__b")
        .agg(*aggs)
        .select(
            *keys,
            "__b",
            *[
                _local("sum" if k in _SUM_LIKE else k, F.col(f"__s_{n}")).over(wb).alias(f"__c_{n}")
                for n, (k, _) in named.items()
            ],
        )
    )
    out = local.join(carry, [*keys, "__b"], "left")

    def combine(n, k):
        loc, car = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if k in _SUM_LIKE:
            return F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        if k == "max":
            return F.when(loc.isNull() | (car > loc), car).otherwise(loc)
        if k == "min":
            return F.when(loc.isNull() | (car < loc), car).otherwise(loc)
        return F.coalesce(loc, car)

    return out.select(*[F.col(c) for c in df.columns], *[combine(n, k).alias(n) for n, (k, _) in named.items()])


def uniform_bucket(col: str, buckets: int) -> Column:
    """Bucket of a value that is uniform on [0, 1)."""
    return F.floor(F.col(col) * buckets)


def uniform_rank(df: DataFrame, by: list[str], rand: str, tie: list[str], name: str = "rn", buckets: int = 64) -> DataFrame:
    """row_number() over (partition by ``by`` order by ``rand``, ``tie``) for a uniform ``rand`` on [0, 1)."""
    return running(
        df, by, uniform_bucket(rand, buckets), [rand, *tie], {name: ("count", F.lit(1))}, inclusive=True
    )


def sized_rank(df: DataFrame, by: list[str], rand: str, tie: list[str], size: str, name: str = "rn", per: int = 4096) -> DataFrame:
    """row_number() over (partition by ``by`` order by ``rand``, ``tie``) for a uniform ``rand`` on [0, 1).

    ``size`` is the group's row count: a group is cut into so many buckets that each holds about ``per`` rows. Only groups
    with several buckets need their counts carried from bucket to bucket.
    """
    d = df.withColumn("__nb", F.ceil(F.col(size) / per)).withColumn("__b", F.floor(F.col(rand) * F.col("__nb")))
    w = Window.partitionBy(*by, "__b").orderBy(rand, *tie)
    local = d.withColumn(name, F.row_number().over(w).cast("long"))
    below = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        d.filter("__nb > 1").groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
        .select(*by, "__b", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__c"))
    )
    out = local.join(carry, [*by, "__b"], "left").withColumn(name, F.col(name) + F.coalesce("__c", F.lit(0)))
    return out.select(*df.columns, name)


def dense_index(df: DataFrame, key: list[str], rand: Column, name: str = "idx", buckets: int = 64) -> DataFrame:
    """Positions 0..n-1 in the order of a keyed random number, without a global sort in one task."""
    ranked = uniform_rank(df.withColumn("__u", rand), [], "__u", key, name, buckets)
    return ranked.withColumn(name, F.col(name) - 1).drop("__u")


def n_parts(spark: SparkSession) -> int:
    """Partitions or buckets into which large rows are dealt."""
    return min(4096, max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def value_cuts(df: DataFrame, col: str, buckets: int | None = None) -> list[float]:
    """Cut points of a numeric column with about equal row counts between them; a value that repeats much comes twice.

    The cut points are a fixed number of quantiles read once to the driver and then constant in the
    plan, so a lost executor recomputes the same buckets.  They affect balance only, never results.
    """
    n = buckets or n_parts(df.sparkSession)
    return sorted(df.approxQuantile(col, [i / n for i in range(1, n)], 0.25 / n))


def in_cells(df: DataFrame, col: str, cuts: list[float], name: str) -> DataFrame:
    """Add the monotone cell of a numeric column among ``cuts``; NaN comes last."""
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=name, handleInvalid="keep").transform(df)


def value_bucket(df: DataFrame, col: str, name: str = "__vb", buckets: int | None = None) -> DataFrame:
    """Add a monotone bucket of a numeric column with about equal row counts."""
    return in_cells(df, col, value_cuts(df, col, buckets), name)


def ranked_values(df: DataFrame, by: list[str], col: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (by, value) with ``sums`` and their running totals below that value (``name_below``)."""
    pre = (
        df.filter(F.col(col).isNotNull())
        .groupBy(*by, F.col(col).cast("double").alias(col))
        .agg(*[c.alias(n) for n, c in sums.items()])
    )
    b = value_bucket(pre, col)
    return running(b, by, F.col("__vb"), [col], {f"{n}_below": ("sum", n) for n in sums}).drop("__vb")


def exact_quantiles(df: DataFrame, by: list[str], col: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one row per group."""
    pre = ranked_values(df, by, col, {"__n": F.count(F.lit(1))})
    totals = df.filter(F.col(col).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("__tot"))
    j = pre.join(totals, by, "inner") if by else pre.crossJoin(F.broadcast(totals))
    at = lambda pos: F.max(F.when((F.col("__n_below") <= pos) & (pos < F.col("__n_below") + F.col("__n")), F.col(col)))
    exprs = []
    for name, q in qs.items():
        pos = (F.col("__tot") - 1) * F.lit(float(q))
        exprs += [
            at(F.floor(pos)).alias(f"{name}__lo"),
            at(F.ceil(pos)).alias(f"{name}__hi"),
            F.max(pos - F.floor(pos)).alias(f"{name}__fr"),
        ]
    out = j.groupBy(*by).agg(*exprs)
    return out.select(
        *by,
        *[
            (F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__fr")).alias(n)
            for n in qs
        ],
    )


def average_rank(df: DataFrame, col: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Add the 1-based average rank of a value (ties share their mean rank)."""
    by = by or []
    r = ranked_values(df, by, col, {"__n": F.count(F.lit(1))}).select(
        *by, F.col(col), (F.col("__n_below") + (F.col("__n") + 1) / 2).alias(name)
    )
    return df.withColumn(col, F.col(col).cast("double")).join(r, [*by, col], "left")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
