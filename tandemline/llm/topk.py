"""Exact top-k inner products by a three-phase uniform threshold over slices of the dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SLICES = 2
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(c, vec, ids): distinct vectors, named by their smallest id, with their ``keep`` smallest ids.

    Of equal vectors no more than the smallest ids can be among a query's best, so the rest need not be carried; both
    windows cut before they gather, the first inside salted parts.
    """
    salted = Window.partitionBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    first = vectors.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= keep).drop("n")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= keep)
    return first.groupBy("vec").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _lists(queries: DataFrame, rows: DataFrame, task) -> DataFrame:
    """Run ``task(query side, row side)`` for each block of queries, block of rows and slice."""
    queries = queries.toDF(*queries.columns)  # columns of its own, as both sides stem from one table
    return queries.groupBy("qb", "rb", "s").cogroup(rows.groupBy("qb", "rb", "s")).applyInPandas(task, "q long, c long, s int, part long")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point only while every sum is below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its ``k`` largest integer inner products with other rows.

    ``vectors`` is (vec_id, vec: array<long>), ``queries`` (query_id) names the rows to search for. Ties go to the
    smaller id, a query never finds itself, fewer than ``k`` other rows are all returned. Vectors are compared with those
    of their own length only; ids must be unique. Scores must fit into 64 bits.

    The dimensions are cut into slices, each a list of partial scores. Phase 1: every list names its best entries for
    each query, their exact scores are summed up, and the k-th largest is a lower bound. Phase 2: a row that reaches the
    bound reaches its share of it in at least one list, so the lists send all entries at or above that share. Phase 3:
    the other lists are asked for what is missing, and the exact scores are ranked. The sets of queries and of rows are
    met in blocks, so no task holds more than two blocks.
    """
    keep = k + 1  # one of them may be the query itself
    known = _classes(vectors, keep)
    known = saved(known)
    of_query = saved(queries.join(vectors, F.col("query_id") == F.col("vec_id")).join(known, "vec").select("query_id", "c"))
    dims = F.size("vec")
    n_rows, n_queries = known.count(), of_query.select("c").distinct().count()
    block = lambda n, size: F.pmod(F.xxhash64("c"), F.lit(max(1, -(-n // size)))).cast("int")
    cut = F.floor(dims * F.col("s") / SLICES).cast("int")
    end = F.floor(dims * (F.col("s") + 1) / SLICES).cast("int")
    sliced = known.withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(SLICES)])))
    sliced = sliced.select("c", "s", dims.alias("d"), F.slice("vec", cut + 1, end - cut).alias("part"))
    all_blocks = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // size)) - 1)))
    row_side = sliced.select("c", "s", "d", "part", block(n_rows, ROW_BLOCK).alias("rb"), all_blocks(n_queries, QUERY_BLOCK).alias("qb"))
    asked = of_query.select("c").distinct()
    query_side = sliced.join(asked, "c", "left_semi").select("c", "s", "d", "part", block(n_queries, QUERY_BLOCK).alias("qb"), all_blocks(n_rows, ROW_BLOCK).alias("rb"))

    def pairs(qs: pd.DataFrame, rs: pd.DataFrame):
        for d, q in qs.groupby("d"):
            r = rs[rs["d"] == d]
            if len(r):
                yield q, r, _products(_matrix(q["part"]), _matrix(r["part"]))

    none = pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "s": np.zeros(0, np.int32), "part": np.zeros(0, np.int64)})

    def local_best(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        out = [none]
        for q, r, p in pairs(qs, rs):
            m = min(keep, len(r))
            at = np.argpartition(-p, m - 1, axis=1)[:, :m]
            out.append(pd.DataFrame({"q": np.repeat(q["c"].to_numpy(), m), "c": r["c"].to_numpy()[at.reshape(-1)],
                                     "s": q["s"].iloc[0], "part": np.take_along_axis(p, at, 1).reshape(-1)}))
        return pd.concat(out)

    def at_least(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        out = [none]
        for q, r, p in pairs(qs, rs):
            i, j = np.nonzero(SLICES * p >= q["bound"].to_numpy()[:, None])
            out.append(pd.DataFrame({"q": q["c"].to_numpy()[i], "c": r["c"].to_numpy()[j], "s": q["s"].iloc[0], "part": p[i, j]}))
        return pd.concat(out)

    def asked_for(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        """Partial scores of named pairs: the query side has the pair's row in ``want``."""
        both = qs.merge(rs[["c", "part"]], left_on="want", right_on="c", suffixes=("", "_r"))
        if both.empty:
            return none
        part = np.fromiter((int(np.dot(np.asarray(a, np.int64), np.asarray(b, np.int64))) for a, b in zip(both["part"], both["part_r"])), np.int64, len(both))
        return pd.DataFrame({"q": both["c"], "c": both["want"], "s": both["s"], "part": part})

    def resolved(found: DataFrame) -> DataFrame:
        """(q, c, score) of all pairs in ``found`` (q, c, s, part): known parts are kept, missing ones asked for."""
        have = found.groupBy("q", "c").agg(F.sum("part").alias("sum"), F.collect_set("s").alias("have"))
        have = saved(have)
        missing = have.select("q", "c", F.explode(F.array_except(F.array(*[F.lit(i) for i in range(SLICES)]), "have")).alias("s"))
        home = F.pmod(F.xxhash64("want"), F.lit(max(1, -(-n_rows // ROW_BLOCK)))).cast("int")
        ask = sliced.join(missing.select(F.col("q").alias("c"), F.col("c").alias("want"), "s"), ["c", "s"])
        ask = ask.select("c", "want", "s", "part", F.lit(0).alias("qb"), home.alias("rb"))
        rows = sliced.select("c", "s", "part", block(n_rows, ROW_BLOCK).alias("rb"), F.lit(0).alias("qb"))
        got = _lists(ask, rows, asked_for).groupBy("q", "c").agg(F.sum("part").alias("more"))
        return have.join(got, ["q", "c"], "left").select("q", "c", (F.col("sum") + F.coalesce("more", F.lit(0))).alias("score"))

    best = lambda n: F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c")) <= n
    one = _lists(query_side, row_side, local_best)
    top_of_list = F.row_number().over(Window.partitionBy("q", "s").orderBy(F.desc("part"), "c"))
    one = one.withColumn("n", top_of_list).where(F.col("n") <= keep).drop("n")
    first = resolved(one).withColumn("b", best(keep)).where("b").groupBy("q").agg(F.min("score").alias("bound"), F.count("*").alias("n"))
    # fewer than k + 1 classes: every entry has to come
    least = saved(first.select(F.col("q").alias("c"), F.when(F.col("n") < keep, F.lit(-(1 << 62))).otherwise(F.col("bound")).alias("bound")))
    two = _lists(query_side.join(least, "c"), row_side, at_least)
    final = resolved(two).withColumn("b", best(keep)).where("b").select("q", "c", "score")
    ids = final.join(known.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    own = of_query.join(lists.withColumnRenamed("q", "c"), "c").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, vec) with each component as floor(scale * x); rows with a null or non-finite value are left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("vec"))
