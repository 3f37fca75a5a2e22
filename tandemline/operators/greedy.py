"""Greedy one-to-one matching in time order, spread over blocks of a key.

Each item in turn takes the best candidate that no earlier item took, so the rule runs along the whole key. Here a key's
items are cut into blocks of ``per`` rows in their order, and every block is folded on its own over the candidates in its
reach. What earlier blocks took comes in as a set of used candidates, at first empty; a round passes on what was taken and
folds again only the blocks whose set changed. Block 1 is right after the first round and block k once those before it are,
so the state that no longer changes is the greedy match itself. Blocks meet only in the candidates that lie across a cut,
which is why a few rounds suffice; a chain of conflicts from cut to cut takes a round for each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .intervals import interval_join
from .scan import running

#: (start and end of an item, starts and ends of the candidates, which are free) -> position or -1
Rule = Callable[[float, float, np.ndarray, np.ndarray, np.ndarray], int]


def cover_rule(share: float) -> Rule:
    """Free candidate that holds the largest part of the item, first on ties, if that is at least ``share``."""

    def pick(s: float, e: float, cs: np.ndarray, ce: np.ndarray, free: np.ndarray) -> int:
        if e <= s:
            return -1
        part = np.where(free, np.maximum(0.0, np.minimum(e, ce) - np.maximum(s, cs)) / (e - s), -1.0)
        at = int(part.argmax())
        return at if part[at] >= share else -1

    return pick


def collar_rule(collar: float) -> Rule:
    """Nearest free candidate within the collar, first on ties; items and candidates are points."""

    def pick(s: float, e: float, cs: np.ndarray, ce: np.ndarray, free: np.ndarray) -> int:
        far = np.where(free & (cs >= s - collar) & (cs <= s + collar), np.abs(cs - s), np.inf)
        at = int(far.argmin())
        return at if np.isfinite(far[at]) else -1

    return pick


def _folded(rule: Rule) -> Callable[..., Column]:
    """Positions (1-based, 0 for none) that the items of a block take."""

    @F.pandas_udf("array<int>")
    def fold(xs: pd.Series, xe: pd.Series, ys: pd.Series, ye: pd.Series, used: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d, gone in zip(xs, xe, ys, ye, used):
            free = np.ones(len(c), dtype=bool)
            free[np.asarray(gone, dtype=int) - 1] = False
            took = np.zeros(len(a), dtype=np.int32)
            for i, (s, e) in enumerate(zip(a, b)):
                at = rule(s, e, c, d, free) if len(c) else -1
                if at >= 0:
                    free[at], took[i] = False, at + 1
            out.append(took)
        return pd.Series(out)

    return fold


def _blocks(items: DataFrame, cands: DataFrame, keys: list[str], reach: float, width: float, per: int) -> DataFrame:
    """One row a block: items and candidates in reach as arrays in the order (s, e, id)."""
    r = running(items, keys, F.floor(F.col("s") / width), ["s", "e", "id"], {"__n": ("count", F.lit(1))})
    rows = lambda: F.array_sort(F.collect_list(F.struct("s", "e", "id")))
    x = r.groupBy(*keys, F.floor(F.col("__n") / per).alias("block")).agg(rows().alias("x"), F.min("s").alias("lo"), F.max("e").alias("hi"))
    span = x.select(*keys, "block", (F.col("lo") - reach).alias("a_s"), (F.col("hi") + reach).alias("a_e"))
    c = cands.select(*keys, "s", "e", "id", F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    y = interval_join(span, c, keys, width).groupBy(*keys, "block").agg(rows().alias("y"))
    j = x.join(y, [*keys, "block"], "left")
    # candidates may name their ids by another type than items do
    none = lambda c: F.coalesce(F.col(f"y.{c}"), F.array().cast(f"array<{cands.schema[c].dataType.simpleString()}>"))
    return j.select(*keys, "block", *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("s", "e", "id")], *[none(c).alias(f"y_{c}") for c in ("s", "e", "id")])


def greedy_match(items: DataFrame, cands: DataFrame, keys: list[str], rule: Rule, reach: float, width: float, per: int = 512) -> DataFrame:
    """(keys, block, x_s, x_e, x_id, y_s, y_e, y_id, took): ``took`` holds the position in y that each item of x takes, or 0.

    Both sides have keys, id, s, e; ids are unique inside a key. Rows with a null key, start or end take no part. A task
    holds ``per`` items and the candidates that touch their span, never a whole key or island. ``width`` is the time bucket
    of the joins.
    """
    known = lambda df: df.select(*keys, "id", "s", "e").dropna(subset=[*keys, "s", "e"])
    fold = _folded(rule)
    blocks = cut_lineage(_blocks(known(items), known(cands), keys, reach, width, per))
    at = [*keys, "block"]
    seen = blocks.select(*at, F.posexplode("y_id").alias("pos", "id")).withColumn("pos", F.col("pos") + 1)
    several = seen.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, "id")
    shared = cut_lineage(seen.join(several, [*keys, "id"]))  # candidates across a cut
    empty = F.array().cast("array<int>")
    match = lambda df: df.withColumn("took", fold("x_s", "x_e", "y_s", "y_e", "used"))
    state = cut_lineage(match(blocks.withColumn("used", empty)))
    while True:
        took = state.select(*at, F.explode("took").alias("pos")).filter("pos > 0").join(shared, [*at, "pos"])
        first = took.groupBy(*keys, "id").agg(F.min("block").alias("__first"))
        used = shared.join(first, [*keys, "id"]).filter("__first < block").groupBy(*at).agg(F.sort_array(F.collect_list("pos")).alias("__used"))
        nxt = state.join(used, at, "left").withColumn("__used", F.coalesce("__used", empty))
        changed = nxt.filter(F.col("__used") != F.col("used")).drop("used", "took").withColumnRenamed("__used", "used")
        again = cut_lineage(match(changed))
        if again.isEmpty():
            return state.drop("used")
        kept = nxt.filter(F.col("__used") == F.col("used")).select(*state.columns)
        state = cut_lineage(kept.unionByName(again.select(*state.columns)))
