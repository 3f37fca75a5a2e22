"""Votes per slot: permutation inside a dialogue, and the noise floor of small samples."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keyed import u
from .scan import n_parts, sized_rank

#: Votes of a slot that are drawn together; a larger slot is drawn in parts, as (1 - p)^m would vanish.
DRAW = 512

#: Votes of a dialogue that is shuffled inside its task; the votes of a larger one are ranked by shuffles.
WHOLE = 1024


def single_votes(slots: DataFrame, cats: list[str]) -> DataFrame:
    """(dialogue, slot, m, j, cat, n): every vote of every slot with its category's name; n votes in the dialogue."""
    m = sum((F.col(c) for c in cats[1:]), F.col(cats[0]))
    sizes = slots.groupBy("dialogue").agg(F.sum(m).alias("n"))
    kinds = F.flatten(F.array(*[F.array_repeat(F.lit(c), F.col(c).cast("int")) for c in cats]))
    v = slots.select("dialogue", "slot", m.alias("m"), F.posexplode(kinds).alias("j", "cat"))
    return v.join(sizes, "dialogue")


def permuted_votes(slots: DataFrame, cats: list[str], reps: int, seed: int) -> DataFrame:
    """(rep, dialogue, slot, m, cat, c): votes of a category in each slot after the votes of its dialogue are shuffled.

    A slot keeps its size and a dialogue its votes of each category; slots without a vote of a category have no row. Votes
    get places 1..n of their dialogue by one keyed order, and again by one for each replicate: a vote moves into the slot
    that holds the place of its rank. Ranks and the join on (dialogue, place) never gather a dialogue in one task.
    """
    v = single_votes(slots, cats)
    places = sized_rank(v.withColumn("__u", u("place", "slot", "j")), ["dialogue"], "__u", ["slot", "j"], "n", "place").select("dialogue", "place", "slot", "m")
    drawn = v.select("dialogue", "slot", "j", "cat", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    drawn = drawn.withColumn("__u", u(seed, "rep", "slot", "j"))
    ranks = sized_rank(drawn, ["rep", "dialogue"], "__u", ["slot", "j"], "n", "place").select("rep", "dialogue", "place", "cat")
    return ranks.join(places, ["dialogue", "place"]).groupBy("rep", "dialogue", "slot", "m", "cat").agg(F.count(F.lit(1)).alias("c"))


def _in_task(n_cats: int, reps: int, seed, at_once: int = 100_000):
    """Shuffles whole dialogues, a row each with its slots and their votes of each category, and sums c^2 / m."""

    def drawn(prefix: str, votes: list[bytes]) -> np.ndarray:
        head = f"{prefix}|".encode()
        return np.frombuffer(b"".join([hashlib.md5(head + v).digest() for v in votes]), ">u8")[::2] >> 12  # as ``u``

    def run(batches):
        q = np.zeros((reps, n_cats))
        for batch in batches:
            size, ends = batch.column("n").to_numpy(), np.cumsum(batch.column("k").to_numpy())
            names = batch.column("slot").flatten().to_pylist()
            votes = np.stack([batch.column(f"c{i}").flatten().to_numpy() for i in range(n_cats)], 1)
            part = (np.cumsum(size) - size) // at_once
            for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1) if len(size) else []:
                lo, hi = ends[rows[0] - 1] if rows[0] else 0, ends[rows[-1]]
                c = votes[lo:hi]
                m = c.sum(1)
                slot, cat = np.repeat(np.arange(hi - lo), m), np.repeat(np.tile(np.arange(n_cats), hi - lo), c.ravel())
                j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                ids = [f"{names[lo + s]}|{i}".encode() for s, i in zip(slot.tolist(), j.tolist())]
                d = np.repeat(np.arange(len(rows)), size[rows])
                place = slot[np.lexsort((drawn("place", ids), d))] * n_cats  # the sort is stable: ties by slot and vote
                for rep in range(reps):
                    moved = np.bincount(place + cat[np.lexsort((drawn(f"{seed}|{rep}", ids), d))], minlength=c.size).reshape(c.shape)
                    q[rep] += (moved * moved / m[:, None]).sum(0)
        r, k = np.divmod(np.arange(q.size), n_cats)
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(k), pa.array(q.ravel())], ["rep", "k", "q"])

    return run


def permuted_squares(slots: DataFrame, cats: list[str], reps: int, seed: int, whole: int = WHOLE) -> DataFrame:
    """(rep, cat, q): sum of c^2 / m over the slots after the votes of each dialogue are shuffled as by ``permuted_votes``.

    A dialogue of at most ``whole`` votes is one row and is shuffled in its task for all replicates, so no row is written
    for a replicate and vote. Larger dialogues go through the ranks of ``permuted_votes``.
    """
    m = sum((F.col(c) for c in cats[1:]), F.col(cats[0]))
    s = slots.select("dialogue", "slot", *cats).filter(m > 0)
    sizes = s.groupBy("dialogue").agg(F.sum(m).alias("n"))
    rows = s.join(sizes.filter(F.col("n") <= whole), "dialogue").groupBy("dialogue", "n").agg(F.array_sort(F.collect_list(F.struct("slot", *cats))).alias("x"))
    rows = rows.repartition(n_parts(slots.sparkSession), "dialogue")  # little to read and much to do
    rows = rows.select("n", F.size("x").cast("long").alias("k"), F.col("x.slot").cast("array<string>").alias("slot"), *[F.col(f"x.{c}").cast("array<bigint>").alias(f"c{i}") for i, c in enumerate(cats)])
    names = F.array(*[F.lit(c) for c in cats])
    small = rows.mapInArrow(_in_task(len(cats), reps, seed), "rep long, k long, q double").select("rep", F.get(names, F.col("k").cast("int")).alias("cat"), "q")
    large = permuted_votes(s.join(sizes.filter(F.col("n") > whole).select("dialogue"), "dialogue"), cats, reps, seed)
    large = large.groupBy("rep", "cat").agg(F.sum(F.col("c") * F.col("c") / F.col("m")).alias("q"))
    return small.unionByName(large).groupBy("rep", "cat").agg(F.sum("q").alias("q"))


def _dispersion(squares: Column, c: Column, m: Column, n: Column) -> Column:
    """Mean of (c - m p)^2 / (m p (1 - p)) over n slots from the sum of c^2 / m, with p = c / m from the totals."""
    p = c / m
    return F.when((p > 0) & (p < 1), (squares - 2 * p * c + p * p * m) / (n * p * (1 - p)))


def permutation_test(slots: DataFrame, cats: list[str], reps: int, seed: int) -> DataFrame:
    """One row per category: dispersion of its votes over slots against its values under permutation inside dialogues.

    The excess over 1 is split into what dialogues explain (null mean - 1) and what only slots do. Null where a category
    has no votes or all of them.
    """
    m = sum((F.col(c) for c in cats[1:]), F.col(cats[0]))
    s = slots.withColumn("__m", m).filter("__m > 0")
    total = s.select(
        "dialogue", "__m", F.inline(F.array(*[F.struct(F.lit(c).alias("cat"), F.col(c).alias("c")) for c in cats]))
    ).groupBy("cat").agg(
        F.count(F.lit(1)).alias("n_slots"), F.countDistinct("dialogue").alias("n_dialogues"), F.sum("c").alias("c"), F.sum("__m").alias("m"),
        F.sum(F.col("c") * F.col("c") / F.col("__m")).alias("__s"),
    )
    total = total.withColumn("observed", _dispersion(F.col("__s"), F.col("c"), F.col("m"), F.col("n_slots")))
    moved = permuted_squares(s, cats, reps, seed).withColumnRenamed("q", "__q")
    null = moved.join(F.broadcast(total), "cat")  # a row per category
    null = null.withColumn("s", _dispersion(F.col("__q"), F.col("c"), F.col("m"), F.col("n_slots")))
    g = null.groupBy("cat").agg(
        F.avg("s").alias("null_mean"), F.percentile("s", 0.025).alias("null_lo"), F.percentile("s", 0.975).alias("null_hi"),
        ((F.count_if(F.col("s") >= F.col("observed") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )
    return total.join(g, "cat", "left").select(
        "cat", "n_slots", "n_dialogues", (F.col("c") / F.col("m")).alias("rate"), "observed", "null_mean", "null_lo", "null_hi",
        F.when(F.col("observed").isNotNull(), F.col("p_value")).alias("p_value"), (F.col("observed") - 1).alias("excess"),
        (F.col("null_mean") - 1).alias("excess_dialogue"), (F.col("observed") - F.col("null_mean")).alias("excess_slot"),
    )


def binomial(m: Column, p: Column, draw: Column) -> Column:
    """Inverse of the binomial distribution function at ``draw``: how many of 0..m-1 have a cumulative chance up to it."""
    def step(a, k):
        more = a.pmf * (m - k) / (k + 1) * a.odds
        return F.struct(
            (a.cum + more).alias("cum"), more.alias("pmf"), (a.c + F.when(a.draw >= a.cum, 1).otherwise(0)).alias("c"), a.odds.alias("odds"), a.draw.alias("draw"))

    first = F.pow(1 - p, m)  # odds and draw are in the state, as they would be evaluated in each step otherwise
    start = F.struct(first.alias("cum"), first.alias("pmf"), F.lit(0).alias("c"), (p / (1 - p)).alias("odds"), draw.alias("draw"))
    steps = F.when(m > 0, F.sequence(F.lit(0).cast("long"), m - 1)).otherwise(F.array().cast("array<bigint>"))
    count = F.aggregate(steps, start, step, lambda a: a.c).cast("long")
    return F.when(p <= 0, 0).when(p >= 1, m).otherwise(count).cast("long")


def redrawn(slots: DataFrame, cats: list[str], reps: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(rep, slot, m, cats..., by..., r_cats...): each slot's votes drawn anew from its own shares.

    The categories are drawn one after another as binomial counts of what is left, so votes are never written out. A slot
    is one row of the input; one drawn in a single part is not shuffled, only the parts of larger ones are summed.
    """
    m = sum((F.col(c) for c in cats[1:]), F.col(cats[0]))
    keys = ["rep", "slot", "m", *cats, *[c for c in by or [] if c not in ("slot", "m", *cats)]]
    d = slots.select("slot", m.alias("m"), *cats, *keys[3 + len(cats):]).filter("m > 0").repartition(n_parts(slots.sparkSession), "slot")  # few rows and many draws
    each = lambda d, part: _redraw(d.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long")))).withColumn("part", part), cats, seed)
    one = each(d.filter(F.col("m") <= DRAW), F.lit(0).cast("long")).select(*keys, *[f"r_{c}" for c in cats])
    many = each(d.filter(F.col("m") > DRAW), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / DRAW))))
    return one.unionByName(many.groupBy(*keys).agg(*[F.sum(f"r_{c}").alias(f"r_{c}") for c in cats]))


def _redraw(d: DataFrame, cats: list[str], seed: int) -> DataFrame:
    """Adds r_cats, the votes drawn in (rep, slot, part)."""
    d = d.withColumn("__left", F.least(F.lit(DRAW).cast("long"), F.col("m") - F.col("part") * DRAW)).withColumn("__rest", F.col("m"))
    for k, c in enumerate(cats[:-1]):
        d = d.withColumn(f"r_{c}", binomial(F.col("__left"), F.when(F.col("__rest") > 0, F.col(c) / F.col("__rest")).otherwise(0.0), u(seed, "rep", "slot", "part", F.lit(k))))
        d = d.withColumn("__left", F.col("__left") - F.col(f"r_{c}")).withColumn("__rest", F.col("__rest") - F.col(c))
    return d.withColumn(f"r_{cats[-1]}", F.col("__left"))


def noise_floor(slots: DataFrame, cats: list[str], reps: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Mean and SD over replicates of the mean KL(redrawn votes || own shares): what a perfect model could not go below.

    A slot whose votes agree, as one of a single vote does, adds zero.
    """
    by = by or []
    d = redrawn(slots, cats, reps, seed, by)
    h = lambda c: F.col(f"r_{c}") / F.col("m")
    terms = [F.when(F.col(f"r_{c}") > 0, h(c) * F.log(h(c) / (F.col(c) / F.col("m")))).otherwise(0.0) for c in cats]
    mean = d.groupBy(*by, "rep").agg(F.avg(sum(terms[1:], terms[0])).alias("kl"), F.count(F.lit(1)).alias("n_slots"))
    return mean.groupBy(*by).agg(F.max("n_slots").alias("n_slots"), F.count(F.lit(1)).alias("reps"), F.avg("kl").alias("mean_kl"), F.stddev_samp("kl").alias("sd_kl"))
