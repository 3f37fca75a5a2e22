"""Mixing sources to target weights by hash thresholds found in nested histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash_bits, saved, small

WEIGHTS = (5, 2, 1)
DIGITS, STEP = 15, 12  # hash of 60 bits, refined 12 bits at a time


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point from 0, null last, with one small count per range partition."""
    parts = saved(sources.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source")
                  .withColumn("part", F.spark_partition_id()))
    per_part = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("none", "source"))
    return parts.join(F.broadcast(before), "part").withColumn("pos", F.col("before") + inside - 1)  # a row for each partition


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Weights repeat over the sources in code point order, null last. The targets share ``share`` times all sizes by
    weight; one that would exceed ``most`` times its source is held there and the excess shared again by weight, until
    none is above. Only four sums a round reach the driver.
    """
    half = round(2 * share)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    table = saved(_ranked(totals).select("source", "source_size", weight.cast("long").alias("w")))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total = table.agg(F.sum(exact("source_size"))).first()[0] or 0
    held, top, down = -1, half * int(total), 2
    while True:  # level = top / down; a source is held where w * level > most * size
        at = exact("w") * F.lit(top).cast("decimal(38,0)") > exact("source_size") * F.lit(most * down).cast("decimal(38,0)")
        now, size, rest = table.agg(
            F.count_if(at), F.sum(F.when(at, exact("source_size"))), F.sum(F.when(~at, F.col("w")))
        ).first() if held >= 0 else (0, 0, table.agg(F.sum("w")).first()[0])
        if now == held:
            break
        held, top, down = now, half * int(total) - 2 * most * int(size or 0), 2 * int(rest or 1)
    free = F.col("w") * F.lit(float(top)) / F.lit(float(down))
    return saved(table.select("source", "source_size", F.when(at, F.col("source_size") * float(most)).otherwise(free).alias("target")))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, whole, cut): rows are taken ``whole`` times, and once more where their hash is below ``cut``.

    Each round sums sizes by the next bits of the hash inside the boundary bucket of every source, at most 4096 sums a
    source, until the boundary bucket holds a single hash.
    """
    top = 4 * DIGITS
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    open_ = saved(targets.select("source", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("at")))
    done, depth = None, 0
    while depth < top and not open_.isEmpty():
        depth += STEP
        inside = rows.join(small(open_).alias("o"), rows["source"].eqNullSafe(F.col("o.source")) & (F.shiftright("h", top - depth + STEP) == F.col("at"))).drop(F.col("o.source"))
        sums = inside.groupBy("source", "whole", "budget", F.shiftright("h", top - depth).alias("b")).agg(
            F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("b"))
        over = sums.withColumn("run", run).where(F.col("run") > F.col("budget"))
        edge = over.groupBy("source", "whole", "budget").agg(F.min(F.struct("b", "run", "n", "low", "high")).alias("e"))
        step = saved(open_.alias("o").join(edge.alias("x"), F.col("o.source").eqNullSafe(F.col("x.source")), "left").select(
            "o.source", "o.whole", (F.col("o.budget") - F.col("e.run") + F.col("e.n")).alias("budget"), F.col("e.b").alias("at"),
            F.when(F.col("e.b").isNull(), F.lit(1 << top)).when((F.col("e.low") == F.col("e.high")) | F.lit(depth == top), F.col("e.low")).alias("cut")))
        ended = step.where(F.col("cut").isNotNull()).select("source", "whole", "cut")
        done = ended if done is None else done.union(ended)
        open_ = step.where(F.col("cut").isNull()).drop("cut")
    return saved(done) if done is not None else open_.select("source", "whole", F.lit(0).cast("long").alias("cut"))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS) -> DataFrame:
    """(doc_id, th, size, source_size, target, times): how often the mix takes each document.

    Size is the number of words, null text 0. Which documents come in depends on a hash of the id alone (of the text
    where the id is null), so reruns and other partitionings agree; rows with the same id come in together. A source
    without words has the target 0; its documents are taken as often as its target says, which is 0 times. An empty
    table gives an empty result. Taken words stay at or below the target by less than the documents at the boundary.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text")), F.lit(""))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = saved(docs.select("doc_id", F.xxhash64("text").alias("th"), "source", size.alias("size"), hash_bits(key, DIGITS).alias("h")))
    targets = source_targets(rows, share, most, weights)
    cuts = _thresholds(rows, targets)
    per = targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select("t.*", "whole", "cut")
    per = saved(per.withColumnRenamed("source", "src"))
    times = F.col("whole") + (F.col("h") < F.col("cut")).cast("long")
    return rows.join(small(per), rows["source"].eqNullSafe(per["src"])).select("doc_id", "th", "size", "source_size", "target", times.alias("times"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken; columns as given."""
    times = mix(docs).where("times > 0").groupBy("doc_id", "th").agg(F.max("times").alias("times"))
    times = saved(times.withColumnsRenamed({"doc_id": "__id", "th": "__th", "times": "__times"}))
    joined = docs.join(times, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).select(docs.columns)
