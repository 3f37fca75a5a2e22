"""Structured Streaming twins of the batch rules; each equals its batch rule on bounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.matching import prf

#: Microseconds by which a session outlasts its words, so that a gap of exactly ``tau`` still joins.
TOUCH = 1


def chunk_counts(events: DataFrame, keys: list[str], ts: str, length: str, stride: str, late: str) -> DataFrame:
    """Sliding chunk counts; rows later than the watermark are dropped."""
    return (
        events.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, length, stride).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("start"), "n")
    )


def block_curve(events: DataFrame, keys: list[str], ts: str, value: str, block: str, late: str) -> DataFrame:
    """Tumbling block means."""
    return (
        events.withWatermark(ts, late).groupBy(*keys, F.window(ts, block).alias("w")).agg(F.avg(value).alias("v")).select(*keys, F.col("w.start").alias("start"), "v")
    )


def group_turns(words: DataFrame, keys: list[str], s: str, e: str, tau: float, late: str) -> DataFrame:
    """Turns of words (timestamps s, e): silence longer than ``tau`` seconds after the running end starts a new turn.

    Each word keeps its session open for its own length and ``tau``; late words merge while inside the watermark.
    """
    open_for = F.unix_micros(e) - F.unix_micros(s) + round(tau * 1_000_000) + TOUCH
    gap = F.concat(open_for.cast("string"), F.lit(" microseconds"))
    turns = words.withWatermark(s, late).groupBy(*keys, F.session_window(s, gap).alias("w"))
    return turns.agg(F.max(e).alias("end"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "end", "n")


def live_overlap(a: DataFrame, b: DataFrame, key: str, late: str, reach: str) -> DataFrame:
    """Overlaps of two channels; a: key, a_s, a_e; b: key, b_s, b_e (timestamps).

    ``reach`` is the greatest length of a row and bounds the state. Longer rows take no part; ``over_reach`` returns them,
    to be written to a side output and joined in batch.
    """
    span = F.expr(f"interval {reach}")
    left = a.filter(F.col("a_e") <= F.col("a_s") + span).withWatermark("a_s", late).alias("a")
    right = b.filter(F.col("b_e") <= F.col("b_s") + span).withWatermark("b_s", late).alias("b")
    on = (
        (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e"))
        & (F.col("b_s") >= F.col("a_s") - span) & (F.col("b_s") <= F.col("a_s") + span)
    )
    return left.join(right, on).select(F.col(f"a.{key}"), F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))


def over_reach(rows: DataFrame, s: str, e: str, reach: str) -> DataFrame:
    """The rows that ``live_overlap`` leaves to the side output."""
    return rows.filter(F.col(e) > F.col(s) + F.expr(f"interval {reach}"))


def running_prf(counts: DataFrame, by: list[str]) -> DataFrame:
    """Union-calibre scores that are corrected as counts arrive; write in update or complete mode."""
    return prf(counts, by)


def first_wins(events: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Drop repeats of a key inside the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
