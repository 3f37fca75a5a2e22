"""Stateful rules over frames in event-time order: runs, and what the speaker does after an onset."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def in_order(events: DataFrame, keys: list[str], ts: str, values: list[str], late: str, idle: float, step: Callable, flush: Callable, out: str) -> DataFrame:
    """Rows of each key in event-time order, fed to ``step(state, values) -> rows``; ``flush(state) -> rows`` ends a series.

    Rows wait in the state until the watermark has passed them, so rows that arrive late by less than ``late`` take their
    place; later ones are dropped. A series ends when it has been silent for more than ``idle`` seconds. The state of a key is
    what ``step`` keeps plus the rows of the last ``late``; a timer on the watermark wakes keys that get no more rows.
    """
    idle_ms = int(idle * 1000)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def work(key, frames, group):
        s = json.loads(group.get[0]) if group.exists else {"wait": [], "at": None, "own": {}}
        for pdf in frames:
            ms = pdf[ts].astype("datetime64[ms]").astype("int64")
            s["wait"] += [[int(m), *row] for m, row in zip(ms, pdf[values].astype(object).where(pdf[values].notna(), None).values.tolist())]
        mark, rows = group.getCurrentWatermarkMs(), []
        s["wait"].sort(key=lambda r: (r[0], str(r[1:])))
        ready = [r for r in s["wait"] if r[0] < mark]
        s["wait"] = s["wait"][len(ready):]
        for m, *row in ready:
            if s["at"] is not None and m - s["at"] > idle_ms:
                rows += flush(s["own"])
                s["own"] = {}
            rows += step(s["own"], row)
            s["at"] = m
        if not s["wait"] and s["at"] is not None and mark > s["at"] + idle_ms:
            rows += flush(s["own"])
            group.remove()
        else:
            group.update((json.dumps(s),))
            wake = s["wait"][0][0] + 1 if s["wait"] else s["at"] + idle_ms + 1
            group.setTimeoutTimestamp(max(wake, mark + 1))
        names = [c.split()[0] for c in out.split(",")]
        found = pd.DataFrame(rows, columns=names)
        for k, v in zip(reversed(keys), reversed(key)):
            found.insert(0, k, v)
        yield found

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + out
    return events.withWatermark(ts, late).groupBy(*keys).applyInPandasWithState(work, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _class(length: float) -> str:
    return "Int" if length > 0.5 else "Backchannel" if length > 0.1 else "None"


def runs(frames: DataFrame, keys: list[str], ts: str, late: str, idle: float, merge_gap: int = 2) -> DataFrame:
    """(keys..., s, e, cls): runs of frames (idx, t0, t1, on) that bridge up to ``merge_gap`` inactive frames.

    A run ends at its last active frame; one still open when its series ends closes at the series' last frame, as in the
    batch rule. ``cls`` is by length: over 0.5 s Int, over 0.1 s Backchannel, else None.
    """

    def close(own, end):
        s = own.pop("s")
        return [(s, end, _class(end - s))]

    def step(own, row):
        idx, t0, t1, on = row
        found = []
        if on:
            if "s" in own and idx - own["last"] > merge_gap + 1:
                found = close(own, own["e"])
            own.setdefault("s", t0)
            own["last"], own["e"] = idx, t1
        own["mx"], own["te"] = idx, t1
        return found

    def flush(own):
        return close(own, own["te"] if own["mx"] - own["last"] <= merge_gap else own["e"]) if "s" in own else []

    return in_order(frames.select(*keys, ts, "idx", "t0", "t1", "on"), keys, ts, ["idx", "t0", "t1", "on"], late, idle, step, flush, "s double, e double, cls string")


def outcomes(frames: DataFrame, key: str, ts: str, late: str, idle: float, lo: int, hi: int, hold: float = 0.5) -> DataFrame:
    """(key, idx, is_overlap, turn_hold_prob, label): at each listener onset, the share of frames ``lo`` to ``hi`` later in
    which the speaker (spk) holds the floor; a frame that is absent counts as silent, as in the batch rule."""

    def row(o):
        share = o["held"] / (hi - lo + 1)
        return (o["idx"], o["spk"], share, "BC" if share >= hold else "Int")

    def step(own, values):
        idx, spk, lis = values
        open_ = own.setdefault("open", [])
        done = [o for o in open_ if idx > o["idx"] + hi]
        own["open"] = open_ = [o for o in open_ if idx <= o["idx"] + hi]
        for o in open_:
            o["held"] += int(bool(spk) and idx >= o["idx"] + lo)
        if lis:
            if own.get("before") != idx - 1:
                open_.append({"idx": idx, "spk": int(spk), "held": int(bool(spk) and lo <= 0)})
            own["before"] = idx
        return [row(o) for o in done]

    def flush(own):
        return [row(o) for o in own.get("open", [])]

    return in_order(frames.select(key, ts, "idx", "spk", "lis"), [key], ts, ["idx", "spk", "lis"], late, idle, step, flush, "idx long, is_overlap long, turn_hold_prob double, label string")


def pending_only(events: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a stream whose key is not among the finished ones, a static table read anew in every batch."""
    return events.join(done.select(*key).distinct(), key, "left_anti")


def score_difference(counts: DataFrame, arms: list[str], by: list[str]) -> DataFrame:
    """Running union-calibre F1 of two arms and their difference; write in update or complete mode."""
    f1 = lambda a: F.sum(F.when(F.col("arm") == a, 2 * F.col("tp")).otherwise(0)) / F.greatest(F.lit(1), F.sum(F.when(F.col("arm") == a, F.col("tp") + F.col("fp") + F.col("n_gt")).otherwise(0)))
    return counts.groupBy(*by).agg(f1(arms[0]).alias("f1_a"), f1(arms[1]).alias("f1_b"), (f1(arms[1]) - f1(arms[0])).alias("delta"))
