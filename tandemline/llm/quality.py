"""Quality rules: text statistics and decision lists learned by sequential covering."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, saved

WINDOW = 8
BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_distinct", "n_marked", "n_ends", "n_top"]
SAMPLE_ROWS = 20_000


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Positions covered by windows of ``width`` (a power of two) words that occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    mixed ^= mixed >> np.uint64(29)
    h = mixed[:n].copy()
    for k in range(1, width):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    h.sort()
    if not (h[1:] == h[:-1]).any():  # different values: all windows differ
        return 0
    rank, step = ids.astype(np.int64), 1
    while step < width:  # equal ranks: equal runs of 2 * step words
        rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[:n] += twice
    cover[width : width + n] -= twice
    return int((np.cumsum(cover) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` of a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # ASCII white space only
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), *[0] * (len(COUNTS) - 3))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marked = len(re.findall(rb"[^\w\s.,]{2,}(?=\s|$)", raw))
    ends = len(re.findall(rb"[.!?](?=\s|$)", raw))
    top = int(np.bincount(ids).max())
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ids), len(lines), upper, len(number), marked, ends, top)


def with_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and one long for each of ``COUNTS``."""

    def work(batches):
        for pdf in batches:
            found = pd.DataFrame([counts(t) for t in pdf["__text"]], columns=COUNTS, dtype=np.int64)
            yield pd.concat([pdf[list(keep)], found], axis=1)

    shape = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS])
    return docs.select(*keep, F.col("text").alias("__text")).mapInPandas(work, shape)


#: What rules may test: ratios of the counts, so that they hold for texts of any length.
FEATURES = {
    "word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "n_words"), "distinct_share": ("n_distinct", "n_words"),
    "marked_share": ("n_marked", "n_words"), "end_share": ("n_ends", "n_words"), "top_share": ("n_top", "n_words"),
    "line_words": ("n_words", "n_lines"), "words": ("n_words", None),
}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


Rule = list[tuple[str, str, float]]


def _covers(x: dict[str, np.ndarray], rule: Rule) -> np.ndarray:
    tests = [x[f] >= t if op == ">=" else x[f] < t for f, op, t in rule]
    return reduce(np.logical_and, tests, np.ones(len(next(iter(x.values()))), bool))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, rules: int = 12, precision: float = 0.95, support: int = 4) -> list[Rule]:
    """A decision list for ``bad`` rows by sequential covering.

    Each rule grows on two thirds of the rows left by the threshold with the largest information gain, is pruned from
    its end on the other third, and enters the list only if, of all rows left, it covers ``support`` bad ones at
    ``precision``. Covered rows then leave.
    """
    left, fold = np.ones(len(bad), bool), np.arange(len(bad)) % 3
    found: list[Rule] = []
    steps = {f: np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1])) if len(v) else np.array([]) for f, v in x.items()}
    for _ in range(rules):
        grow, prune = left & (fold < 2), left & (fold == 2)
        rule, inside = [], grow.copy()
        while len(rule) < 4 and (inside & ~bad).any() and (inside & bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best, base = (0.0, None, None), np.log2(p0 / (p0 + n0))
            for f, cuts in steps.items():
                pos, neg = np.sort(x[f][inside & bad]), np.sort(x[f][inside & ~bad])
                below_p, below_n = np.searchsorted(pos, cuts), np.searchsorted(neg, cuts)
                for op, p, n in ((">=", p0 - below_p, n0 - below_n), ("<", below_p, below_n)):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0)
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), (f, op, float(cuts[k])), None)
            if best[1] is None:
                break
            rule.append(best[1])
            inside = grow & _covers(x, rule)
        worth = lambda r: (lambda c: ((c & bad).sum() - (c & ~bad).sum()) / max(1, c.sum()))(prune & _covers(x, r))
        sizes = [worth(rule[:k]) for k in range(1, len(rule) + 1)]
        if not sizes:
            break
        rule = rule[: int(np.argmax(sizes)) + 1]
        covered = left & _covers(x, rule)
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        if p < support or p < precision * (p + n):
            break
        found.append(rule)
        left &= ~covered
    return found


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules for label quality 0, from at most ``rows`` labelled documents outside the held-out quarter."""
    sample = with_counts(labelled_sample(docs, labels, "quality", rows), ("doc_id", "label"))
    pdf = sample.where("n_words > 0").select("doc_id", "label", *[feature(f).alias(f) for f in FEATURES]).toPandas()
    pdf = pdf.sort_values(["doc_id", "label", *FEATURES], ignore_index=True)
    return learn({f: pdf[f].to_numpy() for f in FEATURES}, pdf["label"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression over the counts: false where a rule fires, else true."""
    tests = [reduce(lambda a, b: a & b, [feature(f) >= t if op == ">=" else feature(f) < t for f, op, t in r]) for r in rules]
    chain = F
    for t in tests:
        chain = chain.when(t, False)
    return chain.otherwise(True) if tests else F.lit(True)


def judged(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the counts, base_failed, kept.

    Base rules: under 20 words, or over 30 % of the words in repeated windows. Null and empty texts have no words and
    fail. Without labelled rows no rule is learned and the base rules decide. Rows come back as often as given; columns
    that aren't in ``keep`` play no part, and one of ``keep`` may not be called like a count.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    marked = with_counts(docs, keep).withColumn("base_failed", base)
    return marked.withColumn("kept", ~F.col("base_failed") & verdict(fitted(docs, labels)))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, columns as given; rows that repeat id and text share one verdict."""
    ids = judged(docs.withColumn("__th", F.xxhash64("text")), labels, ("doc_id", "__th")).where("kept")
    ids = saved(ids.select(F.col("doc_id").alias("__id"), "__th").distinct())
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__th")), "left_semi")
