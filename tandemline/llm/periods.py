"""Periodic runs of words by string synchronising sets.

Texts are joined into blocks in numpy (a word number of its own ends each text, so nothing periodic crosses it).
``names[k][i]`` numbers the distinct stretches of 2^k words, so stretches are compared exactly, not by hash.

At the scale t = 2^k a position j is *flat* if the t words from j have a period of t/3 or less; flat stretches lie in
runs that smaller scales have found. A position i is *synchronising* if, among the positions i..i+t that are not flat,
the smallest hash of a stretch of t words is that of i or of i+t. So membership depends on the 2t words from i alone, and
t positions in a row hold a synchronising one unless the 3t-1 words from the first are flat throughout.

A run of period p and length 2p or more, with t the largest power of two for which 3t-1 <= p, therefore shows a
synchronising i with the same context of 2t words at i+p, or its first words up to its length less p have a period of
t/3 or less. Equal contexts lie at least t/3 apart, so each position proposes a bounded number of periods. In the second
case the run lies over the border of two touching runs A and B of the same small period q, and B's words continue A's
at p places before: p is fixed modulo q, and the candidates are at most min(|A|, |B|) / q. Period 1 is found directly.
Each candidate is extended to both sides by doubling steps over ``names`` and kept if it has at least two periods.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run that is reported, in words.
LEAST = 12
#: Words of texts that are searched together; a longer text is a block of its own.
BLOCK = 100_000
INF = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each number."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def named(x: np.ndarray) -> list[np.ndarray]:
    """Numbers of all stretches of 1, 2, 4, ... words, as long as some stretch of that length occurs twice."""
    levels, width = [np.unique(x, return_inverse=True)[1].astype(np.int64)], 1
    while len(x) > 2 * width:
        a = levels[-1]
        pair = a[:-width] * (int(a.max()) + 1) + a[width:]
        distinct, nxt = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            break
        levels.append(nxt.astype(np.int64))
        width *= 2
    return levels


def _extended(names: list[np.ndarray], at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretch around ``at`` in which words ``p`` apart are equal; empty if at differs."""
    right, left, top = at.copy(), at.copy(), len(names) - 1
    for k in range(top, -1, -1):
        name, step = names[k], 1 << k
        while True:  # below the top at most one more step of each size fits
            go = np.flatnonzero(right + p < len(name))
            go = go[name[right[go]] == name[right[go] + p[go]]]
            right[go] += step
            if k < top or not len(go):
                break
        while True:
            go = np.flatnonzero(left >= step)
            go = go[name[left[go] - step] == name[left[go] - step + p[go]]]
            left[go] -= step
            if k < top or not len(go):
                break
    return left, right + p


class _Runs:
    """Runs found so far, each (start, end) once with its smallest period."""

    def __init__(self):
        self.s = self.e = self.p = np.zeros(0, np.int64)

    def add(self, s, e, p) -> None:
        ok = e - s >= 2 * p
        s, e, p = (np.concatenate([a, b[ok]]) for a, b in ((self.s, s), (self.e, e), (self.p, p)))
        order = np.lexsort((p, e, s))
        s, e, p = s[order], e[order], p[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.s, self.e, self.p = s[first], e[first], p[first]


def _synchronising(name: np.ndarray, t: int, k: int, runs: _Runs, n: int) -> np.ndarray:
    """Synchronising positions i with i + 2t <= n."""
    flat = np.zeros(n + 1, np.int64)
    inside = (3 * runs.p <= t) & (runs.e - runs.s >= t)
    np.add.at(flat, runs.s[inside], 1)
    np.add.at(flat, runs.e[inside] - t + 1, -1)
    h = np.where(np.cumsum(flat)[: len(name)] > 0, INF, _mixed(name, k))
    low = h
    for j in range(k):  # minimum over t positions by halves
        low = np.minimum(low[: len(low) - (1 << j)], low[1 << j :])
    low = np.minimum(low[:-1], h[t:])  # and over t + 1
    return np.flatnonzero((low < INF) & ((h[: len(low)] == low) | (h[t:] == low)))


def _close_pairs(at: np.ndarray, context: np.ndarray, least: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of all pairs of equal context whose distance is in [least, below)."""
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    found, gap = [], 1
    while gap < len(at):
        d = at[gap:] - at[:-gap]
        near = (context[gap:] == context[:-gap]) & (d < below)
        if not near.any():
            break
        hit = near & (d >= least)
        found.append((at[:-gap][hit], d[hit]))
        gap += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([d for _, d in found])


def _over_borders(names: list[np.ndarray], runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) proposed where two touching runs of one small period meet out of phase."""
    order = np.lexsort((runs.s, runs.p))
    s, e, q = runs.s[order], runs.e[order], runs.p[order]
    meet = (q[1:] == q[:-1]) & (s[1:] <= e[:-1]) & (np.minimum(e[1:] - s[1:], e[:-1] - s[:-1]) >= 8 * q[1:])
    a, b = np.flatnonzero(meet), np.flatnonzero(meet) + 1
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # phase: the first place o of A where B's first period of words occurs
    pair = np.repeat(np.arange(len(a)), q[a])
    o = np.arange(len(pair)) - np.repeat(np.cumsum(q[a]) - q[a], q[a])
    x, y, w = s[a][pair] + o, s[b][pair], q[a][pair]
    same = np.zeros(len(pair), bool)
    level = np.floor(np.log2(w)).astype(int)
    for k in np.unique(level):
        if k < len(names):
            i = np.flatnonzero(level == k)
            off = w[i] - (1 << int(k))
            same[i] = (names[k][x[i]] == names[k][y[i]]) & (names[k][x[i] + off] == names[k][y[i] + off])
    pair, o = pair[same], o[same]
    pair, first = np.unique(pair, return_index=True)
    a, b, o = a[pair], b[pair], o[first]
    top = np.minimum(e[a] - s[a], e[b] - s[b])
    base = (s[b] - s[a] - o) % q[a] + 2 * q[a]
    many = np.maximum(0, (top - base) // q[a] + 1)
    row = np.repeat(np.arange(len(a)), many)
    p = base[row] + q[a][row] * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    return np.maximum(s[a][row], s[b][row] - p), p


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs with at least two periods, by start, then end."""
    n, runs = len(x), _Runs()
    if n < 2:
        return runs.s, runs.e, runs.p
    names = named(x)
    same = np.concatenate([[False], x[1:] == x[:-1], [False]])
    s, e = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
    runs.add(s, e + 1, np.ones(len(s), np.int64))
    for k in range(len(names) - 1):  # a context is twice as long as the scale
        t = 1 << k
        i = _synchronising(names[k], t, k, runs, n)
        at, p = _close_pairs(i, names[k + 1][i], max(2, 3 * t - 1), 6 * t - 1)
        runs.add(*_extended(names, at, p), p)
    at, p = _over_borders(names, runs)
    runs.add(*_extended(names, at, p), p)
    return runs.s, runs.e, runs.p


def planted(words: list, doc_id: str | None) -> list:
    """For one id in ten (by its CRC-32) the words from a place on repeat with a period, both taken from the id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _row(words: list[bytes], s: np.ndarray, e: np.ndarray, p: np.ndarray) -> tuple:
    """One document's digest columns."""
    order = np.lexsort((p, s))
    s, e, p = s[order], e[order], p[order]
    text = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), (e - s).tolist(), p.tolist()))
    best = [None] * 4
    kept = words
    if len(s):
        k = int(np.lexsort((p, s, s - e))[0])
        length, period = int(e[k] - s[k]), int(p[k])
        best = [int(s[k]), length, period, 1000 * length // period]
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, s + p, 1)
        np.add.at(drop, e, -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0)]
    return (len(s), *best, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _searched(block: list[list[bytes]]) -> list[tuple]:
    """Digest columns of the documents of a block."""
    sizes = np.array([len(w) for w in block], np.int64)
    flat = [w for words in block for w in [*words, None]]
    code = pd.factorize(np.array(flat, object))[0].astype(np.int64)
    ends = np.cumsum(sizes + 1)
    code[ends - 1] = len(flat) + np.arange(len(block))  # one number of its own after each text
    s, e, p = runs_of(code)
    keep = e - s >= np.maximum(LEAST, 2 * p)
    s, e, p = s[keep], e[keep], p[keep]
    begin = ends - sizes - 1
    doc = np.searchsorted(ends, s, side="right")
    lo, hi = np.searchsorted(doc, np.arange(len(block))), np.searchsorted(doc, np.arange(len(block)), side="right")
    return [_row(w, s[a:b] - at, e[a:b] - at, p[a:b]) for w, at, a, b in zip(block, begin, lo, hi)]


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def digested(docs: DataFrame, edit=planted) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every document.

    ``edit(words, doc_id)`` changes the words first (None: no change); it gets the id as text. A null, empty or blank text has no words, no runs
    and the digests of empty strings; a null doc_id is not edited. Repeated rows come back as often as given, an empty
    table gives an empty result, and other columns play no part. Texts are searched whole, each inside one task.
    """
    def work(batches):
        for pdf in batches:
            block, ids, size = [], [], 0
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                words = text.encode().split() if text else []
                block.append(edit(words, i) if edit else words)
                ids.append(i)
                size += len(words)
                if size >= BLOCK:
                    yield _frame(ids, _searched(block))
                    block, ids, size = [], [], 0
            if block:
                yield _frame(ids, _searched(block))

    numbers = ", ".join(f"{c} long" for c in COLUMNS[:5])
    named_ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = named_ids.mapInPandas(work, f"doc_id string, {numbers}, runs_sha256 string, collapsed_sha256 string")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _frame(ids: list, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS).astype({c: "Int64" for c in COLUMNS[:5]})
    out.insert(0, "doc_id", ids)
    return out
