"""Exact Jaccard join of shingle sets: rare-first prefixes, positions, lengths, hubs under frequent shingles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, saved, written
from .components import components

SEED = 42
#: Jaccard threshold as a fraction, so that all bounds are whole numbers.
NUM, DEN = 4, 5
#: Sets under one prefix shingle that are compared pair by pair; under a more frequent one they meet hubs first.
PAIR_BUCKET = 32
#: Hubs that the sets under a frequent shingle meet before the rest of them are compared with all.
HUBS = 3
#: One text in so many is counted for the order of the shingles: every one. Any common order gives the same result.
SAMPLE = 1
#: Counters to which the shingles of all texts are dealt for that order.
COUNTERS = 1 << 18
#: 64-bit words of a set's parities; two sets differ in at least as many shingles as parities.
WORDS = 16


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 values of all word shingles in their order; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts, stops = (ends - size)[:n].tolist(), (ends[min(width, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts, stops)], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        block = hashes[at : at + 4096]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles of the texts fall to each of a fixed number of counters, whatever the input; only the order comes from them."""
    texts = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)

    def work(batches):
        table = np.zeros(COUNTERS, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                np.add.at(table, (np.unique(shingles(t, width)) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(table)
        yield pd.DataFrame({"c": at, "n": table[at]})

    found = texts.mapInPandas(work, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTERS, np.int64)
    table[found["c"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return table


def with_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, fp, sh, n, sk, pre): as ``with_fingerprints``, a hash of the set of shingles, its size, parities and prefix."""
    count = frequencies(docs, width)

    def prefix(s: np.ndarray) -> np.ndarray:
        k = len(s) - -(-len(s) * NUM // DEN) + 1
        return s[np.lexsort((s, count[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:k]]

    def parities(s: np.ndarray) -> np.ndarray:
        odd = np.bincount((s % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def work(batches):
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                hashes = shingles(t, width)
                s = np.unique(hashes)
                pre = prefix(s) if len(s) else s
                rows.append((majority(hashes), xxhash.xxh64_intdigest(s.tobytes(), SEED), len(s), parities(s), pre.view(np.int64)))
            fp, sh, n, sk, pre = zip(*rows) if rows else ((), (), (), (), ())
            signed = lambda v: np.array(v, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "th": pdf["th"].array, "fp": signed(fp), "sh": signed(sh), "n": np.array(n, np.int64), "sk": pd.Series(sk, dtype=object), "pre": pd.Series(pre, dtype=object)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, th long, fp long, sh long, n long, sk array<long>, pre array<long>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInPandas(work, shape)


def _could_match(x: str, y: str) -> Column:
    """Sizes allow the threshold, and the positions of the shared shingle as the first that the two sets share.

    Each pair that reaches it meets under that one; all shingles before it are in one set only.
    """
    nx, ny, i, j = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.i", f"{y}.i"))
    return (DEN * F.least(nx, ny) >= NUM * F.greatest(nx, ny)) & ((NUM + DEN) * (i + j + F.abs((nx - i) - (ny - j))) <= (DEN - NUM) * (nx + ny))


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of sets that really reach the threshold, as a saved table; the others it needs are deleted."""
    since = written()
    # parities first: a set is many times as wide, and is shipped once for every pair that is left
    x, y = (sets.select(F.col("sh").alias(c), F.col("n").alias(f"n{c}"), F.col("sk").alias(f"s{c}")) for c in "ab")
    apart = sum((F.bit_count(F.get("sa", F.lit(k)).bitwiseXOR(F.get("sb", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    near = (NUM + DEN) * apart <= (DEN - NUM) * (F.col("na") + F.col("nb"))
    pairs = saved(pairs.join(x, "a").join(y, "b").where(near).select("a", "b"))
    ends = pairs.select(F.col("a").alias("sh")).union(pairs.select("b")).distinct()
    wanted = saved(sets.select("sh", "th").join(ends, "sh").select("sh", F.col("th").alias("__th")))

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame({"sh": pdf["sh"], "t": pd.Series([np.unique(shingles(t, width)).view(np.int64) for t in pdf["text"]], index=pdf.index, dtype=object)})

    texts = docs.select("text").join(wanted, F.xxhash64("text") == F.col("__th")).select("sh", "text")
    full = saved(texts.mapInPandas(work, "sh long, t array<long>").dropDuplicates(["sh"]))
    x, y = (full.select(F.col("sh").alias(c), F.col("t").alias(f"t{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("both"))
    found = saved(both.where(DEN * F.col("both") >= NUM * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))
    release(docs.sparkSession, since, last=1)
    return found


def links(docs: DataFrame, marked: DataFrame, width: int) -> DataFrame:
    """Edges (a, b) between fingerprints that join all texts whose sets reach the threshold.

    Two sets that reach it share a shingle of their prefixes. Under a rare shingle all pairs are candidates. Under a
    frequent one each set first meets hubs; a pair that the found edges join already needs no look, and what is then
    apart from the largest part of a shingle's sets is compared with all of them.
    """
    held = marked.where("n > 0")
    sets = saved(held.groupBy("sh").agg(F.min("fp").alias("fp"), F.min("th").alias("th"), F.any_value("n").alias("n"), F.any_value("sk").alias("sk"), F.any_value("pre").alias("pre")))
    low = sets.select("sh", F.col("fp").alias("a"))
    same = held.select("sh", F.col("fp").alias("b")).distinct().join(low, "sh").where("a <> b").select("a", "b")
    rows = sets.select("sh", "n", F.posexplode("pre").alias("i", "tok"))
    rows = saved(rows.withColumn("m", F.count("*").over(Window.partitionBy("tok"))).where("m > 1"))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        met = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.sh") != F.col("y.sh")) & _could_match("x", "y"))
        return met.select(F.least("x.sh", "y.sh").alias("a"), F.greatest("x.sh", "y.sh").alias("b"))

    few, hot = rows.where(F.col("m") <= PAIR_BUCKET), rows.where(F.col("m") > PAIR_BUCKET)
    asked = saved(pairs(few, few).distinct())
    found = _verified(docs, sets, asked, width)
    if not hot.isEmpty():
        for k in range(HUBS + 1):
            roots = components(found)
            named = saved(hot.join(roots.select(F.col("node").alias("sh"), "root"), "sh", "left").withColumn("root", F.coalesce("root", "sh")))
            parts = named.groupBy("tok", "root").agg(F.count("*").alias("c"), F.min("sh").alias("low"))
            most = parts.groupBy("tok").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("parts"))
            most = saved(most.where("parts > 1").select("tok", F.col("top.root").alias("top")))
            left = saved(named.join(most, "tok").where("root <> top").drop("top"))  # apart from the largest part
            if left.isEmpty():
                break
            if k < HUBS:  # the rest of a shingle's sets meets one of its largest part, and the smallest of the rest
                one = parts.join(most, ["tok"]).where("root = top").select("tok", F.col("low").alias("sh"))
                rest = left.groupBy("tok").agg(F.min("sh").alias("sh"))
                heads = saved(named.join(one.union(rest), ["tok", "sh"], "left_semi"))
                new = pairs(left, heads)
            else:
                x, y = left.alias("x"), named.alias("y")
                met = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.root") != F.col("y.root")) & _could_match("x", "y"))
                new = met.select(F.least("x.sh", "y.sh").alias("a"), F.greatest("x.sh", "y.sh").alias("b"))
            new = saved(new.distinct().join(asked, ["a", "b"], "left_anti"))
            asked = asked.union(new)
            found = found.union(_verified(docs, sets, new, width))
    at = low.withColumnRenamed("a", "fp")
    named = found.join(at.withColumnsRenamed({"sh": "a", "fp": "fa"}), "a").join(at.withColumnsRenamed({"sh": "b", "fp": "fb"}), "b")
    return named.where("fa <> fb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).union(same).distinct()
