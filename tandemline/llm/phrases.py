"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are read in blocks of bytes in numpy. A prefix polynomial over the bytes (modulo 2^64, odd base, so that the powers
have inverses) gives every word's fingerprint, a second one over the words' fingerprints that of every n-gram, each by two
lookups and a product. A fingerprint's key also holds the language and, in its last two bits, the number of words.

1. The shuffle sums the occurrences under each key and keeps one occurrence pointer (33 bits of a hash of the text, 30 bits
   of word position) and the least and greatest of a second, independent check value. Words and pairs come first; a triple
   is only counted if the bitmap of frequent pairs holds both of its pairs, which no frequent triple fails.
2. Frequent keys alone are turned into text: the documents that pointers name are read at those positions, and the
   fingerprint and the check value found there must be those of the key.
3. Keys with two check values are collisions. Their occurrences are counted again by their text, and these counts replace
   the key's.

Scores then need joins of frequent phrases only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

#: Bytes of text whose n-grams are counted together; a longer text is cut between pieces.
BLOCK = 1 << 19
#: The bitmap of frequent keys has 2^24 bits (2 MB) at any size; fuller, it lets more rare triples through to the count.
BITMAP = 24
CELL_WORDS = 1024
#: Texts that a task remembers to have read already; beyond them copies are read again, which changes no result.
SEEN = 100_000
UNKNOWN = "und"
ALL = (1 << 64) - 1
BASE, WORD_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x85EBCA6B
KIND = np.zeros(256, np.uint8)  # 0 inside a word, 1 between words, 2 between pieces
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?") + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64 or 2^32."""

    def __init__(self, base: int, kind: type):
        self.size = 1 << (8 * kind().itemsize)
        self.base, self.inverse, self.kind = base, pow(base, -1, self.size), kind
        self.up = self.down = np.ones(1, kind)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * self.kind(pow(self.base, k, self.size))])
            self.down = np.concatenate([self.down, self.down * self.kind(pow(self.inverse, k, self.size))])
        return self.up, self.down


BYTES, WORDS, CHECK = _Powers(BASE, np.uint64), _Powers(WORD_BASE, np.uint64), _Powers(CHECK_BASE, np.uint32)


class _Prefix:
    """Prefix sums of value times power, which give the polynomial fingerprint of any span."""

    def __init__(self, values: np.ndarray, powers: _Powers):
        up, self.down = powers.get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, powers.kind)
        np.multiply(values, up[: len(values)], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


class Block:
    """Words and n-gram keys of some stretches of text; ``owner`` and ``offset`` say where each stretch comes from."""

    def __init__(self, parts: list[bytes], salts: list[int], hashes: list[int], offsets: list[int], bits: int = 62):
        raw = LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
        kind = KIND[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.raw, self.start, self.end = raw, edge[::2], edge[1::2]
        stop = np.cumsum([len(p) + 1 for p in parts])
        self.part = np.searchsorted(stop, self.start, side="right")
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.start)
        self.joined = piece[1:] == piece[:-1]  # this word and the next are in one piece
        self.salt = np.array(salts, np.uint64)[self.part]
        self.hash = np.array(hashes, np.int64)[self.part]
        first = np.searchsorted(self.part, np.arange(len(parts)))
        self.pos = np.arange(len(self.start)) - first[self.part] + np.array(offsets, np.int64)[self.part]
        length = (self.end - self.start).astype(np.uint64)
        self.word = _Prefix(_mix(_Prefix(raw, BYTES).spans(self.start, self.end) + length), WORDS)
        second = _Prefix(raw, CHECK).spans(self.start, self.end).astype(np.uint64)
        self.second = _Prefix(_mix(second + length).astype(np.uint32), CHECK)
        self.bits = bits

    def at(self, k: int) -> np.ndarray:
        """First words of all n-grams of ``k`` words."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        ok = np.ones(n, bool)
        for j in range(k - 1):
            ok &= self.joined[j : j + n]
        return np.flatnonzero(ok)

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """A hash of words and language, with ``k`` in the last two bits."""
        fp = _mix(self.word.spans(at, at + k) + self.salt[at] * np.uint64(BASE))
        return (((fp >> np.uint64(64 - self.bits)) << np.uint64(2)) | np.uint64(k)).view(np.int64)

    def checks(self, k: int, at: np.ndarray) -> np.ndarray:
        """16 bits, from other polynomials."""
        return (_mix(self.second.spans(at, at + k).astype(np.uint64) + self.salt[at]) >> np.uint64(48)).astype(np.int32)

    def pointers(self, at: np.ndarray) -> np.ndarray:
        return (self.hash[at] << 30) | self.pos[at]

    def text(self, i: int, k: int) -> str:
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.start[i : i + k], self.end[i : i + k])).decode()


def _cut(raw: bytes) -> list[bytes]:
    """A long text in stretches of about a block, cut where pieces end, and further on where no piece ends in between."""
    out = []
    while len(raw) > BLOCK:
        ends = np.flatnonzero(KIND[np.frombuffer(raw[:BLOCK], np.uint8)] == 2)
        if len(ends):
            at = int(ends[-1]) + 1
        else:
            rest = np.flatnonzero(KIND[np.frombuffer(raw, np.uint8)] == 2)
            if not len(rest):
                break
            at = int(rest[0]) + 1
        out.append(raw[:at])
        raw = raw[at:]
    return [*out, raw]


def _count_words(raw: bytes) -> int:
    inside = KIND[np.frombuffer(raw, np.uint8)] == 0
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + (len(inside) > 0 and inside[0]))


def _rows(batch: pa.RecordBatch):
    """(text as bytes, salt, th) of a batch; one text at a time is taken out of it."""
    text, salt, th = (batch.column(c) for c in ("text", "salt", "th"))
    for i in range(batch.num_rows):
        yield text[i].as_buffer().to_pybytes(), salt[i].as_py(), th[i].as_py()


def blocks(rows, bits: int):
    """Blocks over (text as bytes, salt, th)."""
    parts, salts, hashes, offsets, size = [], [], [], [], 0
    for text, salt, th in rows:
        done = 0
        for raw in _cut(text):
            if size and size + len(raw) > BLOCK:
                yield Block(parts, salts, hashes, offsets, bits)
                parts, salts, hashes, offsets, size = [], [], [], [], 0
            parts.append(raw)
            salts.append(salt & ALL)
            hashes.append(th)
            offsets.append(done)
            size += len(raw)
            done += _count_words(raw) if len(raw) < len(text) else 0
    if parts:
        yield Block(parts, salts, hashes, offsets, bits)


def _source(docs: DataFrame) -> DataFrame:
    """(text, lang, salt, th) of documents that are not empty; ``th`` has 33 bits."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    return docs.where(F.length("text") > 0).select("text", lang.alias("lang")).select(
        "text", "lang", F.xxhash64(F.lit("lang"), "lang").alias("salt"), F.shiftrightunsigned(F.xxhash64("text"), 31).alias("th"))


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.argsort(key)
    s = key[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def counted(source: DataFrame, sizes: tuple[int, ...], least: int, bits: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(key, n, ptr, lo, hi) of all keys of n-grams of these sizes with ``least`` occurrences.

    ``pairs`` is the bitmap of frequent pairs; triples are counted only where it holds both pairs. Equal keys of a block
    are summed before they leave the task.
    """

    def work(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for b in blocks(_rows(batch), bits):
                    for k in sizes:
                        at = b.at(k)
                        if k == 3 and pairs is not None and len(at):
                            hit = has(pairs, b.keys(2, at))
                            at = at[hit]
                            at = at[has(pairs, b.keys(2, at + 1))]
                        key, check, ptr = b.keys(k, at), b.checks(k, at), b.pointers(at)
                        order, head = _grouped(key)
                        if len(head):
                            c, p = check[order], ptr[order]
                            yield pa.RecordBatch.from_pydict({
                                "key": key[order][head], "n": np.diff(np.append(head, len(key))), "ptr": np.minimum.reduceat(p, head),
                                "lo": np.minimum.reduceat(c, head), "hi": np.maximum.reduceat(c, head)})

    rows = source.select("text", "salt", "th").mapInArrow(work, "key long, n long, ptr long, lo int, hi int")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("ptr").alias("ptr"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("n") >= least)


def _slot(key: np.ndarray) -> np.ndarray:
    return (_mix(key.view(np.uint64)) >> np.uint64(64 - BITMAP)).astype(np.int64)


def has(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = _slot(key)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A fixed-size bitmap of the keys, put together on the executors; the driver gets 2^BITMAP bits whatever the input."""

    def words(batches):
        with np.errstate(over="ignore"):
            for pdf in batches:
                slot = _slot(pdf["key"].to_numpy(np.int64))
                word = slot >> 6
                bit = np.uint64(1) << (slot & 63).astype(np.uint64)
                order, head = _grouped(word)
                if len(head):
                    yield pd.DataFrame({"w": word[order][head], "bits": np.bitwise_or.reduceat(bit[order], head).view(np.int64)})

    def packed(key, pdf):
        cell = np.zeros(CELL_WORDS, np.int64)
        cell[pdf["w"] % CELL_WORDS] = pdf["bits"]
        return pd.DataFrame({"cell": [key[0]], "bits": [cell.tobytes()]})

    found = keys.select("key").mapInPandas(words, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits"))
    cells = found.groupBy(F.expr(f"w div {CELL_WORDS}").alias("cell")).applyInPandas(packed, "cell long, bits binary").collect()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    for row in cells:
        out[row.cell * CELL_WORDS : (row.cell + 1) * CELL_WORDS] = np.frombuffer(row.bits, np.uint64)
    return out


def materialised(source: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """(lang, k, phrase, key, n) of all keys with one check value, their words read where their pointers point.

    A pointer's hash may name several texts; only a text with the key and the check value at that position answers.
    """
    sure = frequent.where("lo = hi").select(F.shiftright("ptr", 30).alias("th"), F.struct("ptr", "key", "lo", "n").alias("w"))
    asked = sure.groupBy("th").agg(F.collect_list("w").alias("asked"))

    def fresh(batch, seen):
        for i, (raw, salt, th) in enumerate(_rows(batch)):
            mark = hashlib.blake2b(raw, digest_size=16, salt=(salt & ALL).to_bytes(8, "big")).digest()
            if mark not in seen:  # a copy has nothing to add
                if len(seen) < SEEN:
                    seen.add(mark)
                yield raw, salt, th

    def work(batches):
        seen = set()
        with np.errstate(over="ignore"):
            for batch in batches:
                want = batch.column("asked").flatten()
                ptr, key, check, n = (want.field(c).to_numpy(zero_copy_only=False) for c in ("ptr", "key", "lo", "n"))
                lang_of = {s & ALL: x for s, x in zip(batch.column("salt").to_pylist(), batch.column("lang").to_pylist())}
                for b in blocks(fresh(batch, seen), bits):
                    here = b.pointers(np.arange(len(b.start)))
                    order = np.argsort(here)
                    here = here[order]
                    todo, at = np.arange(len(ptr)), np.searchsorted(here, ptr)
                    while len(todo):  # texts that share a hash answer one after another
                        on = at[todo] < len(here)
                        todo = todo[on]
                        todo = todo[here[at[todo]] == ptr[todo]]
                        for k in (1, 2, 3):
                            q = todo[(key[todo] & 3 == k) & (order[at[todo]] + k <= len(here))]
                            w = order[at[q]]
                            ok = (b.keys(k, w) == key[q]) & (b.checks(k, w) == check[q])
                            q, w = q[ok], w[ok]
                            if len(q):
                                yield pa.RecordBatch.from_pydict({
                                    "lang": [lang_of[s] for s in b.salt[w].tolist()], "k": np.full(len(q), k, np.int32),
                                    "phrase": [b.text(j, k) for j in w.tolist()], "key": key[q], "n": n[q]})
                        at[todo] += 1

    found = source.join(asked, "th").select("text", "lang", "salt", "th", "asked")
    return found.mapInArrow(work, "lang string, k int, phrase string, key long, n long").dropDuplicates(["key"])


def recounted(source: DataFrame, doubtful: DataFrame, least: int, bits: int) -> DataFrame:
    """(lang, k, phrase, n) of the phrases under colliding keys, counted by their text."""
    bitmap = bitmap_of(doubtful)

    def work(batches):
        with np.errstate(over="ignore"):
            for pdf in batches:
                lang_of = dict(zip((s & ALL for s in pdf["salt"]), pdf["lang"]))
                for b in blocks(((t.encode(), s, h) for t, s, h in zip(pdf["text"], pdf["salt"], pdf["th"])), bits):
                    rows: dict[tuple, int] = {}
                    for k in (1, 2, 3):
                        at = b.at(k)
                        key = b.keys(k, at)
                        for j in np.flatnonzero(has(bitmap, key)).tolist():
                            row = (lang_of[int(b.salt[at[j]])], k, b.text(int(at[j]), k), int(key[j]))
                            rows[row] = rows.get(row, 0) + 1
                    if rows:
                        yield pd.DataFrame([(*r, n) for r, n in rows.items()], columns=["lang", "k", "phrase", "key", "n"])

    rows = source.mapInPandas(work, "lang string, k int, phrase string, key long, n long").join(doubtful.select("key"), "key", "left_semi")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrases(docs: DataFrame, least: int = 10, bits: int = 62) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to three words with ``least`` occurrences, (lang, k, phrase, n), and all words of each language,
    (lang, total). ``bits`` shortens the fingerprints, for tests."""
    source = _source(docs)
    short = saved(counted(source, (1, 2), least, bits))
    pairs = bitmap_of(short.where(F.col("key").bitwiseAND(F.lit(3)) == 2))
    long = saved(counted(source, (3,), least, bits, pairs))
    frequent = short.union(long)
    found = materialised(source, frequent, bits).select("lang", "k", "phrase", "n")
    doubtful = frequent.where("lo <> hi").select("key")
    if not doubtful.isEmpty():
        found = found.union(recounted(source, saved(doubtful), least, bits))
    return saved(found), totals(source)


def totals(source: DataFrame) -> DataFrame:
    """(lang, total): all word occurrences of each language."""

    def work(batches):
        for batch in batches:
            text = batch.column("text")
            n = [_count_words(text[i].as_buffer()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "n": n})

    return source.select("text", "lang").mapInArrow(work, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("total"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, bits: int = 62) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    A phrase scores floor(10^6 a^2 / (l r)) at its worst cut, ties to the first; the products are decimals of 38 digits,
    exact up to 10^15 occurrences. A pair inside a frequent triple with at least half of its occurrences is left out. Null,
    empty and blank texts have no words, a null language counts as ``und``, repeated rows count as often as given, and an
    empty table gives an empty result. Other columns play no part.
    """
    found, total = phrases(docs, least, bits)
    words = lambda i, n: F.substring_index(F.substring_index("phrase", " ", i + n), " ", -n)
    one, two, three = (found.where(F.col("k") == k) for k in (1, 2, 3))
    sides = two.select("lang", "phrase", F.col("n").alias("a"), F.lit(1).alias("cut"), words(0, 1).alias("x"), words(1, 1).alias("y"))
    for cut in (1, 2):
        sides = sides.union(three.select("lang", "phrase", F.col("n").alias("a"), F.lit(cut), words(0, cut).alias("x"), words(cut, 3 - cut).alias("y")))
    parts = found.where("k < 3").select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    parts = small(saved(parts))
    for side, name in (("x", "l"), ("y", "r")):
        sides = sides.join(parts.withColumnsRenamed({"part": side, "m": name}), ["lang", side])
    ratio = F.expr("cast((cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as bigint)")
    worst = sides.withColumn("score", ratio).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    inside = [three.select("lang", words(i, 2).alias("phrase"), F.col("n").alias("longer")) for i in (0, 1)]
    inside = reduce(DataFrame.union, inside).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a").drop("longer")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(8))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)  # leaves the last window 8 * top rows
    ranked = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
