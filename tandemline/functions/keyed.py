"""Keyed random numbers: a pure function of (seed, keys), so results never depend on partitioning."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

_SCALE = float(16**13)


def u(seed, *keys) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of md5 over the pipe-joined keys.

    Keys must be integers or strings: the text of a double differs between engines.
    """
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_SCALE)


def u_sql(seed, *keys: str) -> str:
    """The same number as DuckDB text, for oracles."""
    joined = ", ".join([f"'{seed}'", *keys])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, 13)) AS UBIGINT) / pow(16, 13))"

_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5_head(words: list, n: int) -> np.ndarray:
    """First 52 bits of the MD5 of ``n`` one-block messages; a word is an array, or a number that all messages share."""
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((words[g] + _SINES[i]) % 2**32)
        else:
            f += words[g]
            f += np.uint32(_SINES[i])
        by = _TURNS[i // 16][i % 4]
        high = f << np.uint32(by)
        f >>= np.uint32(32 - by)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    a, b = (x + np.uint32(s) for x, s in zip((a, b), start))
    return (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap() >> np.uint32(12)).astype(np.uint64)


#: The four digits of 0000 to 9999, the first one lowest.
_FOUR = np.frombuffer(b"".join(b"%04d" % i for i in range(10000)), dtype="<u4").astype(np.uint64)


def _heads(prefixes: list[bytes], row: np.ndarray, tail: np.ndarray, part: int = 32768) -> np.ndarray:
    """First 52 bits of md5(prefixes[row] + the digits of tail), for a tail of one sign and one number of digits."""
    size, digits, minus = len(prefixes[0]), len(str(abs(int(tail[0])))), b"-" if tail[0] < 0 else b""
    size += len(minus)
    total = size + digits
    if total > 55:  # does not fit into one block
        return np.array([int(hashlib.md5(prefixes[r] + str(int(t)).encode()).hexdigest()[:13], 16) for r, t in zip(row, tail)], dtype=np.uint64)
    wide = -(-(total + 1) // 4)
    blank = b"".join(p + minus + bytes(digits) + b"\x80" + bytes(4 * wide - total - 1) for p in prefixes)
    table = np.ascontiguousarray(np.frombuffer(blank, dtype="<u4").reshape(len(prefixes), wide).T)
    tail = np.abs(tail).astype(np.uint32 if digits < 9 else np.uint64)
    out = np.empty(len(row), dtype=np.uint64)
    for i in range(0, len(row), part):
        r, x = row[i : i + part], tail[i : i + part]
        words = [w[r] for w in table] + [0] * (16 - wide)
        words[14] = 8 * total
        if digits < 9:
            q = x // 10000
            text = (_FOUR[q] | _FOUR[x - q * 10000] << np.uint64(32)) >> np.uint64(64 - 8 * digits)
            at, by = size // 4, 8 * (size % 4)
            for k, v in enumerate((text << np.uint64(by), text >> np.uint64(32 - by), text >> np.uint64(64 - by) if by else None)):
                if v is not None and at + k < wide:
                    words[at + k] |= v.astype(np.uint32)
        else:
            for at in range(total - 1, size - 1, -1):
                q = x // 10
                words[at // 4] |= (x - q * 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
                x = q
        out[i : i + part] = _md5_head(words, len(r))
    return out


def keyed_runs(seed, keys: list[list], first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``u(seed, *keys, i)`` times 2^52, a whole number, for ``count`` consecutive integers i from ``first``, run after run.

    For tasks that make the positions of runs themselves; ``keys`` holds a value of each key for every run.
    """
    row = np.repeat(np.arange(len(first)), count)
    tail = np.arange(len(row)) + np.repeat(first - np.cumsum(count) + count, count)
    prefixes = ["|".join([str(seed), *[str(x) for x in k if x is not None], ""]).encode() for k in zip(*keys)]
    size = np.array([len(p) for p in prefixes], dtype=np.int64)
    shape = lambda x: np.searchsorted(10 ** np.arange(1, 19), np.abs(x), side="right") * 2 + (x < 0)
    ends = shape(np.concatenate([first, first + count - 1])[np.tile(count > 0, 2)])
    if len(ends) and ends.min() == ends.max() and size.min() == size.max():
        return _heads(prefixes, row, tail)
    out = np.empty(len(row), dtype=np.uint64)
    for n in np.unique(size):
        mine = np.flatnonzero(size == n)
        new = np.zeros(len(prefixes), dtype=np.int64)
        new[mine] = np.arange(len(mine))
        at = np.flatnonzero(size[row] == n)
        if not len(at):
            continue
        x, head = tail[at], [prefixes[j] for j in mine]
        shapes = shape(x)
        for k in np.unique(shapes):
            some = np.flatnonzero(shapes == k)
            out[at[some]] = _heads(head, new[row[at[some]]], x[some])
    return out
