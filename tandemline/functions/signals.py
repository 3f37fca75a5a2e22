"""Expressions over one signal per row held as array<double>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

EPS = 1e-8


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean_square(a: Column) -> Column:
    return dot(a, a) / F.size(a)


def rms(a: Column) -> Column:
    return F.sqrt(mean_square(a))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def quantile(a: Column, q: float) -> Column:
    """Linear-interpolation quantile of the absolute values."""
    s = F.array_sort(F.transform(a, F.abs))
    pos = (F.size(a) - 1) * F.lit(q)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    x, y = F.get(s, lo), F.get(s, hi)
    return x + (y - x) * (pos - lo)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def corr(a: Column, b: Column) -> Column:
    n = F.size(a)
    sa, sb = total(a), total(b)
    va, vb = dot(a, a) - sa * sa / n, dot(b, b) - sb * sb / n
    return F.when((va / n > 1e-18) & (vb / n > 1e-18), (dot(a, b) - sa * sb / n) / F.sqrt(va * vb))


def frame_rms(a: Column, win: int, hop: int) -> Column:
    """RMS of every full window of ``win`` samples at ``hop`` steps."""
    n = F.floor((F.size(a) - win) / hop).cast("int")
    return F.when(
        F.size(a) >= win, F.transform(F.sequence(F.lit(0), n), lambda i: rms(F.slice(a, i * hop + 1, win)))
    )


def active(frames: Column, ratio: float = 0.1, floor: float | None = None) -> Column:
    """Frames above a share of the maximum, or above a fixed level."""
    return F.transform(frames, lambda x: x > (F.lit(floor) if floor is not None else F.array_max(frames) * ratio))


def share(a: Column, pred) -> Column:
    return F.size(F.filter(a, pred)) / F.size(a)
