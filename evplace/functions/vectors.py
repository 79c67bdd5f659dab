"""Expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v):
    """v over its length, which counts as 1e-12 at least."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def ticks(seconds, scale: float):
    """Seconds as whole ticks, halves to even."""
    return F.bround(seconds / scale, 0).cast("long")


def to_seconds(t, scale: float):
    return t * F.lit(scale)
