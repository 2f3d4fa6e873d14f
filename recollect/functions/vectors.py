"""Vector functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def distance_score(distance: Column) -> Column:
    """Cosine distance (0 to 2) as a score from 1 to 0."""
    return F.least(F.greatest(1 - distance / 2, F.lit(0.0)), F.lit(1.0))


def fit(a: Column, dim: int) -> Column:
    """Padded with zeros or cut to dim components."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def recency(created_ms: Column, now_ms: int, half_life_days: float, floor: float, ahead: bool = False) -> Column:
    """floor + (1 - floor) * 0.5 ** (age / half life); a half life of 0 or a missing time leaves 1, and times to come have age 0, or with `ahead` a negative one."""
    if half_life_days <= 0:
        return F.lit(1.0)
    since = F.lit(now_ms) - created_ms
    age = (since if ahead else F.greatest(since, F.lit(0))) / F.lit(86_400_000.0 * half_life_days)
    return F.coalesce(F.lit(floor) + F.lit(1 - floor) * F.pow(F.lit(0.5), age), F.lit(1.0))
