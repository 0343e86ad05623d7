"""Scalar, vector and rounding functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(c: Column) -> Column:
    """Two decimals, half to even on the binary number."""
    return F.rint(c * 100) / 100


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, zero: float | None = 0.0, tiny: float = 0.0) -> Column:
    """Cosine similarity; zero is the value where a norm is at most tiny (1.0, 0.0 or null by the caller's policy)."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > tiny) & (nb > tiny), dot(a, b) / (na * nb)).otherwise(F.lit(zero).cast("double"))


def decayed(weight: Column, last_used: Column, now: float, half_life_days: float) -> Column:
    """Exponential half-life decay; unchanged without a time of last use or a positive half-life."""
    if half_life_days <= 0:
        return weight
    age = F.greatest(F.lit(0.0), F.lit(now) - last_used)
    return F.when(last_used.isNull(), weight).otherwise(weight * F.pow(F.lit(0.5), age / (half_life_days * 86400)))


def clock(seconds: Column) -> Column:
    """mm:ss, minutes not wrapped at 60."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)).cast("long"))
