"""Rounding and stepping rules on doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def round3(x: Column) -> Column:
    """To three places, halves upward on the multiplied double (not HALF_UP on the decimal expansion)."""
    return F.floor(x * 1000.0 + 0.5) / 1000.0


def clamp(x: Column, low: float, high: float) -> Column:
    """Between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def steps(x: Column, cuts: Sequence[tuple[float, float]], beyond: float) -> Column:
    """The value of the first cut that x doesn't exceed, else `beyond`."""
    out = None
    for most, value in cuts:
        out = F.when(x <= most, value) if out is None else out.when(x <= most, value)
    return out.otherwise(beyond)


def floor_steps(x: Column, cuts: Sequence[tuple[float, float]], below: float) -> Column:
    """The value of the first cut that x reaches, cuts falling; `below` where it reaches none."""
    out = None
    for least, value in cuts:
        out = F.when(x >= least, value) if out is None else out.when(x >= least, value)
    return out.otherwise(below)


def reading_minutes(words: Column, rate: int = 230) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / rate)).cast("int")


def storage_level(used: Column, limit: Column) -> Column:
    """How full a store is: a warning from 70 % on, critical from 85 % on."""
    return F.when(used >= 0.85 * limit, "critical").when(used >= 0.7 * limit, "warning").otherwise("ok")
