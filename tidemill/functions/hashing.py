"""Hashes that agree with 32-bit arithmetic, computed in 64 bits."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .numbers import round3

WORD = 0xFFFFFFFF


def fnv1a_int(text: str) -> int:
    """FNV-1a over UTF-16 code units."""
    h = 2166136261
    units = text.encode("utf-16-le")
    for low, high in zip(units[::2], units[1::2]):
        h = ((h ^ (low | high << 8)) * 16777619) & WORD
    return h


def fnv1a(text: Column) -> Column:
    """The same inside the JVM; exact for the basic plane, where a character is one code unit."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(text.isNotNull(), F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(WORD))))


@F.pandas_udf(T.LongType())
def fnv1a_any(text: pd.Series) -> pd.Series:
    """For texts with characters beyond the basic plane, and for many long texts."""
    known = lru_cache(maxsize=1 << 16)(fnv1a_int)
    return pd.Series([None if t is None else known(t) for t in text], dtype="Int64")


def mix_int(x: int) -> int:
    for _ in range(2):
        x = ((x ^ x >> 16) * 0x45D9F3B) & WORD
    return x ^ x >> 16


def jitter(seed: Column, span: float = 0.3) -> Column:
    """A number in [-span, span] that depends on the seed only."""
    return round3(fnv1a(seed) / float(WORD) * 2 * span - span)


def stable_id(text: Column) -> Column:
    """The first 16 bytes of SHA-256, in hexadecimal."""
    return F.substring(F.sha2(text, 256), 1, 32)
