"""Vectors as arrays, with higher-order functions; nothing leaves the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from .hashing import mix_int


def let(value: Column, then) -> Column:
    """`then(value)` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, unequal lengths and zero vectors."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(usable, let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(0.0))).otherwise(0.0)


def unit(a: Column) -> Column:
    """A zero vector stays as it is."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))))


def projected(a: Column, width: int, dimensions: int = 64) -> Column:
    """Signed hash projection of vectors of `width` values; buckets and signs depend on the places only."""
    cells: list[list[int]] = [[] for _ in range(dimensions)]  # 2 * place, and 1 more where the sign is minus
    for i in range(width):
        cells[mix_int(i) % dimensions].append(2 * i + mix_int(i + 17171) % 2)
    # One folded constant and a loop over it: 384 written-out terms take longer to compile than to run.
    table = F.from_json(F.lit(json.dumps(cells)), "array<array<int>>")
    term = lambda c: F.get(a, F.shiftright(c, 1)).cast("double") * (1 - 2 * c.bitwiseAND(F.lit(1)))
    return unit(F.transform(table, lambda cell: F.aggregate(cell, F.lit(0.0), lambda s, c: s + term(c))))


def usable(a: Column, width: int) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(a) == width) & F.forall(a, finite) & F.exists(a, lambda x: x != 0), F.lit(False))
