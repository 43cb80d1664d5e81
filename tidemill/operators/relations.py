"""Relational building blocks: latest rows, ordered sets, pages, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..tables import latest_rows
from .events import running_sum


def latest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key, greatest by `order`; by partial aggregation, so a hot key is no sort in one task."""
    return latest_rows(df, key, list(order))


def earliest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, *order)]
    best = F.min_by(F.struct(*df.columns), F.struct(*order, *rest))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_r")).select("_r.*")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page (from 1) with `has_next`; one row more is read instead of counting all."""
    ahead = df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    placed = ahead.withColumn("_place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # size + 1 rows
    whole = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    return placed.withColumn("has_next", whole > size).filter(F.col("_place") <= size).drop("_place")


def first_of_each(df: DataFrame, key: str, place: str) -> DataFrame:
    """Order-preserving removal of repeats: of each key the row with the least `place`. Null keys are all kept."""
    named = df.filter(F.col(key).isNotNull())
    kept = named.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(place, *[c for c in df.columns if c not in (key, place)])).alias("_r")).select("_r.*")
    return kept.unionByName(df.filter(F.col(key).isNull()))


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or ignore: rows of `new` whose key `old` lacks are appended."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def upserted(old: DataFrame, new: DataFrame, key: str, prefer_old: Sequence[str] = ()) -> DataFrame:
    """The next snapshot: new values replace old ones unless null; columns of `prefer_old` keep what they hold."""
    o, n = (df.select(F.col(key), F.struct(*[c for c in df.columns if c != key]).alias(a)) for df, a in ((old, "_o"), (new, "_n")))
    joined = o.join(n, key, "full_outer")
    out = [F.coalesce(*(F.col(f"{s}.{c}") for s in (("_o", "_n") if c in prefer_old else ("_n", "_o")))).alias(c) for c in old.columns if c != key]
    return joined.select(key, *out)


def keepers(df: DataFrame, key: str, order: Sequence[Column], id: str) -> DataFrame:
    """Every row with its place among those of its key and the id of the first: the one to keep."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).withColumn("keeper", F.first(id).over(w))


def merged(df: DataFrame, key: str, order: Column, id: str) -> DataFrame:
    """Every row with the id to keep of its key (least by `order`) and whether it is that one. The keeper is an aggregate
    joined back, so a key with many rows is no sort in one task."""
    first = df.groupBy(key).agg(F.min_by(id, order).alias("keeper"))
    return df.join(first, key).withColumn("kept", F.col(id) == F.col("keeper"))


def winners(df: DataFrame, slot: str, order: Sequence[Column]) -> DataFrame:
    """One winner per slot, first come first served; the rest are marked as lost."""
    least = df.groupBy(slot).agg(F.min(F.struct(*order)).alias("_best"))
    return df.join(least, slot).withColumn("won", F.struct(*order) == F.col("_best")).drop("_best")


def running_limit(df: DataFrame, part: str, order: Sequence[Column], bucket: Column, usable: Column, limit: int) -> DataFrame:
    """Rows up to and with the limit-th usable one of each part; what comes before is kept for counting.

    `bucket` must not fall along the order; it spreads a large part (see `events.running_sum`).
    """
    counted = running_sum(df, part, list(order), bucket, usable.cast("int"), "used")
    return counted.filter((F.col("used") < limit) | ((F.col("used") == limit) & usable))
