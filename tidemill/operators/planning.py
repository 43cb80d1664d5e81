"""Choosing sources to read next, and the pages to ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def page_window(depth: Column, most: int = 5) -> Column:
    """Page 1 and the pages at the frontier, at most `most` of them."""
    d = F.greatest(F.lit(1), F.floor(depth)).cast("int")
    if most <= 1:
        return F.array(F.lit(1))
    return F.when(d <= most, F.sequence(F.lit(1), d)).otherwise(F.concat(F.array(F.lit(1)), F.sequence(d - (most - 2), d)))


def next_depth(depth: Column, pending: Column) -> Column:
    return F.when(pending < 10, F.least(depth + 2, F.lit(100))).otherwise(depth).cast("int")


def acceptance(ready: Column, rejected: Column) -> Column:
    return (ready + 1) / (ready + rejected + 2)


def source_score(ready: Column, rejected: Column, scanned: Column, now: Column) -> Column:
    """Smoothed acceptance and a small bonus that grows over three days without a scan."""
    hours = F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(scanned)) / 3.6e9), F.lit(72.0))
    return acceptance(ready, rejected) + F.least(F.lit(72.0), hours) / 72 * 0.08


def exploit_explore(sources: DataFrame, count: int) -> DataFrame:
    """`count` sources (id, pending, score, last_scanned_at): the best of those with work, then the one not scanned for
    longest among all others, then the best again. `sources` has one row a source."""
    exploit = max(1, count - 1)
    pending = F.col("pending") > 0
    by_score = F.row_number().over(W.partitionBy(pending).orderBy(F.col("score").desc(), "id"))
    placed = sources.withColumn("_best", F.when(pending, by_score))
    taken = F.coalesce(F.col("_best") <= exploit, F.lit(False))
    oldest = F.row_number().over(W.partitionBy("_taken").orderBy(F.col("last_scanned_at").asc_nulls_first(), "id"))
    placed = placed.withColumn("_taken", taken).withColumn("_old", F.when(~F.col("_taken"), oldest))
    stage = F.when(F.col("_taken"), 0).when(F.col("_old") == 1, 1).when(F.col("_best").isNotNull(), 2).otherwise(3)
    order = [stage, F.when(stage == 3, F.col("_old")).otherwise(F.coalesce("_best", F.lit(0))), F.col("id")]
    final = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))
    return placed.withColumn("place", final).filter(F.col("place") <= count).drop("_best", "_taken", "_old")
