"""Windows, streaks, gaps and episodes over timed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def newest_streak(df: DataFrame, key: str, day: str) -> DataFrame:
    """Per key the newest day and the number of consecutive days that end with it."""
    days = df.filter(F.col(day).isNotNull()).select(key, F.col(day).alias("d")).distinct()
    island = F.date_add("d", F.row_number().over(W.partitionBy(key).orderBy(F.col("d").desc())).cast("int"))
    grouped = days.withColumn("island", island).groupBy(key, "island").agg(F.max("d").alias("newest"), F.count(F.lit(1)).alias("streak"))
    return grouped.groupBy(key).agg(F.max_by("streak", "newest").cast("int").alias("streak"), F.max("newest").alias("newest"))


def sliding_rates(df: DataFrame, at: str, bad: Column, length: str, slide: str, least: int, share: float) -> DataFrame:
    """Per sliding window the rows, the bad ones, and whether their rate is alarming."""
    # Rows are counted per slide first; only the counts are spread to the windows they stand in.
    counts = df.groupBy(F.window(at, slide).alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("int")).alias("bad")).select(F.col("s.start").alias("_at"), "rows", "bad")
    out = counts.groupBy(F.window("_at", length, slide).alias("w")).agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "bad", ((F.col("rows") >= least) & (F.col("bad") >= share * F.col("rows"))).alias("alarm"))


def silent_stretches(df: DataFrame, key: str, at: str, hours: int) -> DataFrame:
    """Stretches of at least `hours` without a row of a key: absence needs neighbours, not rows.

    Neighbours are sought day by day; only the first and last row of each day meet across days, so a key with a large
    part of all rows is spread over its days.
    """
    rows = df.select(key, F.col(at).alias("from"), F.to_date(at).alias("_day"))
    inside = rows.withColumn("to", F.lead("from").over(W.partitionBy(key, "_day").orderBy("from")))
    ends = rows.groupBy(key, "_day").agg(F.min("from").alias("_first"), F.max("from").alias("from"))
    across = ends.withColumn("to", F.lead("_first").over(W.partitionBy(key).orderBy("_day"))).select(key, "from", "to")
    gaps = inside.select(key, "from", "to").unionByName(across)
    return gaps.filter(F.unix_micros(F.col("to").cast("timestamp")) - F.unix_micros(F.col("from").cast("timestamp")) >= hours * 3_600_000_000)


def running_sum(df: DataFrame, key: str, order: list[Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` up to each row of its key in the given order.

    `bucket` must not fall along the order (a day of a time, say). Sums of whole buckets are cumulated first, rows only
    inside their bucket, so no task holds a whole key.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    before = rows.groupBy(key, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = before.withColumn("_before", F.sum("_sum").over(W.partitionBy(key).orderBy(F.col("_bucket").asc_nulls_first())) - F.col("_sum")).drop("_sum")
    inside = F.sum("_value").over(W.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    l, r = rows.withColumn("_inside", inside).alias("l"), before.alias("r")
    joined = l.join(r, F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & F.col("l._bucket").eqNullSafe(F.col("r._bucket")))
    return joined.select("l.*", (F.col("l._inside") + F.col("r._before")).alias(name)).drop("_bucket", "_value", "_inside")


def per_hour_spine(df: DataFrame, at: str, first: Column, last: Column) -> DataFrame:
    """Counts per hour with a row for every hour from first to last, empty ones too."""
    counts = df.groupBy(F.date_trunc("HOUR", at).alias("hour")).agg(F.count(F.lit(1)).alias("rows"))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("hour"))
    return spine.join(counts, "hour", "left").fillna(0, ["rows"])


def episodes(df: DataFrame, key: str, order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Opening rows grouped into episodes that a closing row ends: one row each, with its count and ends.

    The first column of `order` is a time; episodes are numbered by day and row (`running_sum`), not key by key.
    """
    first = order[0]
    upto = running_sum(df, key, [F.col(c) for c in order], F.to_date(first), closes.cast("int"), "_closed")
    numbered = upto.withColumn("episode", F.col("_closed") - closes.cast("int"))
    out = numbered.groupBy(key, "episode").agg(
        F.sum(opens.cast("int")).alias("occurrences"),
        F.min(F.when(opens, F.col(first))).alias("opened"),
        F.max(F.when(opens, F.col(first))).alias("last_seen"),
        F.max(F.when(closes, F.col(first))).alias("closed"),
    )
    return out.filter("occurrences > 0").withColumn("state", F.when(F.col("closed").isNull(), "open").otherwise("closed")).drop("episode")
