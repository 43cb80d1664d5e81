"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.relations import inserted, latest, upserted


def read_events(spark: SparkSession, folder: str, schema: StructType, at: str = "ts", delay: str = "2 days") -> DataFrame:
    """A file stream with a watermark. Times without zone are taken for UTC, as the session's are."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def pushed_articles(spark: SparkSession, folder: str, schema: StructType, delay: str = "2 days") -> DataFrame:
    """Mail pushed as JSON files, parsed as it comes, each message once."""
    from ..sources.feeds import parsed_mail

    raw = spark.readStream.schema(schema).json(folder).withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", delay)
    return parsed_mail(raw.filter("message_id is not null").dropDuplicatesWithinWatermark(["message_id"])).filter("error is null")


def windowed_rates(events: DataFrame, at: str, bad, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window(at, length, slide)).agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("int")).alias("bad"))


def once(events: DataFrame, key: str) -> DataFrame:
    """Each key once within the watermark: deliveries repeated after a failure are dropped."""
    return events.dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    return events.groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("rows")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows")


EPISODE = "key long, occurrences long, opened timestamp, last_seen timestamp, closed timestamp"
EPISODE_STATE = "occurrences long, opened timestamp, last_seen timestamp"


def closed_episodes(events: DataFrame, key: str, at: str, kind: str, opens: str, closes: str) -> DataFrame:
    """Episodes as they close: opening events of a key up to its next closing event. Open ones stay in the state."""

    def step(id: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, opened, seen = state.get if state.exists else (0, None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values(["at", "kind"])
        for at_, kind_ in zip(rows["at"], rows["kind"]):
            if kind_ == opens:
                opened = at_ if not count else opened
                count, seen = count + 1, at_
            elif kind_ == closes and count:
                out.append((id[0], count, opened, seen, at_))
                count, opened, seen = 0, None, None
        if count:
            state.update((count, opened, seen))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "occurrences", "opened", "last_seen", "closed"])

    chosen = events.select(F.col(key).cast("long").alias("key"), F.col(at).alias("at"), F.col(kind).alias("kind")).filter(F.col("kind").isin(opens, closes))
    return chosen.groupBy("key").applyInPandasWithState(step, EPISODE, EPISODE_STATE, "append", GroupStateTimeout.NoTimeout)


def snapshot_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The newest snapshot before a batch; batches that wrote none are passed over."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    older = [int(n) for n in names if n.isdigit() and int(n) < number and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{max(older)}") if older else None


def upsert_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the next snapshot beside the last, named by the batch, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        rows = latest(batch, key, [F.col(order)])
        before = snapshot_before(batch.sparkSession, path, number)
        if before is not None:
            rows = upserted(before, rows, key)
        rows.write.mode("overwrite").parquet(f"{path}/{number}")

    return write


def insert_into(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that ignores keys it already holds."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        before = snapshot_before(batch.sparkSession, path, number)
        if before is not None:
            rows = inserted(before, rows, key)
        rows.write.mode("overwrite").parquet(f"{path}/{number}")

    return write
