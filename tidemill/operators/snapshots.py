"""State kept as snapshots: each change is a function of the old rows and the changes to the new rows.

Nothing is updated in place. Changes of one key are put in order before they are applied, ties by the columns named, so a
repeated or shuffled batch gives the same snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Statuses that an analysis no longer changes.
SETTLED = ("recommended", "blocked", "unavailable")
RETRY_LIMIT = 3


def transition(articles: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Articles (id, status, retry_count, rejection_reason, updated_at) after outcomes (id, outcome, reason).

    `unavailable` is final; `failed` counts a retry; `rejected` keeps its reason, cut to 500 characters; `ready` clears
    it. Settled articles stay as they are. Articles without an outcome stay too; outcomes of unknown ids are dropped.
    """
    joined = articles.join(outcomes, "id", "left")
    free = F.col("outcome").isNotNull() & ~F.col("status").isin(*SETTLED)
    named = {"failed": "analysis_failed", "rejected": "rejected", "unavailable": "unavailable", "ready": "ready"}
    status = F.coalesce(*[F.when(free & (F.col("outcome") == o), F.lit(s)) for o, s in named.items()], F.col("status"))
    reason = F.when(free & (F.col("outcome") != "ready"), F.substring(F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown_error")), 1, 500)).when(free, F.lit(None)).otherwise(F.col("rejection_reason"))
    return joined.select(
        "id", status.alias("status"), (F.col("retry_count") + F.coalesce((free & (F.col("outcome") == "failed")).cast("int"), F.lit(0))).alias("retry_count"),
        reason.alias("rejection_reason"), F.when(free, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def processable(status: Column, retries: Column, reason: Column) -> Column:
    """New articles, failed ones with retries left, and those rejected for an empty body."""
    return (status == "discovered") | ((status == "analysis_failed") & (retries < RETRY_LIMIT)) | ((status == "rejected") & (reason == "empty_body"))


def saved_bodies(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming bodies (id, hash, bytes, at) held against known ones (id, hash): one row each with what became of it.

    `duplicate_of` is the least other id with the same hash, known before or earlier in the batch; else the body is
    saved under `object_key`, and `expired_key` is the body of the same article it replaces.
    """
    before = known.select(F.col("hash").alias("_h"), F.col("id").alias("_other"), F.lit(None).cast("timestamp").alias("_at"))
    both = before.unionByName(incoming.select(F.col("hash").alias("_h"), F.col("id").alias("_other"), F.col("at").alias("_at")))
    first = both.groupBy("_h").agg(F.min(F.struct(F.col("_at").isNotNull(), "_at", "_other")).alias("_f")).select("_h", F.col("_f._other").alias("_first"))
    old = known.groupBy("id").agg(F.max("hash").alias("_old"))
    joined = incoming.join(first, incoming["hash"] == first["_h"], "left").join(old, "id", "left")
    copy = F.col("_first") != F.col("id")
    key = lambda h: F.concat(F.lit("articles/"), "id", F.lit("/"), h, F.lit(".txt"))
    return joined.select(
        "id", F.when(copy, F.col("_first")).alias("duplicate_of"), F.when(~copy, key(F.col("hash"))).alias("object_key"), F.when(~copy, F.col("bytes")).alias("bytes"),
        F.when(~copy & (F.col("_old") != F.col("hash")), key(F.col("_old"))).alias("expired_key"),
    )


def arbitrated(claims: DataFrame, slot: str, order: Sequence[str], taken: DataFrame) -> DataFrame:
    """Claims on slots, first come first served; slots of `taken` are gone. Each row says whether it won, and what its run
    becomes: the winner's is complete, any other degraded."""
    least = claims.join(taken.select(slot), slot, "left_anti").groupBy(slot).agg(F.min(F.struct(*order)).alias("_best"))
    won = F.coalesce(F.struct(*order) == F.col("_best"), F.lit(False))
    return claims.join(least, slot, "left").withColumn("won", won).drop("_best").withColumn("run_status", F.when(F.col("won"), "complete").otherwise("degraded"))


def latest_state(writes: DataFrame, key: str, started: str, value: str, *tie: str) -> DataFrame:
    """A key-value table in which an older observer never overwrites a newer one: per key the value started last."""
    return writes.groupBy(key).agg(F.max(F.struct(started, *tie, value)).alias("_m")).select(key, f"_m.{started}", f"_m.{value}")


def swept(ledger: DataFrame, as_of: Column, most: int, failing: Column) -> DataFrame:
    """The `most` objects (object_key, bytes, expires_at) that expired first, each with whether it was deleted."""
    due = ledger.filter(F.col("expires_at").isNotNull() & F.col("deleted_at").isNull() & (F.col("expires_at") <= as_of)).orderBy("expires_at", "object_key").limit(most)
    return due.withColumn("deleted", ~failing)


def incidents(log: DataFrame) -> DataFrame:
    """Episodes of each key from a log (key, at, seq, action, severity, subject): `raise`, `acknowledge`, `resolve`.

    A raise opens an episode or counts in the open one and replaces its severity and subject; an acknowledgement stays
    open; a resolution closes; the next raise opens a new one. Acknowledgements outside an episode change nothing. One
    row per episode; `notified` is the first raise only. Episodes are numbered by resolutions before each row, summed
    per key and day first, so no key is one task.
    """
    from .events import running_sum

    closes = (F.col("action") == "resolve").cast("int")
    upto = running_sum(log, "key", [F.col("at"), F.col("seq")], F.to_date("at"), closes, "_closed").withColumn("episode", F.col("_closed") - closes)
    raised = F.col("action") == "raise"
    order = F.struct("at", "seq")
    opened = upto.groupBy("key", "episode").agg(
        F.min(F.when(raised, order)).alias("_first"), F.max(F.when(raised, order)).alias("_last"), F.sum(raised.cast("int")).alias("occurrences"),
        F.max_by(F.struct("severity", "subject"), F.when(raised, order)).alias("_shown"), F.max(F.when(F.col("action") == "resolve", F.col("at"))).alias("resolved_at"),
    ).filter("occurrences > 0")
    acks = upto.filter("action = 'acknowledge'").select(F.col("key").alias("_k"), F.col("episode").alias("_e"), order.alias("_o"))
    first = opened.join(acks, (F.col("key") == F.col("_k")) & (F.col("episode") == F.col("_e")) & (F.col("_o") > F.col("_first")), "left").groupBy("key", "episode").agg(F.min("_o.at").alias("acknowledged_at"))
    out = opened.join(first, ["key", "episode"])
    state = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("open")
    return out.select("key", F.col("_first.at").alias("opened_at"), F.col("_last.at").alias("last_seen_at"), "occurrences", "_shown.severity", "_shown.subject", "acknowledged_at", "resolved_at", state.alias("state"), F.col("_first.at").alias("notified_at"))


def progress(checks: DataFrame, part: str, at: str, level: str, bucket: Column) -> DataFrame:
    """Each check with when `level` last rose above that of the check before it; the first check is progress."""
    w = W.partitionBy(part).orderBy(at)
    rose = F.lag(level).over(w).isNull() | (F.col(level) > F.lag(level).over(w))
    return checks.withColumn("_rose", F.when(rose, F.col(at))).withColumn("last_progress", F.max("_rose").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_rose")
