import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import feedback as fb, snapshots as snap

from .conftest import rows

DAY = dt.datetime(2026, 1, 5, tzinfo=dt.UTC)


def test_transitions_leave_settled_rows(spark):
    old = spark.createDataFrame([("a", "discovered", 0, None, DAY), ("b", "blocked", 1, "x", DAY), ("c", "analysis_failed", 2, "e", DAY), ("d", "ready", 0, None, DAY), ("e", "rejected", 0, "empty_body", DAY)], "id string, status string, retry_count int, rejection_reason string, updated_at timestamp")
    new = spark.createDataFrame([("a", "ready", None), ("b", "ready", None), ("c", "failed", "y" * 900), ("e", "failed", ""), ("unknown", "ready", None)], "id string, outcome string, reason string")
    got = {r["id"]: r for r in snap.transition(old, new, F.lit("2026-02-01").cast("timestamp")).collect()}
    assert set(got) == set("abcde") and [got[k]["status"] for k in "abcde"] == ["ready", "blocked", "analysis_failed", "ready", "analysis_failed"]
    assert got["c"]["retry_count"] == 3 and len(got["c"]["rejection_reason"]) == 500 and got["e"]["rejection_reason"] == "unknown_error" and got["b"]["rejection_reason"] == "x"
    fit = old.select("id", snap.processable(F.col("status"), F.col("retry_count"), F.col("rejection_reason")).alias("p"))
    assert {r["id"] for r in fit.collect() if r["p"]} == {"a", "c", "e"}


def test_bodies_are_saved_once(spark):
    known = spark.createDataFrame([("a", "h1"), ("b", "h2")], "id string, hash string")
    new = spark.createDataFrame([("a", "h3", 5, DAY), ("b", "h2", 6, DAY), ("c", "h1", 7, DAY), ("d", "h9", 8, DAY + dt.timedelta(1)), ("e", "h9", 8, DAY)], "id string, hash string, bytes int, at timestamp")
    got = {r["id"]: (r["duplicate_of"], r["object_key"], r["expired_key"]) for r in snap.saved_bodies(known, new).collect()}
    assert got == {"a": (None, "articles/a/h3.txt", "articles/a/h1.txt"), "b": (None, "articles/b/h2.txt", None), "c": ("a", None, None), "d": ("e", None, None), "e": (None, "articles/e/h9.txt", None)}


def test_a_slot_is_won_once(spark):
    claims = spark.createDataFrame([("m", 2, "late"), ("m", 1, "first"), ("n", 1, "too late"), ("o", 5, "only")], "slot string, at int, run string")
    taken = spark.createDataFrame([("n",)], "slot string")
    got = {r["run"]: (r["won"], r["run_status"]) for r in snap.arbitrated(claims, "slot", ["at"], taken).collect()}
    assert got == {"late": (False, "degraded"), "first": (True, "complete"), "too late": (False, "degraded"), "only": (True, "complete")}


def test_the_newest_observer_holds_the_state(spark):
    w = spark.createDataFrame([("k", 1, "old"), ("k", 5, "new"), ("k", 3, "late write of an older one"), ("l", 1, None)], "key string, started int, value string")
    assert rows(snap.latest_state(w, "key", "started", "value")) == [("k", 5, "new"), ("l", 1, None)]


def test_sweep_is_bounded_and_ordered(spark):
    led = spark.createDataFrame([(f"k{i}", 10 * i, DAY + dt.timedelta(days=-i), None) for i in range(6)] + [("never", 1, None, None), ("gone", 1, DAY, DAY), ("due later", 1, DAY + dt.timedelta(9), None)], "object_key string, bytes int, expires_at timestamp, deleted_at timestamp")
    got = snap.swept(led, F.lit(DAY), 3, F.col("object_key") == "k4").collect()
    assert sorted((r["object_key"], r["deleted"]) for r in got) == [("k3", True), ("k4", False), ("k5", True)]


def incidents_by_hand(log):
    out, live = [], {}
    for key, at, seq, action, severity, subject in sorted(log, key=lambda r: (r[1], r[2])):
        e = live.get(key)
        if action == "raise":
            e = live.setdefault(key, dict(key=key, opened=at, n=0, ack=None, resolved=None))
            e.update(n=e["n"] + 1, last=at, severity=severity, subject=subject)
        elif action == "acknowledge" and e and e["ack"] is None:
            e["ack"] = at
        elif action == "resolve" and e:
            out.append(live.pop(key) | {"resolved": at})
    return sorted((e["key"], e["opened"], e["last"], e["n"], e["severity"], e["subject"], e["ack"], e["resolved"]) for e in [*out, *live.values()])


@pytest.mark.parametrize("seed", range(3))
def test_incidents_against_a_plain_fold(spark, seed):
    import random

    rng = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    log = [(rng.choice(["hot", "hot", "cold"]), start + dt.timedelta(hours=rng.randrange(200)), i, rng.choice(["raise", "raise", "acknowledge", "resolve"]), rng.choice(["warning", "critical"]), f"s{i}") for i in range(150)]
    df = spark.createDataFrame(log, "key string, at timestamp, seq int, action string, severity string, subject string")
    got = snap.incidents(df)
    assert sorted((r["key"], r["opened_at"], r["last_seen_at"], r["occurrences"], r["severity"], r["subject"], r["acknowledged_at"], r["resolved_at"]) for r in got.collect()) == incidents_by_hand(log)
    assert snap.incidents(df.limit(0)).count() == 0


def test_feedback_and_registry(spark):
    given = spark.createDataFrame([("r1", 1, "valuable"), ("r1", 3, "later"), ("r2", 2, "good"), ("r9", 2, "good")], "recommendation_id string, created_at int, kind string")
    recs = spark.createDataFrame([("r1", "a"), ("r2", "b")], "recommendation_id string, article_id string")
    every = fb.all_feedback([(given, recs, "public"), (given.limit(0), recs, "simulation")])
    assert rows(fb.labelled(fb.latest_feedback(every))) == [("b", 2, "good", 0.35)]
    runs = spark.createDataFrame([(0, 4, 1), (1, 12, 5), (2, 12, 5), (3, 13, 6), (4, 13, 6)], "run int, samples int, through int")
    got = {r["run"]: (r["trained"], r["reused"], r["active"]) for r in fb.registry(runs).collect()}
    assert got == {0: (False, False, False), 1: (True, False, False), 2: (False, True, False), 3: (True, False, True), 4: (False, True, False)}
