import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import events, learning, planning, ranking, relations as rel

from .conftest import rows


def test_latest_breaks_ties_and_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 9, "n"), ("b", None, "q")], "k string, v int, s string")
    assert rows(rel.latest(df, "k", [F.col("v")])) == [("a", 2, "z"), ("b", None, "q")]
    assert rows(rel.earliest(df, "k", ["v"])) == [("a", 1, "x"), ("b", None, "q")]
    assert rel.latest(df.limit(0), "k", [F.col("v")]).count() == 0


def test_page_and_look_ahead(spark):
    df = spark.range(45)
    first, last = rel.page(df, [F.col("id")], 1, 20), rel.page(df, [F.col("id")], 3, 20)
    assert first.count() == 20 and first.first()["has_next"] and last.count() == 5 and not last.first()["has_next"]
    assert rel.page(df, [F.col("id")], 4, 20).count() == 0


def test_sets_and_snapshots(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "c", 7), (3, None, 8)], "k int, s string, n int")
    assert rows(rel.upserted(old, new, "k")) == [(1, "a", None), (2, "c", 7), (3, None, 8)]
    assert rows(rel.upserted(old, new, "k", prefer_old=["n"])) == [(1, "a", None), (2, "c", 5), (3, None, 8)]
    assert rows(rel.inserted(old, new, "k")) == [(1, "a", None), (2, "b", 5), (3, None, 8)]
    df = spark.createDataFrame([("u", 3), ("u", 1), (None, 2), (None, 4)], "k string, place int")
    assert rows(rel.first_of_each(df, "k", "place")) == [("u", 1), (None, 2), (None, 4)]


def test_winner_takes_the_slot_once(spark):
    df = spark.createDataFrame([("d", 2, "late"), ("d", 1, "early"), ("e", 5, "only")], "slot string, at int, who string")
    assert rows(rel.winners(df, "slot", [F.col("at")]).select("who", "won")) == [("early", True), ("late", False), ("only", True)]


def greedy(items, limit, per_author, per_theme):
    got = []
    for i in items:
        if len(got) < limit and sum(g[1] == i[1] for g in got) < per_author and sum(g[2] == i[2] for g in got) < per_theme:
            got.append(i)
    return [g[0] for g in got]


@pytest.mark.parametrize("seed", range(12))
def test_diverse_top_is_the_greedy_choice(spark, seed):
    rng = random.Random(seed)
    authors, themes = rng.choice([(2, 2), (5, 3), (3, 40), (40, 2), (60, 60)])
    items = [(f"{i:03d}", f"a{rng.randrange(authors)}", f"t{rng.randrange(themes)}", float(rng.randrange(20)), 1.0) for i in range(300)]
    df = spark.createDataFrame(items, "id string, author string, theme string, dynamic double, intrinsic double")
    order = sorted(items, key=lambda i: (-i[3], -i[4], i[0]))
    caps = rng.choice([(10, 2, 3), (4, 2, 9), (7, 3, 1)])
    got = [r["id"] for r in ranking.diverse_top(df, *caps).orderBy("place").collect()]
    assert got == greedy(order, *caps)


def test_freshness_and_fatigue_against_a_plain_rule(spark):
    rng = random.Random(21)
    at = dt.datetime(2024, 3, 9, 13, 20, tzinfo=dt.UTC)
    now = F.timestamp_micros(F.lit(int(at.timestamp() * 1e6)))
    ages = [rng.uniform(-2, 45) for _ in range(80)]
    df = spark.createDataFrame([((at - dt.timedelta(days=a)),) for a in ages], "p timestamp")
    steps = lambda a: next((v for most, v in ((3, 0.8), (7, 0.64), (14, 0.4), (30, 0.16)) if a <= most), 0.0)
    assert [r[0] for r in df.select(ranking.freshness(F.col("p"), now)).collect()] == [steps(a) for a in ages]
    assert spark.range(1).select(ranking.freshness(F.lit(None).cast("timestamp"), now)).first()[0] == 0.0
    items = [(rng.choice("pqrs"), rng.choice("xyz"), (at - dt.timedelta(days=rng.randrange(3, 40))).date()) for _ in range(40)]
    h = spark.createDataFrame(items, "author string, theme string, day date")
    age = lambda d: (at - (dt.datetime(d.year, d.month, d.day, tzinfo=dt.UTC) - dt.timedelta(hours=8))).total_seconds() / 86400
    part = lambda a: 1.25 if a <= 3 else 0.65 if a <= 7 else 0.2 if a <= 14 else 0.0
    for who, penalty in rows(ranking.author_fatigue(h, now)):
        own = [age(d) for a, _, d in items if a == who]
        assert penalty == (100.0 if min(own) < 2 else pytest.approx(sum(map(part, own)), abs=1e-3))
    for theme, penalty, bonus in rows(ranking.theme_fatigue(h, now)):
        own = [age(d) for _, t, d in items if t == theme]
        assert penalty == pytest.approx(0.35 * sum(a <= 7 for a in own), abs=1e-3) and bonus == (0.2 if len(own) == 1 else 0.0)


def test_signals_without_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "id string, vec array<double>")
    from tidemill.functions.vectors import cosine

    assert rows(ranking.semantic_signals(df, [], cosine)) == [("a", 0.0, 0.0, 0.2), ("b", 0.0, 0.0, 0.0)]
    got = rows(ranking.semantic_signals(df, [[1.0, 1.0]], cosine))
    assert got[0][2] == pytest.approx((0.5**0.5 - 0.25) * 0.65) and got[1] == ("b", 0.0, 0.0, 0.0)


def pages_by_hand(depth, most=5):
    """Page 1, then as many of the last pages as there is room for."""
    return list(range(1, depth + 1)) if depth <= most else [1, *range(depth - most + 2, depth + 1)]


def test_pages_against_a_plain_rule(spark):
    rng = random.Random(11)
    cases = [(rng.randrange(1, 130), rng.randrange(0, 25)) for _ in range(60)]
    df = spark.createDataFrame(cases, "d int, p int")
    for (d, p), r in zip(cases, df.select(planning.page_window(F.col("d")).alias("w"), planning.next_depth(F.col("d"), F.col("p")).alias("n")).collect()):
        assert r["w"] == pages_by_hand(d) and r["n"] == (min(d + 2, 100) if p < 10 else d)


def chosen_by_hand(sources, count):
    """The best with work, then the longest unseen of all others, then the best again, then the rest by age."""
    left = dict(sources)
    out = []
    def take(keys):
        for k in keys:
            if len(out) < count and k in left:
                out.append(k)
                del left[k]
    best = sorted((k for k, s in left.items() if s[0]), key=lambda k: (-left[k][1], k))
    take(best[: max(1, count - 1)])
    take(sorted(left, key=lambda k: (left[k][2], k))[:1])
    take(best)
    take(sorted(left, key=lambda k: (left[k][2], k)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sources_against_a_plain_rule(spark, seed):
    rng = random.Random(seed)
    sources = {f"s{i:02d}": (rng.choice([0, 3]), rng.randrange(20) / 20, f"2026-02-{rng.randrange(1, 28):02d}") for i in range(rng.choice([2, 5, 17]))}
    df = spark.createDataFrame([(k, *v) for k, v in sources.items()], "id string, pending int, score double, last_scanned_at string")
    count = rng.choice([1, 3, 6])
    assert [r["id"] for r in planning.exploit_explore(df, count).orderBy("place").collect()] == chosen_by_hand(sources, count)


def test_streaks(spark):
    days = {"four": ["2026-01-04", "2026-01-03", "2026-01-02", "2026-01-01"], "gap": ["2026-01-04", "2026-01-03", "2026-01-01"], "twice": ["2026-01-04", "2026-01-04", "2026-01-03"]}
    df = spark.createDataFrame([(k, d) for k, v in days.items() for d in v] + [("none", None)], "k string, d string").withColumn("d", F.to_date("d"))
    assert rows(events.newest_streak(df, "k", "d").select("k", "streak")) == [("four", 4), ("gap", 2), ("twice", 2)]


def test_running_sum_by_buckets_is_a_plain_running_sum(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "cold", None]), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, at int, v int")
    got = {(r["k"], r["at"]): r["s"] for r in events.running_sum(df, "k", [F.col("at")], F.floor(F.col("at") / 37), F.col("v"), "s").collect()}
    sums, want = {}, {}
    for k, at, v in data:
        sums[k] = sums.get(k, 0) + v
        want[k, at] = sums[k]
    assert got == want


def test_episodes(spark):
    base = dt.datetime(2026, 1, 1)
    seq = ["error", "error", "purchase", "purchase", "click", "error"]
    df = spark.createDataFrame([(1, base + dt.timedelta(hours=30 * i), i, s) for i, s in enumerate(seq)], "k long, ts timestamp, event_id int, kind string")
    got = events.episodes(df, "k", ["ts", "event_id"], F.col("kind") == "error", F.col("kind") == "purchase").select("occurrences", "state")
    assert rows(got) == [(1, "open"), (2, "closed")]


def test_ridge(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(60), rng.normal(size=(60, 3))])
    y = x @ [0.5, 1.0, -2.0, 0.0] + rng.normal(size=60) * 0.01
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)] + [(None, 1.0), ([1.0] * 4, None)], "x array<double>, y double")
    xx, xy, n = learning.gram(df, "x", "y", 4)
    assert n == 60 and np.allclose(xx, x.T @ x) and np.allclose(xy, x.T @ y)
    p = np.diag([0, 2.5, 2.5, 2.5])
    assert np.allclose(learning.ridge(xx, xy), np.linalg.solve(x.T @ x + p, x.T @ y))
    assert [learning.influence(n) for n in (9, 10, 250)] == [0.0, 0.05, 0.3]


def test_feature_hash_embedding(spark):
    df = spark.createDataFrame([(1, "risk", "risk and return"), (2, None, None), (3, "risk", "risk and return"), (4, "zebra", "quite other words")], "id int, t string, x string")
    v = {r["id"]: np.array(r["vec"]) for r in learning.feature_hash_embedding(df, "id", "t", "x", 64).collect()}
    assert np.allclose(v[1], v[3]) and abs(np.linalg.norm(v[1]) - 1) < 1e-12 and not v[2].any() and v[1] @ v[4] < 0.9
