import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm import contributors as c
from tidemill.tables import Scratch


def ranked(spark, data, schema="contributor string, id string, score double, extra int, part int, n long", **kw):
    return {(r["contributor"], r["id"]): r["place"] for r in c.ranked(spark.createDataFrame(data, schema), Scratch(spark, "t"), **kw).collect()}


def test_places_are_exact_with_a_hot_contributor(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 5 + ["b", "c", None]), f"{i:04d}", rng.choice([None, float("nan"), 0.0, -1.0, 1.0, 2.5]), 1, 2, 3) for i in range(900)]
    got = ranked(spark, data)
    for who in {d[0] for d in data}:
        own = [d for d in data if d[0] == who]
        usable = lambda d: d[2] is not None and d[2] == d[2]
        own.sort(key=lambda d: (not usable(d), -d[2] if usable(d) else 0, d[1]))
        for place, d in enumerate(own, 1):
            assert got[who or "", d[1]] == place


def test_reservoir_prefers_the_better_ones_and_is_reproducible(spark):
    data = [("a", f"{i:04d}", 9.0 if i % 2 else 1.0, 0, 0, 0) for i in range(600)]
    first, second = (ranked(spark, data, sharpness=0.55, seed=4) for _ in range(2))
    assert first == second and first != ranked(spark, data, sharpness=0.55, seed=5)
    top = [k for k, place in first.items() if place <= 100]
    share = sum(int(i) % 2 for _, i in top) / 100
    assert 0.9 < share <= 1.0  # the weights are 81 to 1
    even = ranked(spark, [(a, b, 3.0, 0, 0, 0) for a, b, *_ in data], sharpness=2.0)
    share = sum(int(k[1]) % 2 for k, place in even.items() if place <= 200) / 200
    assert 0.35 < share < 0.65


def test_the_separating_sharpness_leaves_nothing_to_the_draw(spark):
    """The keys of the draw itself order as the scores do, whatever is drawn; scores of any sign and closeness."""
    rng = random.Random(3)
    scores = [round(rng.uniform(-5, 10), 2) for _ in range(400)] + [3.0, 3.0 + 1e-9, float("nan"), None]
    df = spark.createDataFrame([("a", f"{i:04d}", s) for i, s in enumerate(scores)], "contributor string, id string, score double")
    sharp = c.separating_sharpness(df, "score", Scratch(spark, "t"))
    assert sharp is not None and sharp >= c.SPREAD / 1e-9 * 0.99
    for seed in (1, 2):
        keyed = df.select("score", c.reservoir_key(F.col("score"), F.col("id"), sharp, seed).alias("key")).filter("key is not null").collect()
        by_key, by_score = sorted(keyed, key=lambda r: r["key"]), sorted(keyed, key=lambda r: r["score"])
        assert [r["score"] for r in by_key] == [r["score"] for r in by_score]
    lows, highs = (-math.log(-math.log((x + 0.5) / (1 << 52))) for x in (0, (1 << 52) - 1))
    assert highs - lows < c.SPREAD - 1


def test_scores_closer_than_doubles_tell(spark):
    data = [("a", f"{i}", 7.0 + i * 2.0**-50, 0, 0, 0) for i in range(9)] + [("a", "x", -1e300, 0, 0, 0), ("a", "y", float("inf"), 0, 0, 0)]
    got = ranked(spark, data)
    assert [k[1] for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == ["y", *[f"{i}" for i in range(8, -1, -1)], "x"]


def test_cap_and_empty(spark):
    df = spark.createDataFrame([("a", str(i), float(i)) for i in range(100)], "contributor string, id string, score double")
    kept = c.cap(df, Scratch(spark, "t"), share=0.05).filter("kept")
    assert sorted(int(r["id"]) for r in kept.collect()) == [95, 96, 97, 98, 99]
    assert c.cap(df.limit(0), Scratch(spark, "t"), most=3).count() == 0
    with pytest.raises(ValueError):
        c.cap(df, Scratch(spark, "t"))


@pytest.mark.parametrize(
    "author",
    ["Zoë Sørvig", "zoë sørvig", "SØRVIG Zoë", "Sørvig, Zoë", "Z. Sørvig", "By Zoe Sorvig", "Words: Zoë\xa0Sørvig.", "Zoë_Sørvig", "Zoë Sørvig (The Site)", "Zoë Sørvig – guest essay", "Zoe Soervig", "Zöe Sörvig", "zoësørvig", "Zoë Sørvigg"],
)
def test_spellings(author):
    assert c.Resolver(["Zoë Hallbrine", "Zoë Sørvig", "Anna Zorvik"]).resolve(author) == "Zoë Sørvig"


def test_unknown_authors():
    assert c.Resolver(["Zoë Sørvig"]).resolve("Karl Unbekannt") is None
    assert c.Resolver([]).resolve("x") is None and c.Resolver(["A B"]).resolve("???") is None


def test_contributors_of_rows(spark):
    sources = spark.createDataFrame([("s", ["Zoë Sørvig"]), ("t", ["Zoë Sørvig", "Ann Lee"]), ("u", None)], "id string, author_scope array<string>")
    rows = [
        ("1", "s", "Z. Sørvig", 1.0, "2026-01-01"), ("1", "s", "Other", 2.0, "2025-01-01"), ("2", "t", "zoe sorvig", 1.0, "2026-01-01"), ("3", "t", " ", 1.0, "2026-01-01"),
        ("4", "u", None, 1.0, None), ("5", None, "Some One", None, "2026-01-01"), (None, "s", "x", 1.0, "2026-01-01"), ("6", "gone", None, 1.0, "2026-01-01"),
    ]
    arts = spark.createDataFrame(rows, "id string, source_id string, author string, intrinsic_score double, at string").withColumn("analyzed_at", F.to_timestamp("at"))
    got = {r["id"]: r["contributor"] for r in c.with_contributor(arts, sources).collect()}
    assert got == {"1": "Zoë Sørvig", "2": "Zoë Sørvig", "3": "t", "4": "u", "5": "some one", "6": "gone"}
    assert c.with_contributor(arts.limit(0), sources.limit(0)).count() == 0
