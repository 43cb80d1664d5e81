"""Scoring of candidates against a history, and diverse selection."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import age_days, day_start
from ..functions.hashing import jitter
from ..functions.numbers import clamp, round3, steps

# Weights of the five dimensions.
WEIGHTS = {"long_term_value": 0.3, "idea_density": 0.25, "argument_quality": 0.2, "originality": 0.15, "clarity_structure": 0.1}


def weighted_score() -> Column:
    parts = [F.col(c) * w for c, w in WEIGHTS.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return round3(total)


def freshness(published: Column, now: Column) -> Column:
    age = F.greatest(F.lit(0.0), age_days(published, now))
    return F.when(published.isNull(), 0.0).otherwise(steps(age, [(3, 0.8), (7, 0.64), (14, 0.4), (30, 0.16)], 0.0))


def author_fatigue(history: DataFrame, now: Column) -> DataFrame:
    """Per author of the history: 100 if any item is younger than two days, else a sum that falls with age."""
    age = age_days(day_start(F.col("day")), now)
    share = F.when(age <= 3, 1.25).when(age <= 7, 0.65).when(age <= 14, 0.2).otherwise(0.0)
    return history.groupBy("author").agg(F.max(age < 2).alias("_recent"), F.sum(share).alias("_sum")).select("author", F.when(F.col("_recent"), 100.0).otherwise(round3(F.col("_sum"))).alias("author_penalty"))


def theme_fatigue(history: DataFrame, now: Column) -> DataFrame:
    """Per theme: a penalty for each item of the last seven days, a bonus for themes seen at most once at all."""
    recent = age_days(day_start(F.col("day")), now) <= 7
    counted = history.groupBy("theme").agg(F.sum(recent.cast("int")).alias("_recent"), F.count(F.lit(1)).alias("_all"))
    return counted.select("theme", round3(F.col("_recent") * 0.35).alias("theme_penalty"), F.when(F.col("_all") == 1, 0.2).otherwise(0.0).alias("exploration"))


def ranked(candidates: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Candidates (id, author, theme, published_at, intrinsic) with all parts of their score; the history is small
    but joined by key, so it may grow."""
    joined = candidates.join(author_fatigue(history, now), "author", "left").join(theme_fatigue(history, now), "theme", "left")
    out = joined.withColumns({
        "fresh": freshness(F.col("published_at"), now),
        "author_penalty": F.coalesce("author_penalty", F.lit(0.0)),
        "theme_penalty": F.coalesce("theme_penalty", F.lit(0.0)),
        "exploration": F.least(F.lit(0.75), F.coalesce("exploration", F.lit(0.45)) + (F.col("semantic_exploration") if "semantic_exploration" in candidates.columns else F.lit(0.0))),
    })
    personal = clamp(F.col("personal_fit"), -0.9, 0.9) if "personal_fit" in candidates.columns else F.lit(0.0)
    connection = clamp(F.col("connection"), 0.0, 0.5) if "connection" in candidates.columns else F.lit(0.0)
    return out.withColumn("dynamic", round3(F.col("intrinsic") + F.col("fresh") + F.col("exploration") + personal + connection - F.col("author_penalty") - F.col("theme_penalty")))


def rank_order() -> list[Column]:
    return [F.col("dynamic").desc(), F.col("intrinsic").desc(), F.col("id").asc()]


def with_jitter(df: DataFrame, day: str, span: float = 0.3) -> DataFrame:
    return df.withColumn("jitter", jitter(F.concat(F.lit(f"{day}:"), "id"), span)).withColumn("shown", round3(F.col("dynamic") + F.col("jitter")))


def diverse_top(df: DataFrame, limit: int = 10, per_author: int = 2, per_theme: int = 3) -> DataFrame:
    """Greedy choice in rank order under two caps.

    The choice itself is sequential, so what it can need is bounded first, without loss. Both caps only tighten: of one
    author and theme only the first min(caps) rows can get in. A row is passed over only while its theme or author is
    full; at most limit / per_theme themes and limit / per_author authors ever are, which bounds the rows of one author
    and of one theme that can matter, and with them the rows at all. Each bound is a partial top-k.
    """
    least = min(per_author, per_theme)
    of_author = per_author + least * (limit // per_theme)
    of_theme = per_theme + least * (limit // per_author)
    pruned = df
    for part, most in ((("author", "theme"), least), (("author",), of_author), (("theme",), of_theme)):
        w = W.partitionBy(*part).orderBy(*rank_order())
        pruned = pruned.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    pruned = pruned.orderBy(*rank_order()).limit(limit + (limit // per_author) * of_author + (limit // per_theme) * of_theme)
    item = F.struct((-F.col("dynamic")).alias("a"), (-F.col("intrinsic")).alias("b"), F.col("id").alias("id"), F.col("author").alias("author"), F.col("theme").alias("theme"))
    kind = "array<struct<a:double,b:double,id:string,author:string,theme:string>>"
    folded = pruned.agg(F.sort_array(F.collect_list(item)).alias("rows")).select(
        F.aggregate(
            "rows",
            F.array().cast(kind),
            lambda got, r: F.when(
                (F.size(got) < limit) & (F.size(F.filter(got, lambda g: g["author"].eqNullSafe(r["author"]))) < per_author) & (F.size(F.filter(got, lambda g: g["theme"].eqNullSafe(r["theme"]))) < per_theme),
                F.concat(got, F.array(r)),
            ).otherwise(got),
        ).alias("got")
    )
    return folded.select(F.posexplode("got").alias("place", "r")).select((F.col("place") + 1).alias("place"), "r.id", "r.author", "r.theme", (-F.col("r.a")).alias("dynamic"), (-F.col("r.b")).alias("intrinsic"))


def semantic_signals(candidates: DataFrame, recent: list[list[float]], similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """`id`, greatest similarity of `vec` to the recent vectors (a handful, given as values) and the two bonuses drawn from it."""
    vectors = F.from_json(F.lit(json.dumps(recent)), "array<array<double>>")
    known = candidates.withColumn("similarity", F.when(F.col("vec").isNull(), 0.0).otherwise(F.array_max(F.transform(vectors, lambda r: similarity(F.col("vec"), r))))) if recent else candidates.withColumn("similarity", F.lit(0.0))
    s = F.col("similarity")
    connection = F.when(F.col("vec").isNull() | F.lit(not recent), 0.0).when(s.between(0.25, 0.82), F.least(F.lit(0.35), (s - 0.25) * 0.65)).otherwise(0.0)
    explore = F.when(F.col("vec").isNull(), 0.0).when(F.lit(not recent), 0.2).when(s < 0.2, 0.3).when(s < 0.35, 0.15).otherwise(0.0)
    return known.select("id", s, connection.alias("connection"), explore.alias("semantic_exploration"))
