"""Feedback on articles: all of it in one view, the latest reaction, labels, and when a model is trained anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# What each reaction is worth; `later` is no sample.
LABELS = {"valuable": 1.0, "good": 0.35, "not_for_me": -1.0, "unfinished": -0.45}
LEAST_SAMPLES = 10


def all_feedback(parts: Sequence[tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """article_id, created_at, kind, origin. Each part: feedback (recommendation_id, created_at, kind), what was
    recommended (recommendation_id, article_id) and a name; feedback on what was never recommended is dropped."""
    out = None
    for given, recommended, origin in parts:
        named = given.join(recommended, "recommendation_id").select("article_id", "created_at", "kind", F.lit(origin).alias("origin"))
        out = named if out is None else out.unionByName(named)
    return out


def latest_feedback(feedback: DataFrame, *per: str) -> DataFrame:
    """The last reaction on each article (by the columns `per` too), ties by kind; a later one hides an older one."""
    keys = ["article_id", *per]
    best = F.max(F.struct("created_at", "kind")).alias("m")
    return feedback.groupBy(*keys).agg(best).select(*keys, "m.created_at", "m.kind")


def label(kind: Column) -> Column:
    out = None
    for name, value in LABELS.items():
        out = F.when(kind == name, F.lit(value)) if out is None else out.when(kind == name, F.lit(value))
    return out


def labelled(feedback: DataFrame) -> DataFrame:
    """With `label`; reactions without one (later, unknown, null) are no samples."""
    return feedback.withColumn("label", label(F.col("kind"))).filter("label is not null")


def registry(runs: DataFrame) -> DataFrame:
    """Training runs (run, samples, through): trained if there are enough samples and they differ from the last run's,
    reused if they don't; the newest trained model is the active one. One row a run."""
    w = W.partitionBy(F.lit(0)).orderBy("run")
    reused = F.coalesce((F.col("samples") == F.lag("samples").over(w)) & (F.col("through") == F.lag("through").over(w)), F.lit(False))
    out = runs.withColumn("reused", reused).withColumn("trained", (F.col("samples") >= LEAST_SAMPLES) & ~F.col("reused"))
    newest = F.max(F.when(F.col("trained"), F.col("run"))).over(W.partitionBy(F.lit(0)))
    return out.withColumn("active", F.col("trained") & F.coalesce(F.col("run") == newest, F.lit(False)))
