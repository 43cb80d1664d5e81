"""Mixing sources to target weights.

Shares are tempered along an exponent: `blend(natural, target, e)` is natural^(1-e) * target^e, normalised, so e = 1
gives the targets and e = 0 the shares the sources have by themselves; `temper(natural, e)` is natural^e. The exponent
is bisected to meet the repetition limits or a target entropy. The plan is made from one row per source; only the
table of targets (its size is checked) and its counts reach the driver. Realising a plan takes whole passes over a
source plus one partial pass over a permutation of hash blocks: block sums are cumulated per source, and only the block
in which the budget ends is ordered inside.

Defined cases: sources compare in lower case without outer blanks; documents without source count towards the total
only; null and empty texts have 0 tokens; a source of the targets without documents has limit 0; several targets of one
source: the one with the greatest share, then the most repeats, holds; null or negative shares and repeats count as 0;
no tokens at all: nothing is short or used, shares are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..tables import Scratch, size_checked
from . import tokens

MOST_TARGETS = 10_000
BISECTIONS = 60


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def normalised(weights: list[float]) -> list[float]:
    total = sum(weights)
    return [w / total if total > 0 else 0.0 for w in weights]


def temper(shares: list[float], exponent: float) -> list[float]:
    return normalised([s**exponent if s > 0 else 0.0 for s in shares])


def blend(natural: list[float], target: list[float], exponent: float) -> list[float]:
    return normalised([0.0 if s <= 0 or (t <= 0 and exponent > 0) else s ** (1 - exponent) * t**exponent for s, t in zip(natural, target)])


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def exponent_for_entropy(natural: list[float], wanted: float) -> float:
    """The exponent in [0, 1] at which the tempered shares have `wanted` entropy; entropy falls as it grows."""
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(temper(natural, middle)) > wanted else (low, middle)
    return (low + high) / 2


def fitting_exponent(natural: list[float], target: list[float], budget: float, limits: list[float], bound: list[int]) -> float:
    """The greatest exponent in [0, 1] at which none of the sources `bound` needs more than its limit; 0 if even that exceeds
    one, 1 only if the targets themselves fit. A source without tokens needs its target share, which nothing can give."""

    def fits(e: float) -> bool:
        mixed = blend(natural, target, e) if e < 1 else target
        return all(mixed[i] * budget <= limits[i] * (1 + 1e-12 * (e < 1)) for i in bound)

    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def exponent_for_limits(natural: list[float], target: list[float], budget: float, limits: list[float]) -> float:
    """The greatest exponent in [0, 1] at which no source with tokens needs more than its limit."""
    return fitting_exponent(natural, normalised(target), budget, limits, [i for i, s in enumerate(natural) if s > 0])


PLAN = "source string, target_share double, max_repeats int, documents long, tokens long, total_tokens long, limit_tokens long, wanted_tokens double, own_exponent double, short boolean, exponent double, tempered_share double, entropy_exponent double, budget_tokens long"


def plan(counted: DataFrame, targets: DataFrame, source: str = "source", count: str = "tokens", tempered: bool = False) -> DataFrame:
    """One row per target source. `counted` has a source and a token count for each document.

    `wanted_tokens` is the target share of all tokens of the corpus and `budget_tokens` the lesser of that and the
    limit. `own_exponent` is how far the mix can be tempered from the natural to the target shares of the whole corpus
    before this source alone meets its repetition limit; a source is short if that is before its target. With `tempered` the budget is the tokens the target sources hold, shared at the exponent that meets the limits.
    """
    spark = counted.sparkSession
    by = counted.groupBy(source_key(F.col(source)).alias("_s")).agg(F.count(F.lit(1)).alias("documents"), F.sum(count).alias("tokens"))
    wanted = (
        targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("int").alias("max_repeats"))
        .filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.struct("target_share", "max_repeats")).alias("_t"))
        .select("source", "_t.*")
    )
    # One row per source of the corpus may be many; the total is one number and the rest is cut to the targets' sources.
    by = by.withColumn("_target", F.col("_s").isNotNull())
    joined = by.join(size_checked(wanted, MOST_TARGETS), by["_s"] == wanted["source"], "left")
    rows = joined.groupBy("source", "target_share", "max_repeats").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).collect()  # a row per target
    total = sum(r["tokens"] or 0 for r in rows)
    have = {r["source"]: r for r in rows if r["source"] is not None}
    goals = sorted(wanted.collect(), key=lambda r: r["source"])
    held = [(have[g["source"]]["documents"], have[g["source"]]["tokens"] or 0) if g["source"] in have else (0, 0) for g in goals]
    natural, share = normalised([float(t) for _, t in held]), [g["target_share"] for g in goals]
    limits = [g["max_repeats"] * t for g, (_, t) in zip(goals, held)]
    own = sum(t for _, t in held)
    e = exponent_for_limits(natural, share, own, limits)
    mixed, h = blend(natural, share, e), exponent_for_entropy(natural, entropy(normalised(share)))
    out = []
    for i, (g, (docs, toks), limit, m) in enumerate(zip(goals, held, limits, mixed)):
        want = g["target_share"] * total
        own_exponent = fitting_exponent(natural, share, total, limits, [i])
        budget = min(int(m * own if tempered else want), limit)
        out.append((g["source"], g["target_share"], g["max_repeats"], docs, toks, total, limit, want, own_exponent, own_exponent < 1, e, m, h, budget))
    return spark.createDataFrame(out, PLAN)


def realise(counted: DataFrame, planned: DataFrame, id: str = "doc_id", source: str = "source", count: str = "tokens", seed: int = 7) -> DataFrame:
    """`id`, source, tokens and `repeats` (how often each document is used) of all documents used at least once."""
    documents = counted.count()
    blocks = min(1 << 16, max(16, documents // 4096))
    order = F.xxhash64(F.col(id), F.lit(seed))
    docs = counted.select(F.col(id).alias("_id"), source_key(F.col(source)).alias("_s"), F.col(count).alias("_n"), order.alias("_h"), F.pmod(order, F.lit(blocks)).alias("_b")).filter("_n > 0 and _s is not null")
    p = planned.select(F.col("source").alias("_s"), F.floor(F.col("budget_tokens") / F.greatest("tokens", F.lit(1))).alias("_passes"), "budget_tokens", "tokens").withColumn("_rest", F.col("budget_tokens") - F.col("_passes") * F.col("tokens")).drop("budget_tokens", "tokens")
    p = size_checked(p, MOST_TARGETS)
    docs = docs.join(p, "_s")
    sums = docs.groupBy("_s", "_b").agg(F.sum("_n").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(W.partitionBy("_s").orderBy("_b")) - F.col("_sum"))
    placed = docs.join(sums, ["_s", "_b"])
    whole = placed.filter("_before + _sum <= _rest").withColumn("_extra", F.lit(1))
    cut = placed.filter("_before < _rest and _before + _sum > _rest")
    inside = W.partitionBy("_s", "_b").orderBy("_h", "_id").rowsBetween(W.unboundedPreceding, 0)
    cut = cut.withColumn("_extra", (F.col("_before") + F.sum("_n").over(inside) <= F.col("_rest")).cast("int"))
    rest = placed.filter("_before >= _rest").withColumn("_extra", F.lit(0))
    out = whole.unionByName(cut).unionByName(rest).withColumn("repeats", (F.col("_passes") + F.col("_extra")).cast("int"))
    return out.filter("repeats > 0").select(F.col("_id").alias(id), F.col("_s").alias("source"), F.col("_n").alias("tokens"), "repeats")


def reached(realised: DataFrame, planned: DataFrame) -> DataFrame:
    """The plan with the tokens really used, their share of the mix and of the corpus."""
    used = realised.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.sum("repeats").alias("used_documents"), F.max("repeats").alias("most_repeats"))
    out = planned.join(used, "source", "left").fillna(0, ["used_tokens", "used_documents", "most_repeats"])
    whole = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))  # one row per target
    return out.withColumn("share_of_mix", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0)).withColumn("share_of_corpus", F.when(F.col("total_tokens") > 0, F.col("used_tokens") / F.col("total_tokens")).otherwise(0.0))


def counted_documents(documents: DataFrame, scratch: Scratch, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, source and tokens of each document, encoded once and kept for the plan and its realisation."""
    return scratch.cut(tokens.count(documents.select("doc_id", "source", "text"), vocabulary=vocabulary))
