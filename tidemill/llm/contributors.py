"""Capping records per dominant contributor.

Quality-weighted reservoir sampling without replacement: a record of score s has the weight exp(sharpness * s) and gets
the key weight / E with E exponential, drawn from a hash; each contributor keeps the cap-size largest keys. In logarithms
the key is sharpness * s - ln(E), so any finite score has a weight. As the sharpness grows the draw counts less, and
there is a sharpness from which on it can't change the order of different scores: the draws of 52 bits lie within
SPREAD of each other, so it is SPREAD over the least gap between scores, which is measured on all scores
(`separating_sharpness`). With it, and draws shared by records of equal score (`shared`), the best-scored stay and equal
ones go by smaller id. Where scores lie closer than doubles can tell after that scaling, the score itself comes first.

Ranks are taken without one task per contributor: records are range-partitioned by contributor and key, counted per
partition, and ranked as offset of the partition plus place inside it. A contributor with a third of all rows is spread
over a third of the partitions.

Defined cases: null and NaN scores have no weight and come last, by smaller id; ties go to the smaller id; null
contributors form one contributor named ''; rows without id are dropped; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..tables import Scratch, latest_rows, size_checked

MOST_SOURCES = 100_000
# Letters that Unicode does not decompose, with their plain spelling.
PLAIN_LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i"})
UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ø": "oe", "Ø": "Oe", "å": "aa", "Å": "Aa"})


def folded(text: str) -> list[str]:
    """The words of a name without accents and case."""
    plain = unicodedata.normalize("NFKD", text.translate(PLAIN_LETTERS))
    return re.findall(r"[^\W\d_]+", "".join(c for c in plain if not unicodedata.combining(c)).casefold())


def spellings(text: str) -> tuple[set[str], set[str]]:
    return set(folded(text)), set(folded(unicodedata.normalize("NFC", text).translate(UMLAUTS)))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Resolver:
    """Names of one scope; `resolve` gives the name an author string stands for, or None."""

    def __init__(self, scope: list[str]):
        self.names = [(name, words) for name in scope if name and (words := folded(name))]
        self.known: dict[str, str | None] = {}

    def resolve(self, author: str) -> str | None:
        if author not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[author] = self._resolve(author)
        return self.known[author]

    def _resolve(self, author: str) -> str | None:
        plain, other = spellings(author)
        for have in (plain, other):  # all words of the name
            if hits := [n for n, w in self.names if set(w) <= have]:
                return max(hits, key=len)
        both = plain | other
        for n, w in self.names:  # initial and surname
            if set(w[1:]) <= both and len(w) > 1 and w[0][0] in both:
                return n
        joined = "".join(folded(author))
        for n, w in self.names:  # words run together
            if "".join(w) in joined or "".join(w[1:] + w[:1]) in joined:
                return n
        close = sorted((max(min(edits(x, y) for y in both) / len(x) for x in w), i) for i, (n, w) in enumerate(self.names)) if both else []
        if close and close[0][0] <= 0.25 and (len(close) == 1 or close[1][0] > close[0][0]):
            return self.names[close[0][1]][0]
        last = [n for n, w in self.names if w[-1] in both]
        return last[0] if len(last) == 1 else None


@F.pandas_udf(T.StringType())
def contributor_name(author: pd.Series, scope: pd.Series, source: pd.Series) -> pd.Series:
    """The scope's name for the author; source if there is no author; the folded author if no name fits."""
    resolvers: dict[tuple, Resolver] = {}
    out = []
    for a, s, i in zip(author, scope, source):
        if a is None or not a.strip():
            out.append(i or "")
            continue
        names = tuple(s) if s is not None else ()
        if names not in resolvers:
            resolvers[names] = Resolver(list(names))
        out.append(resolvers[names].resolve(a) or " ".join(folded(a)) or i or "")
    return pd.Series(out, dtype=object)


def with_contributor(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """id, contributor, intrinsic_score of the latest analysis of each id."""
    latest = latest_rows(articles.select("id", "source_id", "author", "intrinsic_score", "analyzed_at"), "id", [F.col("analyzed_at")])
    scopes = sources.filter("id is not null").groupBy(F.col("id").alias("source_id")).agg(F.max("author_scope").alias("_scope"))
    joined = latest.join(size_checked(scopes, MOST_SOURCES), "source_id", "left")
    return joined.select("id", contributor_name("author", "_scope", "source_id").alias("contributor"), "intrinsic_score")


SPREAD = 42.0  # more than the logarithms of two exponential draws of 52 bits can differ by
LEAST_TOLD = 1e-13  # gaps of scores, in parts of the greatest, that scaled doubles still tell


def draw(seed: int, of: Column) -> Column:
    """-ln(E) of an exponential draw from the first 52 bits of a hash."""
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), of)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def usable(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)


def reservoir_key(score: Column, id: Column, sharpness: float, seed: int, shared: bool = False) -> Column:
    """The logarithm of weight over draw; null without a weight. `shared` draws are those of the score, not the id."""
    return F.when(usable(score), F.lit(sharpness) * score + draw(seed, score.cast("string") if shared else id))


def separating_sharpness(records: DataFrame, score: str, scratch: Scratch) -> float | None:
    """The sharpness from which on different scores can't change places; None where doubles can't tell them so.

    Distinct scores are sorted over range partitions; neighbours are compared inside them and across their ends.
    """
    finite = records.select(F.col(score).cast("double").alias("s")).filter(usable(F.col("s")) & (F.abs("s") < float("inf")))
    placed = scratch.cut(finite.distinct().repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    inside = placed.withColumn("gap", F.col("s") - F.lag("s").over(W.partitionBy("part").orderBy("s"))).agg(F.min("gap").alias("gap"))
    ends = placed.groupBy("part").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max(F.abs("s")).alias("size"))
    across = ends.withColumn("gap", F.col("low") - F.lag("high").over(W.partitionBy(F.lit(0)).orderBy("part")))  # one row a partition
    whole = across.agg(F.min("gap").alias("between"), F.max("size").alias("size")).crossJoin(inside).first()  # one row each
    gaps = [g for g in (whole["between"], whole["gap"]) if g is not None]
    if not gaps:
        return 1.0
    return SPREAD / min(gaps) if min(gaps) > LEAST_TOLD * whole["size"] else None


def ranked(records: DataFrame, scratch: Scratch, contributor: str = "contributor", id: str = "id", score: str = "score", sharpness: float | None = None, seed: int = 11) -> DataFrame:
    """contributor, id, score, key and `place` (long, from 1: the largest key of its contributor).

    Without a `sharpness` it is the separating one, with shared draws.
    """
    spark = records.sparkSession
    shared = sharpness is None
    if shared:
        sharpness = separating_sharpness(records, score, scratch)
    rows = records.filter(F.col(id).isNotNull()).select(F.coalesce(F.col(contributor), F.lit("")).alias("contributor"), F.col(id).alias("id"), F.col(score).cast("double").alias("score"))
    rows = rows.withColumn("key", reservoir_key(F.col("score"), F.col("id"), 1.0 if sharpness is None else sharpness, seed, shared))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = [F.when(usable(F.col("score")), F.col("score")).desc_nulls_last()] if sharpness is None else []
    order = [*first, F.col("key").desc_nulls_last(), F.col("id").asc()]
    spread = scratch.cut(rows.repartitionByRange(parts, F.col("contributor"), *order).withColumn("part", F.spark_partition_id()))
    counts = spread.groupBy("contributor", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(W.partitionBy("contributor").orderBy("part")) - F.col("n")).drop("n")
    inside = spread.withColumn("place", F.row_number().over(W.partitionBy("contributor", "part").orderBy(*order)))
    return inside.join(offsets, ["contributor", "part"]).select("contributor", "id", "score", "key", (F.col("place") + F.col("offset")).alias("place"))


def cap(records: DataFrame, scratch: Scratch, share: float | None = None, most: int | None = None, **ranking) -> DataFrame:
    """`ranked` with `kept`: each contributor keeps `most` records, or the whole part of `share` of all records."""
    placed = ranked(records, scratch, **ranking)
    if most is None:
        if share is None:
            raise ValueError("share or most must be given")
        total = records.filter(F.col(ranking.get("id", "id")).isNotNull()).count()
        most = int(round(share * 1_000_000)) * total // 1_000_000
    return placed.withColumn("kept", F.col("place") <= most)
