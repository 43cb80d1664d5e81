"""Lines repeated across one site's documents.

Each line is masked: digits go, names of its author and source, runs of capitalised words, and in lines with digits the
names of months and weekdays become one mark. Masked lines are cut into shingles of five words and get a min-hash
signature. Lines of one source that are alike when masked are one node. Nodes are banded by locality-sensitive hashing
within their source, the line's bare letters being one band more; all nodes that share a band meet, those that only share
min-hashes are verified on their masked shingles (Jaccard similarity of 0.8 or more), and what is linked, over any number
of steps, is one cluster. A cluster is repeated if its articles reach the limits. Clusters whose summed rows cannot reach
them are left out before articles are counted, which loses none.

An article sends each distinct line once, as hashes, signature and places, so no text is shuffled; the shingles of the few
lines to verify are read from the articles again.

Defined cases: null, empty and blank texts have no lines, but their articles count towards the source; lines of fewer
than 3 letters never count; a line twice in one article counts once; repeated rows of an article are one article; null
sources form one source; rows without article_id are dropped; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..tables import Scratch, size_checked
from . import buckets
from .arrow import list_array, map_arrow, mix64
from .near_duplicates import components, packed, similarity

SHINGLE, BAND_ROWS, BANDS = 5, 3, 6
SIGNATURE = BANDS * BAND_ROWS
LEAST_SIMILARITY, LEAST_AGREEMENT = 0.8, 0.5  # a pair at 0.8 agrees on less than half of 18 places with a probability of 2e-4
LEAST_LETTERS = 3
MOST_BROADCAST = 200_000
# Names of months and weekdays in English, German and Spanish.
MONTHS = frozenset("january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())
WEEKDAYS = frozenset("monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles jueves viernes sábado domingo".split())
DATES = MONTHS | WEEKDAYS | frozenset(w[:3] for w in MONTHS | WEEKDAYS)
_NOT_LETTERS = regex.compile(r"\P{L}+")
_WORDS = regex.compile(r"\p{L}+")
_DIGIT = regex.compile(r"\p{N}")
_NAMES = regex.compile(r"\p{Lu}\p{Ll}+(?:[ '’.-]+\p{Lu}\p{Ll}+)+")
_MARK = 1
_FACTORS = mix64(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)
_POSITIONS = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
LINES = "source_id string, article_id string, node long, hi long, lo long, signature binary, places array<int>"


def letters(line: str) -> str:
    return _NOT_LETTERS.sub("", line.lower())


class Masker:
    """Hashes of the words of a line with what is masked as one mark; word hashes are kept within a batch."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.names: frozenset[str] = frozenset()

    def of(self, source: str | None, author: str | None) -> None:
        self.names = frozenset(_WORDS.findall((author or "").lower())) | frozenset(_WORDS.findall((source or "").lower()))

    def __call__(self, line: str, low: str) -> list[int]:
        words = _WORDS.findall(low)
        masked = self.names | DATES if _DIGIT.search(line) else self.names
        if runs := _NAMES.findall(line):
            more = masked.union(*(_WORDS.findall(r.lower()) for r in runs))
            if not more.issuperset(words):  # a line of capitalised words alone isn't a name
                masked = more
        known, out = self.known, []
        for w in words:
            if w in masked:
                if not out or out[-1] != _MARK:  # a run of masked words is one mark
                    out.append(_MARK)
                continue
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def shingled(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lines of at least SHINGLE words each, and how many each line has."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(SHINGLE):
        out[: len(out) - k] += words[k:] * _POSITIONS[k]
    inside = np.ones(len(words), dtype=bool)
    for k in range(1, SHINGLE):
        inside[starts + lengths - k] = False
    return mix64(out[inside]), lengths - SHINGLE + 1


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of SIGNATURE bytes per line."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    out = np.empty((len(counts), SIGNATURE), dtype=np.uint8)
    for k, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat((shingles * factor) >> np.uint64(24), first)
        out[:, k] = (mix64(least) >> np.uint64(56)).astype(np.uint8)
    return out


def padded(words: list[int]) -> list[int]:
    return words if len(words) >= SHINGLE else words + [0] * (SHINGLE - len(words))


def node_of(source: str, words: list[int]) -> int:
    """A hash of the source and the masked line."""
    return xxhash.xxh3_64_intdigest(source.encode() + b"\0" + np.array(words, dtype=np.uint64).tobytes()) - (1 << 63)


def keyed_lines(articles: DataFrame) -> DataFrame:
    """One row per article and distinct line of at least LEAST_LETTERS letters."""

    def make(part: pa.RecordBatch) -> dict:
        sources, ids, authors, texts = (part.column(k).to_pylist() for k in range(4))
        mask = Masker()
        out_source, out_id, nodes, keys, places, words, lengths = [], [], [], [], [], [], []
        for source, id, author, text in zip(sources, ids, authors, texts):
            if not text:
                continue
            mask.of(source, author)
            seen: dict[bytes, int] = {}
            for at, line in enumerate(text.split("\n")):
                low = line.lower()
                kept = _NOT_LETTERS.sub("", low)
                if len(kept) < LEAST_LETTERS:
                    continue
                key = xxhash.xxh3_128_digest(kept)
                if key in seen:
                    places[seen[key]].append(at)
                    continue
                seen[key] = len(places)
                places.append([at])
                keys.append(key)
                out_source.append(source)
                out_id.append(id)
                own = mask(line, low)
                nodes.append(node_of(source, own))
                own = padded(own)
                words.extend(own)
                lengths.append(len(own))
        pair = np.frombuffer(b"".join(keys), dtype=">i8").astype(np.int64).reshape(-1, 2)
        signed = signatures(*shingled(np.array(words, dtype=np.uint64), np.array(lengths, dtype=np.int64))) if keys else np.empty((0, SIGNATURE), dtype=np.uint8)
        spans = np.fromiter(map(len, places), dtype=np.int64, count=len(places))
        return {"source_id": out_source, "article_id": out_id, "node": nodes, "hi": pair[:, 0], "lo": pair[:, 1], "signature": [row.tobytes() for row in signed], "places": list_array(np.array([p for x in places for p in x], dtype=np.int32), spans, pa.int32())}

    return map_arrow(_chosen(articles), LINES, "text", make)


def _chosen(articles: DataFrame) -> DataFrame:
    return articles.filter("article_id is not null").select(F.coalesce("source_id", F.lit("")).alias("source_id"), "article_id", "author", "text")


def shingle_sets(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its packed shingles, read from one line of it. `wanted`: article_id, node, place."""
    asked = wanted.groupBy("article_id").agg(F.collect_list(F.struct("node", "place")).alias("asked"))  # lines of one article
    texts = _chosen(articles).join(size_checked(asked, MOST_BROADCAST), "article_id")

    def make(part: pa.RecordBatch) -> dict:
        mask = Masker()
        nodes, sets = [], []
        for source, author, text, asked_ in zip(*(part.column(k).to_pylist() for k in range(4))):
            lines = (text or "").split("\n")
            mask.of(source, author)
            for a in asked_:
                if a["place"] < len(lines):
                    line = lines[a["place"]]
                    own = mask(line, line.lower())
                    if node_of(source, own) == a["node"]:  # another row of the article may have another text
                        own = padded(own)
                        nodes.append(a["node"])
                        sets.append(packed(shingled(np.array(own, dtype=np.uint64), np.array([len(own)]))[0]))
        return {"node": nodes, "packed": sets}

    return map_arrow(texts.select("source_id", "author", "text", "asked"), "node long, packed binary", "text", make).dropDuplicates(["node"])


def links(articles: DataFrame, lines: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: nodes with a line of the same letters, and nodes whose masked lines are near-duplicates."""
    lettered = lines.select(F.xxhash64("source_id", "hi", "lo").alias("band"), "node").distinct()
    several = lettered.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("band", "low")
    same = lettered.join(several, "band").filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))

    bands = F.array(*[F.xxhash64("source_id", F.lit(b), F.substring("signature", b * BAND_ROWS + 1, BAND_ROWS)) for b in range(BANDS)])
    banded = nodes.select(F.explode(bands).alias("band"), F.col("node").alias("id"))
    met = scratch.cut(buckets.pairs(banded, nodes.select(F.col("node").alias("id"), "signature"), SIGNATURE, LEAST_AGREEMENT, scratch))
    involved = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    examples = scratch.cut(nodes.join(involved, "node", "left_semi").select("example.article_id", "node", "example.place"))
    sets = scratch.cut(shingle_sets(articles, examples))
    both = met.join(sets.select(F.col("node").alias("a"), F.col("packed").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("packed").alias("q")), "b")
    near = both.filter(similarity()("p", "q") >= LEAST_SIMILARITY).select("a", "b")
    return scratch.cut(same.unionByName(near))


def repeated_lines(articles: DataFrame, scratch: Scratch, least_articles: int = 3, least_percent: int = 5) -> DataFrame:
    """source_id, article_id, hi, lo, places, cluster_articles, source_articles of lines in repeated clusters."""
    lines = scratch.cut(keyed_lines(articles))
    sizes = articles.filter("article_id is not null").select(F.coalesce("source_id", F.lit("")).alias("source_id"), "article_id").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("source_articles"))
    nodes = scratch.cut(lines.groupBy("node").agg(F.max("source_id").alias("source_id"), F.max("signature").alias("signature"), F.count(F.lit(1)).alias("n"), F.min(F.struct("article_id", F.get("places", F.lit(0)).alias("place"))).alias("example")))
    linked = links(articles, lines, nodes, scratch)
    labels = components(linked, scratch, "a", "b")
    placed = nodes.select("node", "source_id", "n").join(labels.select(F.col("id").alias("node"), "label"), "node", "left").withColumn("root", F.coalesce("label", "node")).drop("label")

    enough = (F.col("n") >= least_articles) & (F.col("n") * 100 >= F.col("source_articles") * least_percent)
    possible = placed.groupBy("source_id", "root").agg(F.sum("n").alias("n")).join(size_checked(scratch.cut(sizes), MOST_BROADCAST), "source_id").filter(enough).select("root", "source_articles")
    wanted = scratch.cut(placed.select("node", "root").join(possible, "root"))
    hits = lines.drop("signature").join(size_checked(wanted, MOST_BROADCAST), "node")
    counted = hits.groupBy("root", "source_articles", "article_id").agg(F.lit(1).alias("one")).groupBy("root", "source_articles").agg(F.count("one").alias("n")).filter(enough)
    counted = scratch.cut(counted.select("root", F.col("n").alias("cluster_articles")))
    repeated = scratch.cut(hits.join(size_checked(counted, MOST_BROADCAST), "root").select("source_id", "article_id", "hi", "lo", "places", "cluster_articles", "source_articles"))
    for done in (lines, nodes, wanted, counted):
        scratch.drop(done)
    return repeated


def exact_lines(repeated: DataFrame, least_articles: int = 3, least_percent: int = 5) -> DataFrame:
    """article_id and line_no of the lines of repeated clusters whose own letters reach the limits."""
    key = ["source_id", "hi", "lo"]
    once = repeated.groupBy(*key, "source_articles", "article_id").agg(F.lit(1).alias("one"))
    own = once.groupBy(*key, "source_articles").agg(F.count("one").alias("n")).filter((F.col("n") >= least_articles) & (F.col("n") * 100 >= F.col("source_articles") * least_percent))
    return repeated.join(size_checked(own.select(*key), MOST_BROADCAST), key, "left_semi").select("article_id", F.explode("places").alias("line_no")).distinct()


def without_lines(articles: DataFrame, repeated: DataFrame) -> DataFrame:
    """article_id and text of every article, without the lines of repeated clusters."""
    gone = repeated.select("article_id", F.explode("places").alias("p")).groupBy("article_id").agg(F.collect_set("p").alias("gone"))
    texts = articles.filter("article_id is not null").select("article_id", "text")
    kept = F.filter(F.split("text", "\n"), lambda line, i: F.col("gone").isNull() | ~F.array_contains(F.col("gone"), i))
    return texts.join(gone, "article_id", "left").select("article_id", F.concat_ws("\n", kept).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))
