"""Readers of sources as data: what to fetch, what a fetched page lists, and how a body is taken from it.

A source is a row of settings; pages that were fetched are a table (source_id, page, status, body), so scans are plain
queries over it and a failed page is a status, not an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.numbers import floor_steps
from ..functions.text import links, stripped, title_from_slug
from ..functions.urls import normalized_url
from .feeds import absolute, sitemap_links
from .selectors import selected

MOST_BYTES = 2_000_000
# Statuses that end a scan behind its first page, and least words with the confidence they give.
ENDS = (403, 404, 429)
CONFIDENCE = {"feed": [(600, 0.99), (200, 0.98), (80, 0.95), (30, 0.91)], "page": [(200, 0.98), (80, 0.93)], "post": [(200, 0.99), (80, 0.95)], "short": [(150, 0.96)], "essay": [(301, 0.98)]}
# Fixed value: names of posts that are no articles.
NO_ARTICLES = r"(?i)^(?:hidden-)?open-thread(?:-|$)|^links-for-|meetups?-everywhere|survey(?:-|$)|call-for-organizers|classifieds(?:-|$)"
LEAST_CONFIDENCE = {"feed": 0.75, "page": 0.8, "post": 0.82, "short": 0.9, "essay": 0.91}


@dataclass(frozen=True)
class Source:
    """Settings of one source; `kind` names how it lists its articles: feed, index, sitemap or push."""

    id: str
    kind: str
    origin: str
    author: str = ""
    page: str = ""  # template of further pages, with {page}
    allowed: tuple[str, ...] = ()
    without_category: str = ""
    with_category: str = ""
    deny: str = ""  # pattern of paths that are no articles
    segments: int = 0  # number of path segments an article has, if fixed
    suffix: str = ""
    selector: str = ""
    stop: str = ""  # text from this pattern on is no body
    confidence: str = "page"


@dataclass
class Registry:
    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, source: Source) -> Source:
        if source.id in self.sources:
            raise ValueError(f"two sources named {source.id}")
        self.sources[source.id] = source
        return source

    def __getitem__(self, id: str) -> Source:
        return self.sources[id]


def reached(pages: DataFrame, listed: Column) -> DataFrame:
    """Pages up to where the scan of their source ends: before the first later page that failed or lists nothing."""
    bad = ((F.col("page") > 1) & F.col("status").isin(*ENDS)) | (listed == 0)
    end = pages.groupBy("source_id").agg(F.min(F.when(bad, F.col("page"))).alias("_end"))
    return pages.join(end, "source_id").filter(F.col("_end").isNull() | (F.col("page") < F.col("_end"))).drop("_end")


def accepted_items(items: DataFrame, source_settings: DataFrame) -> DataFrame:
    """Items with title, link and body, by an allowed author, of a wanted category. Settings: source_id, allowed, without."""
    out = items.join(source_settings, "source_id", "left")
    whole = (F.coalesce("title", F.lit("")) != "") & F.col("link").isNotNull() & (F.coalesce("body", F.lit("")) != "")
    author = F.col("allowed").isNull() | (F.size("allowed") == 0) | F.array_contains("allowed", F.col("author"))
    category = F.col("without").isNull() | ~F.array_contains("categories", F.col("without"))
    return out.filter(whole & F.coalesce(author, F.lit(False)) & F.coalesce(category, F.lit(True))).drop("allowed", "without")


def first_listed(items: DataFrame, *order: str) -> DataFrame:
    """Each link of a source once, from where it was listed first."""
    rest = [c for c in items.columns if c not in ("source_id", "link", *order)]
    return items.groupBy("source_id", "link").agg(F.min_by(F.struct(*order, *rest), F.struct(*order, *rest)).alias("_r")).select("source_id", "link", "_r.*")


def index_links(pages: DataFrame, source: Source) -> DataFrame:
    """Articles an index page lists: its links resolved, without query, on the source's host, by the source's path rules."""
    out = pages.select("source_id", "page", F.posexplode(links(F.col("body"))).alias("place", "_l"))
    link = F.regexp_replace(normalized_url(absolute(F.col("_l.href"), F.lit(source.origin + "/"))), r"\?.*$", "")
    out = out.select("source_id", link.alias("link"), "page", "place", F.col("_l.text").alias("title"))
    path = F.regexp_replace(F.col("link"), r"^https?://[^/]+", "")
    keep = F.col("link").startswith(source.origin + "/") & (F.col("title") != "")
    if source.segments:
        keep = keep & (F.size(F.filter(F.split(path, "/"), lambda s: s != "")) == source.segments)
    if source.suffix:
        keep = keep & path.endswith(source.suffix)
    if source.deny:
        keep = keep & ~path.rlike(source.deny)
    return first_listed(out.filter(keep), "page", "place").withColumn("author", F.lit(source.author))


def with_sitemap(listed: DataFrame, sitemaps: DataFrame, source: Source, depth: int) -> DataFrame:
    """What the feed lists, filled up from the sitemap to `depth` * 20 articles if more than one page is asked for.

    `sitemaps`: source_id, status, body; a sitemap that was refused adds nothing. Titles come from the addresses.
    """
    if depth <= 1:
        return listed.select("source_id", "link", "title").withColumn("place", F.lit(0))
    found = sitemaps.filter(~F.col("status").isin(403, 429)).select("source_id", F.posexplode(sitemap_links(F.col("body"), source.origin)).alias("place", "link"))
    return filled_up(listed, found, source.deny, depth * 20)


def filled_up(listed: DataFrame, found: DataFrame, deny: str, most: int) -> DataFrame:
    """What is listed (source_id, link, title), and of what was found (with `place`) as much as makes `most` of a source."""
    more = found.filter(~F.regexp_extract("link", r"([^/]+)/*$", 1).rlike(deny)) if deny else found
    more = more.join(listed.select("source_id", "link"), ["source_id", "link"], "left_anti").withColumn("title", title_from_slug(F.col("link")))
    both = listed.select("source_id", "link", "title").withColumn("place", F.lit(-1)).unionByName(more.select("source_id", "link", "title", "place"))
    w = W.partitionBy("source_id").orderBy("place", "link")
    return both.withColumn("_n", F.row_number().over(w)).filter((F.col("place") < 0) | (F.col("_n") <= most)).drop("_n")


def confidence(words: Column, kind: Column | str) -> Column:
    """How sure an extraction of so many words is, by the kind of its source."""
    name = F.lit(kind) if isinstance(kind, str) else kind
    out = F.lit(None).cast("double")
    for k, steps in CONFIDENCE.items():
        out = F.when(name == k, floor_steps(words, steps, LEAST_CONFIDENCE[k])).otherwise(out)
    return out


def free_post(post: Column) -> Column:
    """A post anyone may read as text."""
    return F.coalesce((post["audience"] == "everyone") & (post["type"] == "newsletter") & post["podcast_url"].isNull() & post["video_upload_id"].isNull() & ~F.coalesce(post["free_unlock_required"], F.lit(False)), F.lit(False))


def bodies(articles: DataFrame, source: Source) -> DataFrame:
    """link, text, error of articles (link, inline, fetched): inline markup as it is, else what the selector finds.

    Errors: no_selector, no_body, partial_preview (permanent); null where there is a body.
    """
    deferred = selected(F.col("fetched"), source.selector) if source.selector else F.lit(None).cast("string")
    text = F.when(F.coalesce("inline", F.lit("")) != "", stripped(F.col("inline"))).otherwise(deferred)
    if source.stop:
        text = F.trim(F.get(F.split(text, source.stop), F.lit(0)))
    out = articles.select("link", text.alias("text"), (F.coalesce("inline", F.lit("")) == "").alias("_deferred"))
    partial = F.col("text").rlike(r"(?i)\b(?:this post is for (?:paid|paying) subscribers|subscribe to (?:continue|keep) reading|already a (?:paid )?subscriber)\b")
    error = F.when(F.col("_deferred") & F.lit(not source.selector), "no_selector").when(F.coalesce("text", F.lit("")) == "", "no_body").when(partial, "partial_preview")
    return out.withColumn("error", error).drop("_deferred")


class PageSource(DataSource):
    """`spark.read.format("fetched_pages").load(folder)`: one row per file, url from its name, no more than MOST_BYTES read."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return "url string, bytes long, whole boolean, body string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(self.options["path"])


class _PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.folder).iterdir()) if p.is_file()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pathlib import Path
        from urllib.parse import unquote

        path = Path(partition.value)
        with path.open("rb") as f:
            data = f.read(MOST_BYTES + 1)
        size = path.stat().st_size
        yield unquote(path.name), size, size <= MOST_BYTES, data[:MOST_BYTES].decode("utf-8", "replace")
