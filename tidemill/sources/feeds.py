"""Readers for feeds, sitemaps, pages and pushed payloads. Malformed rows come out with an error code, not as exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import parsed
from ..functions.text import decoded, escaped, links, normalized, stripped
from ..functions.urls import normalized_url

ITEM = "title string, link string, creator string, author string, pubDate string, description string, encoded string, category array<string>"


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, author, published, body and categories; items without title, link or body go."""
    raw = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").option("mode", "PERMISSIVE").schema(ITEM).load(path)
    body = F.coalesce(F.nullif("encoded", F.lit("")), "description")
    out = raw.select(
        stripped(F.col("title")).alias("title"),
        normalized_url(F.col("link")).alias("link"),
        stripped(F.coalesce("creator", "author")).alias("author"),
        parsed(F.col("pubDate")).alias("published_at"),
        body.alias("body"),
        F.coalesce("category", F.array().cast("array<string>")).alias("categories"),
    )
    return out.filter((F.col("title") != "") & F.col("link").isNotNull() & (F.coalesce("body", F.lit("")) != ""))


def pages_of_feed(template: str, numbers: Column) -> Column:
    return F.transform(numbers, lambda n: F.replace(F.lit(template), F.lit("{page}"), n.cast("string")))


def first_seen(items: DataFrame, link: str = "link", page: str = "page") -> DataFrame:
    """Each link once, from the earliest page it stood on."""
    return items.groupBy(link).agg(F.min_by(F.struct(*items.columns), F.col(page)).alias("_r")).select("_r.*")


def item(title: Column, link: Column, author: Column, body: Column, category: Column) -> Column:
    """An item of a feed."""
    parts = [F.concat(F.lit(f"<{n}>"), escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{n}>")) for n, c in (("title", title), ("link", link), ("author", author), ("description", body), ("category", category))]
    return F.concat(F.lit("<item>"), *parts, F.lit("</item>"))


def items(channel: Column) -> Column:
    """The items of a feed's channel element: title, link, author, body and categories; an empty array for broken markup."""
    kind = "item array<struct<title: string, link: string, author: string, description: string, category: array<string>>>"
    found = F.from_xml(channel, kind)["item"]
    read = F.transform(found, lambda i: F.struct(F.trim(i["title"]).alias("title"), i["link"].alias("link"), F.trim(i["author"]).alias("author"), i["description"].alias("body"), F.coalesce(i["category"], F.array().cast("array<string>")).alias("categories")))
    return F.coalesce(read, F.array().cast("array<struct<title:string,link:string,author:string,body:string,categories:array<string>>>"))


def sitemap_links(xml: Column, origin: str | Column) -> Column:
    """Post addresses of one origin in a sitemap, without fragments, in order and once each."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1))
    clean = F.transform(found, lambda u: F.regexp_replace(F.trim(decoded(u)), "#.*$", ""))
    return F.array_distinct(F.filter(clean, lambda u: u.startswith(F.concat(F.lit(origin) if isinstance(origin, str) else origin, F.lit("/p/")))))


def sitemap(urls: Column) -> Column:
    """A sitemap of the given addresses."""
    return F.concat(F.lit("<urlset>"), F.array_join(F.transform(urls, lambda u: F.concat(F.lit("<url><loc>"), escaped(u), F.lit("</loc></url>"))), ""), F.lit("</urlset>"))


def absolute(href: Column, base: Column) -> Column:
    """An href against the address of its page; null for what leads to no page."""
    origin = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"(?i)^(https?://[^?#]*/)", 1)
    clean = F.trim(href)
    return (
        F.when(clean.rlike("(?i)^https?://"), clean)
        .when(clean.startswith("//"), F.concat(F.regexp_extract(base, r"(?i)^(https?:)", 1), clean))
        .when(clean.startswith("/"), F.concat(origin, clean))
        .when((clean == "") | clean.startswith("#") | clean.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(folder, clean))
    )


def page_links(pages: DataFrame, markup: str, url: str, *keep: str) -> DataFrame:
    """One row per link of each page: place, resolved address and text; links to nowhere are dropped."""
    out = pages.select(*keep, F.col(url).alias("_base"), F.posexplode(links(F.col(markup))).alias("place", "_l"))
    out = out.select(*keep, "place", normalized_url(absolute(F.col("_l.href"), F.col("_base"))).alias("href"), F.col("_l.text").alias("text"))
    return out.filter("href is not null")


def mail_address(id: Column, sender: Column) -> Column:
    """An address made of the sender's host and the message's id."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.trim(id), r"[^a-zA-Z0-9._@+-]+", "-"), r"^-+|-+$", ""), 1, 180)
    host = F.regexp_extract(F.coalesce(sender, F.lit("")), r"@([A-Za-z0-9.-]+)$", 1)
    return F.concat(F.lit("https://"), F.when(host == "", "mail.invalid").otherwise(F.lower(host)), F.lit("/mail/"), F.when(slug == "", "unknown").otherwise(slug))


def parsed_mail(mail: DataFrame) -> DataFrame:
    """Pushed mail as articles: address (given or made from the id), title, author, date, text and an error code.

    Codes: missing_source, missing_message_id, missing_subject, missing_body; null where all is there.
    """
    blank = lambda c: F.coalesce(normalized(F.col(c)), F.lit("")) == ""
    made = mail_address(F.col("message_id"), F.col("from_address"))
    error = F.when(blank("source_id"), "missing_source").when(blank("message_id"), "missing_message_id").when(blank("subject"), "missing_subject").when(blank("text_body") & blank("html_body"), "missing_body")
    return mail.select(
        "message_id",
        "source_id",
        F.coalesce(normalized_url(F.col("canonical_url")), made).alias("canonical_url"),
        normalized(F.col("subject")).alias("title"),
        F.when(blank("author"), F.col("source_id")).otherwise(normalized(F.col("author"))).alias("author"),
        parsed(F.col("published_at")).alias("published_at"),
        F.coalesce(F.col("text_body"), stripped(F.col("html_body"))).alias("text"),
        error.alias("error"),
    )
