"""URL identity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")


def normalized_url(url: Column) -> Column:
    """Lower-case host, entities of `&` decoded, no fragment and tracking parameters, the others sorted by name.

    Null for what is no http address.
    """
    text = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"(?i)&amp;|&#0*38;|&#x0*26;", "&")
    text = F.regexp_replace(text, r"#.*$", "")
    host = F.lower(F.regexp_extract(text, r"(?i)^(https?://[^/?#]+)", 1))
    path = F.regexp_extract(text, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(text, r"\?(.*)$", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("n"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
    joined = F.array_join(ordered, "&")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def first_link_to(text: Column, host: str) -> Column:
    """The first link to a host in a text, without closing punctuation; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(https?://(?:[a-z0-9-]+\.)*{host}/[^\s\"'<>]+)"), F.lit(1))
    return normalized_url(F.regexp_replace(F.get(found, F.lit(0)), r"[),.;]+$", ""))


def links_in(text: Column) -> Column:
    """The links of a text in order, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s\"'<>]+)"), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[),.;]+$", ""))


def preferred(links: Column, pattern: str) -> Column:
    """The first link of the pattern, else the first; null if there is none."""
    return F.coalesce(F.get(F.filter(links, lambda u: u.rlike(pattern)), F.lit(0)), F.get(links, F.lit(0)))
