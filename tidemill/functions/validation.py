"""Checks of fields and of verdicts that were sent in. Null is never valid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Themes an analysis may name, and the version and formats of a verdict.
THEMES = ("education", "history", "economics", "science", "markets", "startups", "decision-making", "writing", "investing", "psychology", "philosophy", "technology", "culture", "policy")
VERSION = "standalone-v1"
FORMATS = ("standalone_essay", "media", "roundup", "abstract", "announcement", "excerpt", "uncertain")


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def number_in(x: Column, low: float, high: float) -> Column:
    return _sure(~F.isnan(x) & x.between(low, high))


def length_in(x: Column, low: int, high: int) -> Column:
    return _sure(F.length(x).between(low, high))


def strings_in(x: Column, least: int, most: int, longest: int) -> Column:
    """A list of `least` to `most` texts that aren't blank, none longer than `longest`."""
    return _sure(F.size(x).between(least, most) & F.forall(x, lambda s: _sure(F.length(F.trim(s)).between(1, longest))))


def verdict(json: Column) -> Column:
    """version, format, reason and bodyEvidence of a verdict; null for broken JSON."""
    sound = F.when(F.try_parse_json(json).isNotNull(), json)
    return F.from_json(sound, "version string, format string, reason string, bodyEvidence array<string>")


def valid_verdict(v: Column) -> Column:
    reason, quotes = F.length(F.trim(v["reason"])).between(1, 1000), v["bodyEvidence"]
    return _sure((v["version"] == VERSION) & v["format"].isin(*FORMATS) & reason & F.size(quotes).between(1, 5) & F.forall(quotes, lambda q: _sure(F.length(q).between(1, 1000))))


def quoted(text: Column, quote: Column) -> Column:
    """Whether the text has the quote, white space aside; of a quote of 40 characters and more its first 80 suffice."""
    bare = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return _sure(F.contains(bare(text), bare(quote)) | ((F.length(quote) >= 40) & F.contains(bare(text), F.substring(bare(quote), 1, 80))))


def under(key: Column, name: str) -> Column:
    """Whether a key is the name or begins with it and a colon, in any case."""
    low = F.lower(key)
    return _sure((low == name.lower()) | low.startswith(name.lower() + ":"))
