"""Main body of a page: which lines of its text are the article's own.

Stage one is the line-block distribution of the stripped text: text lengths are summed over a sliding window of lines;
where the sums surge above the page's threshold a block begins, where they dive below it ends, and the heaviest block is
the candidate. Taken alone it keeps teasers and comments, which are as long as paragraphs, and loses short headings and
captions; so where markup is there, stage two takes the innermost box that holds the title's heading and at least a
paragraph, and reads the lines in it by their elements: dates and bylines, linked prompts, lists of related items with
their teasers, notes on the author and prompts in the classes used for prompts elsewhere on the page are no main body.
Stage three learns from the corpus: masked lines that stand outside the bodies of a good part of a site's pages (prompts,
notices, navigation) are furniture inside a body of that site too. Pages without title heading keep the block of stage one.

Defined cases: null or empty text has no lines; blank lines are no cases; null markup leaves stage one and three; a null
title is unknown; the latest of several rows of one page holds; rows without id are dropped; ties of blocks go to the
first; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..tables import Scratch, size_checked
from .arrow import list_array, map_arrow
from .page_markup import Line, aligned, segments

WINDOW, SURGE = 3, 0.5
FURNITURE_PAGES, FURNITURE_SHARE = 3, 0.02  # of one source's pages; the first is the least number that says anything
MOST_SITES = 1_000_000
# Words that open bylines, dates, prompts, comments and lists of related items, in three languages.
_BYLINE = regex.compile(r"^(?:by|written by|words|text|from|von|geschrieben von|por|escrito por|published|updated|filed under|posted|veröffentlicht|publicado|listen to|abgelegt unter|archivado en)\b", regex.I)
_DATE = regex.compile(r"\b\d{1,2}\.\d{1,2}\.\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d+ min\b", regex.I)
_COMMENTS = regex.compile(r"^\d+ (?:comments?|kommentare?|comentarios?|reacciones|responses|replies)$", regex.I)
_COMMENTER = regex.compile(r"^[\p{L}\p{M}.' -]{1,60}, \d{1,2}:\d{2}$")
_NOTE_MARK = regex.compile(r"^(?:\[?\d{1,3}\]?|[*†‡])[.)]? ")
_NUMBERS = regex.compile(r"\p{N}+")
_ENDS = regex.compile(r"[.!?…:;\"”»)]\s*$")
_SENTENCE = regex.compile(r"[.!?…](?=\s|$)")
_RIGHTS = regex.compile(r"^(?:©|\(c\)|copyright)", regex.I)


def site_name(source: str | None) -> str:
    return (source or "").replace("-", " ").replace("_", " ").strip().lower()


def densest(lines: list[str]) -> tuple[int, int]:
    """First and last line (exclusive) of the heaviest block of the line-block distribution."""
    lengths = np.array([len(line.strip()) for line in lines], dtype=np.int64)
    if not len(lengths) or not lengths.any():
        return 0, 0
    sums = np.convolve(lengths, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :]  # of the window that begins at the line
    limit = SURGE * sums.max()
    best, at, n = (0, 0, 0), 0, len(lengths)
    while at < n:
        if sums[at] < limit:
            at += 1
            continue
        surge = at
        while at < n and sums[at] >= limit:
            at += 1
        dive = min(n, at + WINDOW - 1)
        while surge < dive and lengths[surge] * WINDOW < limit / 2:  # the window reaches ahead of the text
            surge += 1
        while dive > surge and lengths[dive - 1] * WINDOW < limit / 2:
            dive -= 1
        mass = int(lengths[surge:dive].sum())
        if mass > best[0]:
            best = (mass, surge, dive)
    return best[1], best[2]


def masked(line: str, names: list[str]) -> str:
    low = _NUMBERS.sub("#", line.strip().lower())
    for name in names:
        low = low.replace(name, "§")
    return low


def _key(line: str, names: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(masked(line, names)) - (1 << 63)


class Page:
    """Lines of one page with their verdicts: body, case, or doubtful (a case if furniture elsewhere)."""

    def __init__(self, text: str, markup: str | None, title: str | None, source: str | None, author: str | None):
        self.lines = text.split("\n")
        self.site = site_name(source)
        self.names = sorted({x for x in (self.site, (author or "").strip().lower()) if x}, key=len, reverse=True)
        self.marks = aligned(self.lines, segments(markup)) if markup else [Line()] * len(self.lines)
        self.title = " ".join((title or "").split()).lower()
        self.case = np.zeros(len(self.lines), dtype=bool)
        self.doubt = np.zeros(len(self.lines), dtype=bool)
        self.furniture = np.zeros(len(self.lines), dtype=bool)
        self.heading = self._heading()
        self.surge, self.dive = densest(self.lines)
        self._judge()

    def _heading(self) -> int | None:
        same = [i for i, line in enumerate(self.lines) if self.title and " ".join(line.split()).lower() == self.title]
        headed = [i for i in same if self.marks[i].leaf == "h1"] or [i for i in same if self.marks[i].leaf in ("h2", "h3")]
        if headed or same:
            return (headed or same)[0]
        first = [i for i, m in enumerate(self.marks) if m.leaf == "h1"]
        return first[0] if len(first) == 1 else None

    def _inside(self) -> np.ndarray:
        """The lines of the innermost box with the heading and a paragraph; else the block, from the title on."""
        n = len(self.lines)
        inside = np.zeros(n, dtype=bool)
        if self.heading is not None and self.marks[self.heading].found:
            for box in reversed(self.marks[self.heading].boxes):
                if box.tag in ("html", "body", "tr", "tbody", "table", "td"):
                    continue
                member = self._filled_in(np.array([any(b is box for b in m.boxes) for m in self.marks]))
                if any(member[i] and i != self.heading and len(self.lines[i].split()) > 2 and not self.marks[i].linked for i in range(n)):
                    return member
        start, stop = self.surge, self.dive
        if self.heading is not None:
            if not start <= self.heading < stop:
                start, stop = self.heading, max(stop, self.heading + 1)
            start = self.heading
            for i in range(self.heading + 1, stop):
                if _COMMENTS.match(self.lines[i].strip()) or _RIGHTS.match(self.lines[i].strip()):
                    stop = i
                    break
        inside[start:stop] = True
        return inside

    def _filled_in(self, member: np.ndarray) -> np.ndarray:
        """Lines without markup stand where the lines with markup on both sides of them stand."""
        at = np.flatnonzero([m.found for m in self.marks])
        after = np.searchsorted(at, np.arange(len(member)))
        return member[at[np.maximum(after - 1, 0)]] & member[at[np.minimum(after, len(at) - 1)]] | member

    def _judge(self) -> None:
        lines, marks = [line.strip() for line in self.lines], self.marks
        filled = np.array([bool(line) for line in lines])
        inside = self._inside()
        self.case = ~inside & filled
        runs = self._runs(lines, inside)
        self.furniture = self.case & ~runs
        outside_kinds = {marks[i].kind for i in range(len(lines)) if not inside[i] and marks[i].kind}
        article_kinds = [marks[i].kind for i in range(len(lines)) if inside[i] and marks[i].leaf == "p" and len(lines[i]) > 80 and not runs[i]]
        own_kind = max(set(article_kinds), key=article_kinds.count) if article_kinds else ""
        note = regex.compile(rf"^.{{1,80}}?: {regex.escape(self.site)}\. |^{regex.escape(self.site)}: ", regex.I) if self.site else None
        started = False
        for i in np.flatnonzero(inside & filled):
            m, line = marks[i], lines[i]
            if i == self.heading:
                started = False
                continue
            if runs[i] or m.leaf == "time" or _COMMENTS.match(line) or _COMMENTER.match(line) or _RIGHTS.match(line):
                self.case[i] = True
            elif m.leaf in ("h1", "h2", "h4", "li", "figcaption") or any(b.tag in ("blockquote", "figure") for b in m.boxes[-1:]):
                started = started or m.leaf in ("li", "figcaption") or not m.leaf
            elif m.kind and m.kind != own_kind and m.kind in outside_kinds:
                self.case[i] = True
            elif m.found and m.linked and m.leaf in ("", "p"):
                self.case[i] = True
            elif note and note.match(line) and not _NOTE_MARK.match(line):
                self.case[i] = True
            elif not started and m.kind != (own_kind or None) and ((_BYLINE.match(line) and len(line) < 140) or (_DATE.search(line) and len(line) < 80)):
                self.case[i] = True
            else:
                self.doubt[i] = not (own_kind and m.kind == own_kind)
                started = started or len(line.split()) > 8

    def _runs(self, lines: list[str], inside: np.ndarray) -> np.ndarray:
        """Lists of related items with their heading and teasers, and comments."""
        marks, n = self.marks, len(lines)
        run = np.zeros(n, dtype=bool)
        i = 0
        while i < n:
            if _COMMENTS.match(lines[i]):
                run[i] = True
                i += 1
                while i < n and inside[i] == inside[i - 1] and not _RIGHTS.match(lines[i]) and marks[i].leaf not in ("li", "h1", "h2", "h3") and (i == 0 or marks[i].boxes == marks[i - 1].boxes or _COMMENTER.match(lines[i]) or _COMMENTER.match(lines[i - 1])):
                    run[i] = True
                    i += 1
                continue
            if marks[i].leaf == "h3" and i + 1 < n and marks[i + 1].leaf == "p" and (marks[i + 1].linked or (i + 2 < n and marks[i + 2].linked and marks[i + 2].leaf == "p")):
                run[i] = True
                end, j = i + 1, i + 1
                while j < n and marks[j].leaf == "p" and not marks[j].kind and inside[j] == inside[i] and marks[j].boxes[-1:] == marks[i].boxes[-1:]:
                    if marks[j].linked:
                        end = j + 1
                    j += 1
                if end < j and len(_SENTENCE.findall(lines[end])) == 1 and not _NOTE_MARK.match(lines[end]) and not _RIGHTS.match(lines[end]):
                    end += 1  # a last teaser
                run[i:end] = True
                i = end
                continue
            i += 1
        return run


PAGES = "id string, site string, cases array<int>, doubtful array<int>, doubtful_keys array<long>, furniture array<long>"


def judged(pages: DataFrame) -> DataFrame:
    """Verdicts of the first two stages. `pages`: id, text, markup, title, source, author; one row per id."""

    def make(part: pa.RecordBatch) -> dict:
        cols = [part.column(k).to_pylist() for k in range(6)]
        cases, doubtful, keys, furniture = [], [], [], []
        for id, text, markup, title, source, author in zip(*cols):
            if not text or not text.strip():
                for out in (cases, doubtful, keys, furniture):
                    out.append(np.empty(0, dtype=np.int64))
                continue
            page = Page(text, markup, title, source, author)
            at = np.flatnonzero(page.doubt)
            cases.append(np.flatnonzero(page.case))
            doubtful.append(at)
            keys.append(np.array([_key(page.lines[i], page.names) for i in at], dtype=np.int64))
            furniture.append(np.unique(np.array([_key(page.lines[i], page.names) for i in np.flatnonzero(page.furniture)], dtype=np.int64)))

        def column(rows, kind):
            return list_array(np.concatenate(rows) if rows else np.empty(0, np.int64), np.fromiter(map(len, rows), np.int64, len(rows)), kind)

        return {"id": part.column(0), "site": [s or "" for s in cols[4]], "cases": column(cases, pa.int32()), "doubtful": column(doubtful, pa.int32()), "doubtful_keys": column(keys, pa.int64()), "furniture": column(furniture, pa.int64())}

    return map_arrow(pages.select(F.col("id").cast("string").alias("id"), "text", "markup", "title", "source", "author"), PAGES, "text", make)


def furniture_lines(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """id and line_no (from 0) of every line that isn't main body."""
    found = scratch.cut(judged(pages.filter("id is not null")))
    sizes = found.groupBy("site").agg(F.count(F.lit(1)).alias("all"))
    counted = found.select("site", "id", F.explode("furniture").alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("pages"))  # a page tells a key once
    common = counted.join(size_checked(sizes, MOST_SITES), "site").filter((F.col("pages") >= FURNITURE_PAGES) & (F.col("pages") >= FURNITURE_SHARE * F.col("all"))).select("site", "key")
    doubt = found.select("id", "site", F.explode(F.arrays_zip(F.col("doubtful").alias("line_no"), F.col("doubtful_keys").alias("key"))).alias("d")).select("id", "site", F.col("d.line_no").alias("line_no"), F.col("d.key").alias("key"))
    more = doubt.join(common, ["site", "key"], "left_semi").select("id", "line_no")
    return found.select("id", F.explode("cases").alias("line_no")).unionByName(more).distinct()


def bodies(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """id, the main body's text, its share of the text, for every page."""
    gone = furniture.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    joined = pages.filter("id is not null").join(gone, "id", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: F.col("gone").isNull() | ~F.array_contains("gone", i))
    out = joined.withColumn("body", F.concat_ws("\n", kept))
    return out.select("id", F.when(F.col("text").isNotNull(), F.col("body")).alias("body"), F.when(F.length("text") > 0, F.length("body") / F.length("text")).alias("body_share"), "confidence")
