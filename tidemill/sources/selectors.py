"""Text of the elements a simple selector names: tag, .class, #id, [attr^=value], parts of a path apart by blanks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAKS = frozenset("p div li h1 h2 h3 h4 h5 h6 blockquote tr section article figcaption header footer aside ul ol".split())
SILENT = frozenset("script style noscript template".split())
_PART = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[\w-]+(?:\^?=\"?[^\]\"]*\"?)?\])*)$")
_TEST = re.compile(r"[.#][\w-]+|\[[\w-]+(?:\^?=\"?[^\]\"]*\"?)?\]")


def compiled(selector: str) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """Steps of a path: a tag (or '') and tests (attribute, how, value)."""
    steps = []
    for part in selector.split():
        m = _PART.match(part)
        if not m:
            raise ValueError(f"no selector: {part}")
        tests = []
        for t in _TEST.findall(m[2] or ""):
            if t[0] in ".#":
                tests.append(("class" if t[0] == "." else "id", "word" if t[0] == "." else "is", t[1:]))
            else:
                name, mark, value = t[1:-1].partition("=")
                tests.append((name.rstrip("^"), "has" if not mark else "starts" if name.endswith("^") else "is", value.strip('"')))
        steps.append(((m[1] or "").lower(), tests))
    return steps


def fits(step, tag: str, attributes: dict[str, str]) -> bool:
    name, tests = step
    if name and name != tag:
        return False
    for attribute, how, value in tests:
        have = attributes.get(attribute)
        if have is None or (how == "word" and value not in have.split()) or (how == "is" and have != value) or (how == "starts" and not have.startswith(value)):
            return False
    return True


class Taker(HTMLParser):
    """Collects the text inside the first depth at which the path fits; nested fits are told once."""

    def __init__(self, steps):
        super().__init__(convert_charrefs=True)
        self.steps, self.stack, self.out, self.inside, self.silent = steps, [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br" and self.inside:
                self.out.append("\n")
            return
        done = self.stack[-1][1] if self.stack else 0
        hit = False
        if done < len(self.steps) and fits(self.steps[done], tag, {k: v or "" for k, v in attrs}):
            done += 1
            hit = done == len(self.steps)
        if self.inside and tag in BREAKS:
            self.out.append("\n")
        self.stack.append((tag, done, hit))
        self.inside += hit
        self.silent += tag in SILENT

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, _, hit = self.stack.pop()
            if self.inside and t in BREAKS:
                self.out.append("\n")
            self.inside -= hit
            self.silent -= t in SILENT
            if t == tag:
                return

    def handle_data(self, data):
        if self.inside and not self.silent:
            self.out.append(data)


def text_of(markup: str | None, steps) -> str | None:
    """Null for null, '' where nothing fits; white space as in `functions.text.normalized`."""
    if markup is None:
        return None
    taker = Taker(steps)
    taker.feed(markup)
    taker.close()
    text = re.sub(r"[ \t\xa0]+", " ", "".join(taker.out))
    return re.sub(r"\s*\n\s*", "\n", text).strip()


def selected(markup: Column, selector: str) -> Column:
    steps = compiled(selector)

    def take(pages: pd.Series) -> pd.Series:
        return pd.Series([text_of(p, steps) for p in pages], dtype=object)

    return F.pandas_udf(take, T.StringType())(markup)
