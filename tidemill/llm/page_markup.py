"""Reading pages of any state of markup: their text segments, and the segments behind each line of their text."""

from __future__ import annotations

import html
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import regex

_TOKEN = regex.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>", regex.S)
_CLASS = regex.compile(r"""class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", regex.I)
_SPACE = regex.compile(r"\s+")
# Elements by their part in a page.
SILENT = frozenset("script style noscript template head title svg".split())
BOXES = frozenset("html body div article section main aside header footer nav table tbody thead tr td th ul ol dl form figure blockquote details".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 figcaption time dt dd pre address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Box:
    tag: str
    kind: str  # its class attribute
    number: int
    spoken: bool = False  # holds text of its own


@dataclass
class Segment:
    text: str  # without white space
    boxes: tuple[Box, ...]
    leaf: str
    kind: str  # class of the leaf, or of the innermost box
    linked: bool


@dataclass
class Line:
    segments: list[Segment] = field(default_factory=list)

    @property
    def found(self) -> bool:
        return bool(self.segments)

    @property
    def boxes(self) -> tuple[Box, ...]:
        return self.segments[0].boxes if self.segments else ()

    @property
    def leaf(self) -> str:
        return self.segments[0].leaf if self.segments else ""

    @property
    def kind(self) -> str:
        return self.segments[0].kind if self.segments else ""

    @property
    def linked(self) -> bool:
        return bool(self.segments) and all(s.linked for s in self.segments)


def bare(text: str) -> str:
    return _SPACE.sub("", text)


def segments(page: str) -> list[Segment]:
    """The page's text between tags, with the boxes it stands in. Unclosed and crossed elements are closed as met."""
    out: list[Segment] = []
    stack: list[Box] = []
    leaf, leaf_kind, links, spans, silent, number, at = "", "", 0, 0, "", 0, 0

    def say(raw: str) -> None:
        text = bare(html.unescape(raw))
        if text and not silent:
            if stack and not leaf and not links and not spans:
                stack[-1].spoken = True
            out.append(Segment(text, tuple(stack), leaf, leaf_kind if leaf else (stack[-1].kind if stack else ""), links > 0))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if silent:
            if closing and tag == silent:
                silent = ""
            continue
        if tag in SILENT:
            if not closing and not m[3].rstrip().endswith("/"):
                silent = tag
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag in LEAVES:
            links = spans = 0
            if closing:
                leaf, leaf_kind = "", ""
            else:
                if stack and stack[-1].tag == "div" and stack[-1].spoken:
                    stack.pop()
                leaf, leaf_kind = tag, _kind(m[3])
        elif tag in BOXES:
            links, spans, leaf, leaf_kind = 0, 0, "", ""
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if tag == "div" and stack[i].tag in ("article", "section", "main", "aside", "header", "footer", "nav"):
                        break  # a stray end of a div doesn't close what is around it
            else:
                if stack and stack[-1].tag == "div" and stack[-1].spoken:
                    stack.pop()
                number += 1
                stack.append(Box(tag, _kind(m[3]), number))
        elif tag == "span":
            spans = 0 if closing else 1
            if not closing and stack and stack[-1].tag == "div" and stack[-1].spoken and page[max(0, m.start() - 1) : m.start()] == "\n":
                stack.pop()
    if at < len(page):
        say(page[at:])
    return out


def _kind(attributes: str) -> str:
    m = _CLASS.search(attributes)
    return (m[1] or m[2] or m[3] or "").strip() if m else ""


def aligned(lines: list[str], found: list[Segment]) -> list[Line]:
    """For each line of the text the segments it was made of; both stand in page order.

    Each line takes its next occurrence, however far ahead; if that costs a later line, the longest chain is taken.
    """
    offsets = [0]
    for s in found:
        offsets.append(offsets[-1] + len(s.text))
    ends = {offset: i for i, offset in enumerate(offsets)}
    text = "".join(s.text for s in found)
    starts: dict[str, list[int]] = {}
    for i, s in enumerate(found):
        starts.setdefault(s.text, []).append(i)
    lengths = sorted({len(x) for x in starts})
    known: dict[str, list[tuple[int, int]]] = {"": []}

    def places(want: str) -> list[tuple[int, int]]:
        if want not in known:
            first = [i for n in lengths[: bisect_right(lengths, len(want))] for i in starts.get(want[:n], ())]
            known[want] = [(i, ends[offsets[i] + len(want)]) for i in sorted(first) if offsets[i] + len(want) in ends and text.startswith(want, offsets[i])]
        return known[want]

    wanted = [places(bare(line)) for line in lines]
    taken: dict[int, tuple[int, int]] = {}
    at = 0
    for k, spans in enumerate(wanted):
        next_one = bisect_left(spans, (at, 0))
        if next_one < len(spans):
            taken[k] = spans[next_one]
            at = spans[next_one][1]
    if len(taken) < sum(map(bool, wanted)):
        taken = _longest_chain(wanted)
    return [Line(found[slice(*taken[k])]) if k in taken else Line() for k in range(len(lines))]


def _longest_chain(wanted: list[list[tuple[int, int]]]) -> dict[int, tuple[int, int]]:
    """The most lines with a span each, in order and without overlap; of chains of one length the one that ends first."""
    least: list[int] = []  # end of the chain of each length
    last: list[tuple] = []
    for k, spans in enumerate(wanted):
        for span in reversed(spans):
            n = bisect_right(least, span[0])
            chain = (k, span, last[n - 1] if n else None)
            if n == len(least):
                least.append(span[1])
                last.append(chain)
            elif span[1] < least[n]:
                least[n], last[n] = span[1], chain
    out, chain = {}, last[-1] if last else None
    while chain:
        k, span, chain = chain
        out[k] = span
    return out
