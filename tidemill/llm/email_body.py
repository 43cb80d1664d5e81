"""Reducing emails to what their sender newly wrote.

A message's lines are normalised and exploded. Across messages SQL windows rank the lines of a thread by date: of the
lines with the same words the first is its author's own; those of a later reply or forward are history, long lines at
once, short ones and those of the same sender where the line before or after is history too. Lines of a message's last
paragraph that recur in a good part of their sender's messages are closing lines. Windows are taken salt by salt first, so
a thread or sender with a third of all mail stays spread.

Where earlier mail isn't in the table under the same subject, or is dated later, windows can't see it. So inside one
message, quotes (marks, indentation, quoting elements of HTML), the lines that introduce earlier messages, signatures,
device notes, disclaimers and list footers are told by their form first; the README says how much either stage finds.

Defined cases: the body is the text body, or the HTML body if the text is null; both null or empty give no rows; lines
without visible text beyond tags and quote marks are no cases; the latest of several rows of one message holds; rows
without id are dropped; null subjects make no thread, null senders no recurrence; messages without a reply or forward
mark in their subject continue no thread; ties in time go to the smaller id; other columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

import html

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ..tables import Scratch
from .arrow import list_array, map_arrow

LONG_LETTERS, SALTS = 40, 32
RECUR_MESSAGES, RECUR_SHARE = 3, 0.2

# How mail programs and writers of three languages mark earlier mail and endings.
_DATE = r"(?:\d{1,2}[/.]\d{1,2}[/.]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:\p{L}{2,12}\.?,? )?\d{1,2}\.? \p{L}{3,12}\.? \d{4}|\p{L}{3,9} \d{1,2}, \d{4})(?:,?(?: at| um| a las)? \d{1,2}:\d{2}(?::\d{2})?(?: ?[ap]m)?)?"
_WHO = r"[^\s:<>|][^:<>|]{0,80}?(?: ?<[^>\s]+@[^>\s]+> ?)?"
_ATTRIBUTION = regex.compile(
    rf"^(?:on {_DATE},? {_WHO} ?wrote ?:"
    rf"|{_WHO} ?wrote on {_DATE} ?:"
    rf"|(?:at|on) {_DATE},? {_WHO} ?said ?:"
    rf"|am {_DATE},? schrieb {_WHO} ?:"
    rf"|{_WHO} ?schrieb am {_DATE} ?:"
    rf"|el {_DATE},? {_WHO} ?escribió ?:"
    rf"|{_WHO} ?escribió el {_DATE} ?:"
    rf"|{_DATE},? {_WHO} ?:)$",
    regex.I,
)
_OPENS = regex.compile(rf"^(?:(?:on|at|am|el) {_DATE}|{_DATE}, \p{{Lu}}|\p{{Lu}}[\p{{L}}'’-]+ \p{{Lu}}[\p{{L}}'’-]+.{{0,80}}(?:wrote|schrieb|escribió|>)|\p{{Lu}}.*<[^>]+@[^>]+>)", regex.I)
_FROM = regex.compile(r"^\*?(?:from|von|de) ?:\*? ?\S", regex.I)
_FIELD = regex.compile(r"^\*?(?:from|sent|date|to|cc|bcc|subject|reply-to|von|gesendet|datum|an|kopie|betreff|de|enviado(?: el)?|fecha|para|asunto) ?:\*?(?: |$)", regex.I)
_WHEN = regex.compile(rf"^\*?(?:sent|date|gesendet|datum|enviado(?: el)?|fecha) ?:\*? ?(?:\p{{L}}+,? )?{_DATE}", regex.I)
_RULER = regex.compile(r"^(?:_{8,}|-{2,} ?(?:original message|forwarded message|ursprüngliche nachricht|originalnachricht|weitergeleitete nachricht|mensaje original|mensaje reenviado) ?-{2,}|begin forwarded message ?:|anfang der weitergeleiteten nachricht ?:|inicio del mensaje reenviado ?:)$", regex.I)
_RULED = regex.compile(r"^-{4,} ?\p{L}[\p{L} ]{3,40}\p{L} ?-{4,}$")
_DELIMITER = regex.compile(r"^(?:--|—|__|–) ?$")
_CLOSINGS = frozenset(
    "best|best regards|best wishes|all the best|cheers|kind regards|warm regards|regards|yours|yours sincerely|yours truly|yours faithfully|sincerely|thanks|thanks again|many thanks|thank you|warmly|take care"
    "|mit freundlichen grüßen|freundliche grüße|beste grüße|viele grüße|liebe grüße|herzliche grüße|schöne grüße|herzlich|gruß|grüße|danke|vielen dank|besten dank|mfg|lg"
    "|un saludo|saludos|saludos cordiales|un cordial saludo|atentamente|gracias|muchas gracias|un abrazo|cordialmente".split("|")
)
_DEVICE = regex.compile(r"^(?:sent from (?:my|a|an|the) |get \p{Lu}\w+ for |(?:von meine[mr] .* |vom .* )gesendet|enviado desde (?:mi|un|una) )", regex.I)
_LIST = regex.compile(
    r"^(?:you (?:get|receive|are receiving|received) this (?:letter|mail|e-?mail|message) because|leave the list|unsubscribe|manage your (?:letters|subscription|preferences)|view in browser"
    r"|sie erhalten diese[ns]? |abmelden|abbestellen|briefe verwalten|im browser (?:ansehen|öffnen)|recibe esta carta porque|darse de baja|gestionar |gestione |ver en el navegador)",
    regex.I,
)
_NOTICE = regex.compile(
    r"^(?:\* ?|confidential(?:ity)?(?: notice)? ?: ?|vertraulich ?: ?|confidencial ?: ?)*(?:this (?:message|e-?mail) (?:is|and|may|contains)|please (?:think of the trees|consider the environment)|opinions here|if you (?:received|are not|have received)|no contract is formed"
    r"|diese (?:nachricht|mail|e-?mail) |bitte (?:denken sie|an die)|wenn sie diese|falls sie|bei irrläufern|aus dieser (?:mail|e-?mail|nachricht)|este (?:mensaje|correo)|esta (?:comunicación|nachricht)|si (?:lo|la|usted|ha) (?:recibió|recibido|no)|las opiniones|piense en|antes de imprimir|no imprima|este correo no)"
    r"|^(?:confidential|confidentiality notice|vertraulich|confidencial) ?:",
    regex.I,
)
_MARK = regex.compile(r"^\s*(?:[>|](?:\s|$|[>|])|[>|](?=\S)(?![|]))")
_MARKS = regex.compile(r"^[\s>|]+")
_INDENT = regex.compile(r"^ {4,}\S")
_TAG = regex.compile(r"<[^>]*>")
_ELEMENT = regex.compile(r"<(/?)(blockquote|div)\b([^>]*)>", regex.I)
_QUOTING = regex.compile(r"(?:class|id)\s*=\s*[\"']?[^\"'>]*(?:prior|quote|history|reply|forward|appendonsend|original)", regex.I)
_PREFIX = regex.compile(r"^\s*(?:(?:re|fw|fwd|aw|wg|rv|tr|antw|reenv)(?:\[\d+\])?\s*:\s*)+", regex.I)
_NOT_LETTERS = regex.compile(r"\P{L}+")
_NUMBERS = regex.compile(r"\p{N}+")
# What the patterns above can begin with; lines that begin otherwise needn't be held against them.
_ENDING_STARTS = tuple("sent get von vom enviado you leave unsubscribe manage view sie abmelden abbestellen briefe im recibe darse gestion ver * confiden vertraulich this please opinions if no diese bitte wenn falls bei aus este esta si las piense antes".split())
_RULER_STARTS = ("_", "-", "begin", "anfang", "inicio")
_FROM_STARTS = ("from", "von", "de", "*from", "*von", "*de")


def thread_key(subject: str | None) -> str | None:
    bare = " ".join(_PREFIX.sub("", subject or "").lower().split())
    return bare or None


class Message:
    """Lines of one body with `case` set for what its sender didn't newly write."""

    def __init__(self, body: str, is_html: bool, author: str | None):
        self.raw = [line.rstrip("\r") for line in body.split("\n")]
        n = len(self.raw)
        self.names = {w for w in _NOT_LETTERS.split((author or "").lower()) if w}
        self.quoted = np.zeros(n, dtype=bool)
        self.shown = self._html() if is_html else self.raw
        self.known: dict[int, int] = {}
        self.text = [_MARKS.sub("", line).strip() if line.lstrip()[:1] in (">", "|") else line.strip() for line in self.shown]
        self.seen = np.array([bool(t) for t in self.text])
        self.case = np.zeros(n, dtype=bool)
        self._marks()
        self._history()
        self._endings()
        self.case &= self.seen

    def _html(self) -> list[str]:
        shown, stack, depth = [], [], 0
        for i, line in enumerate(self.raw):
            inside = depth > 0
            for m in _ELEMENT.finditer(line):
                tag = m[2].lower()
                if m[1]:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            depth -= sum(q for _, q in stack[k:])
                            del stack[k:]
                            break
                else:
                    quoting = tag == "blockquote" or bool(_QUOTING.search(m[3]))
                    stack.append((tag, quoting))
                    depth += quoting
                    inside = inside or quoting
            shown.append(html.unescape(_TAG.sub("", line)).replace("\xa0", " "))
            self.quoted[i] = inside
        return shown

    def _marks(self) -> None:
        for i, line in enumerate(self.shown):
            if line.lstrip()[:1] in (">", "|") and _MARK.match(line):
                self.quoted[i] = True
        # Indentation quotes only where a line of introduction stands before it.
        introduced = False
        for i, line in enumerate(self.shown):
            if not self.quoted[i] and self.seen[i] and not _INDENT.match(line):
                introduced = introduced or self._introduces(i) > 0
            elif introduced and _INDENT.match(line):
                self.quoted[i] = True
        # A quoted line that was wrapped leaves its rest unmarked on the next line.
        for i in range(1, len(self.shown)):
            if self.seen[i] and not self.quoted[i] and self.quoted[i - 1] and self.seen[i - 1] and self._marked(i - 1) and not self._introduces(i) and (i + 1 >= len(self.shown) or not self.seen[i + 1] or self.quoted[i + 1]):
                self.case[i] = True
        self.case |= self.quoted

    def _marked(self, i: int) -> bool:
        return bool(_MARK.match(self.shown[i]) or _INDENT.match(self.shown[i]))

    def _introduces(self, i: int) -> int:
        """How many lines from i on introduce an earlier message, 0 if none."""
        if i not in self.known:
            self.known[i] = self._introduction(i)
        return self.known[i]

    def _introduction(self, i: int) -> int:
        line = self.text[i]
        if line.endswith(":") and _ATTRIBUTION.match(line):
            return 1
        if any(t.endswith(":") for t in self.text[i + 1 : i + 3]) and _OPENS.match(line):
            joined, at = line, i
            for _ in range(2):
                at += 1
                if at >= len(self.text) or not self.text[at]:
                    break
                joined += " " + self.text[at]
                if _ATTRIBUTION.match(joined):
                    return at - i + 1
        low = line[:8].lower()
        if low.startswith(_RULER_STARTS) and (_RULER.match(line) or _RULED.match(line)):
            return 1 + self._header(i + 1)
        return self._header(i) if low.startswith(_FROM_STARTS) else 0

    def _header(self, i: int) -> int:
        """The length of a block of header fields that begins at i (blank lines before it count)."""
        start = i
        while i < len(self.text) and not self.text[i] and i < start + 2:
            i += 1
        if i >= len(self.text) or not _FROM.match(self.text[i]):
            return 0
        fields = 0
        when = False
        j = i
        while j < len(self.text) and _FIELD.match(self.text[j]):
            fields += 1
            when = when or bool(_WHEN.match(self.text[j]))
            j += 1
        return j - start if fields >= 2 and (when or "@" in self.text[i]) else 0

    def _history(self) -> None:
        i, n = 0, len(self.text)
        while i < n:
            if not self.seen[i] or self.quoted[i]:
                i += 1
                continue
            length = self._introduces(i)
            if not length:
                i += 1
                continue
            self.case[i : i + length] = True
            after = i + length
            while after < n and not self.seen[after]:
                after += 1
            if after < n and not self.quoted[after]:
                self.case[after:] = True  # unmarked history runs to the end
                return
            i = max(after, i + 1)

    def _endings(self) -> None:
        """Signatures and notices: from their first line to the end of what is the sender's own part."""
        n = len(self.text)
        own = [i for i in range(n) if self.seen[i] and not self.case[i]]
        start = None
        for place, i in enumerate(own):
            line = self.text[i]
            if len(line) < 4 and _DELIMITER.match(line):
                start = place
                break
            if line.rstrip(" ,.!;").lower() in _CLOSINGS and place >= 0:
                following = own[place + 1] if place + 1 < len(own) else None
                if following is None or self._name(self.text[following]) or _DEVICE.match(self.text[following]) or _LIST.match(self.text[following]) or _NOTICE.match(self.text[following]) or following > i + 1:
                    start = place
                    break
            if not line[:12].lower().startswith(_ENDING_STARTS):
                continue
            if _DEVICE.match(line) or _LIST.match(line):
                start = place
                break
            if _NOTICE.match(line) and (line[0] in "*C" or place == 0 or own[place - 1] != i - 1 or not self._running(i - 1)):
                start = place
                break
        if start is None:
            last = self.last_paragraph()
            if last and self.text[last[0]].startswith("* ") and not any(self.text[i].startswith("* ") for i in last[1:]):
                start = own.index(last[0])  # a single starred paragraph at the end
        if start is not None:
            for i in own[start:]:
                self.case[i] = True

    def _running(self, i: int) -> bool:
        """A line of prose that goes on in the next line."""
        return not self.text[i].endswith((".", "!", "?", ":", "…"))

    def _name(self, line: str) -> bool:
        words = [w for w in _NOT_LETTERS.split(line.lower()) if w]
        return bool(words) and len(words) <= 5 and (set(words) <= self.names or (self.text.count(line) >= 1 and bool(set(words) & self.names)) or not self.names)

    def last_paragraph(self) -> list[int]:
        """The visible own lines of the last paragraph, if it isn't the only one."""
        own = [i for i in range(len(self.text)) if self.seen[i] and not self.case[i]]
        if not own:
            return []
        block = [own[-1]]
        for i in reversed(own[:-1]):
            if i != block[-1] - 1:
                return block[::-1] if i in own else []
            block.append(i)
        return []


JUDGED = "id string, sender string, thread string, reply boolean, at timestamp, cases array<int>, own array<int>, own_keys array<long>, long_ones array<boolean>, closing array<int>, closing_keys array<long>"


def judged(messages: DataFrame) -> DataFrame:
    """One row per message: lines told by form, and keys of the others. `messages`: id, subject, author, sender, at, text, html."""

    def make(part: pa.RecordBatch) -> dict:
        ids, subjects, authors, senders, times, texts, pages = (part.column(k) for k in range(7))
        outs: tuple[list, ...] = ([], [], [], [], [], [])
        empty = np.empty(0, dtype=np.int64)
        for author, text, page in zip(authors.to_pylist(), texts.to_pylist(), pages.to_pylist()):
            body = text if text is not None else page
            if not body:
                for out in outs:
                    out.append(empty)
                continue
            m = Message(body, text is None, author)
            kept, keys, far = [], [], []
            for i in np.flatnonzero(m.seen & ~m.case).tolist():
                bare = "".join(filter(str.isalpha, m.text[i].lower()))
                if bare:
                    kept.append(i)
                    keys.append(xxhash.xxh3_64_intdigest(bare) - (1 << 63))
                    far.append(len(bare) >= LONG_LETTERS)
            last = m.last_paragraph()
            closing_keys = [xxhash.xxh3_64_intdigest(_NUMBERS.sub("#", m.text[i].lower())) - (1 << 63) for i in last]
            for out, values in zip(outs, (np.flatnonzero(m.case), kept, keys, far, last, closing_keys)):
                out.append(np.array(values, dtype=np.int64))

        def column(rows, kind):
            return list_array(np.concatenate(rows).astype(kind.to_pandas_dtype()), np.fromiter(map(len, rows), np.int64, len(rows)), kind)

        i32, i64 = pa.int32(), pa.int64()
        subjects = subjects.to_pylist()
        kinds = {"cases": i32, "own": i32, "own_keys": i64, "long_ones": pa.bool_(), "closing": i32, "closing_keys": i64}
        named = {"id": ids, "sender": senders, "thread": [thread_key(s) for s in subjects], "reply": [bool(s and _PREFIX.match(s)) for s in subjects], "at": times}
        return named | {name: column(rows, kind) for (name, kind), rows in zip(kinds.items(), outs)}

    chosen = messages.select("id", "subject", "author", F.lower(F.trim("sender")).alias("sender"), "at", "text", "html")
    return map_arrow(chosen, JUDGED, None, make)


def first_of(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The first line of each group by date and id, ranked within salts before it is ranked among their firsts."""
    order = [F.col("at").asc_nulls_first(), F.col("id"), F.col("line_no")]
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for part in ([*keys, "salt"], keys):
        salted = salted.withColumn("n", F.row_number().over(W.partitionBy(*part).orderBy(*order))).filter(F.col("n") == 1)
    return salted.drop("salt", "n")


def repeated_of_thread(found: DataFrame) -> DataFrame:
    """id and line_no of lines of replies and forwards that another message of the thread said first."""
    lines = found.filter("thread is not null").select("id", "thread", "sender", "reply", "at", F.explode(F.arrays_zip(F.col("own").alias("line_no"), F.col("own_keys").alias("key"), F.col("long_ones").alias("far"))).alias("l"))
    lines = lines.select("id", "thread", "sender", "reply", "at", "l.line_no", "l.key", "l.far")
    # Threads of one message have nothing to compare.
    several = found.filter("thread is not null").groupBy("thread").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("thread")
    lines = lines.join(several, "thread")
    first = first_of(lines, ["thread", "key"]).select("thread", "key", F.col("id").alias("first_id"), F.col("sender").alias("first_sender"))
    met = lines.join(first, ["thread", "key"]).withColumn("later", F.col("reply") & (F.col("id") != F.col("first_id"))).withColumn("other", ~F.col("sender").eqNullSafe(F.col("first_sender")))
    w = W.partitionBy("id").orderBy("line_no")
    beside = F.coalesce(F.lag("later").over(w), F.lit(False)) | F.coalesce(F.lead("later").over(w), F.lit(False))
    return met.withColumn("beside", beside).filter(F.col("later") & ((F.col("far") & F.col("other")) | F.col("beside"))).select("id", "line_no")


def recurrent_of_sender(found: DataFrame) -> DataFrame:
    """id and line_no of closing lines that stand in enough of their sender's messages."""
    known = found.filter("sender is not null")
    ends = known.select("id", "sender", F.explode(F.arrays_zip(F.col("closing").alias("line_no"), F.col("closing_keys").alias("key"))).alias("l")).select("id", "sender", "l.line_no", "l.key")
    sent = known.groupBy("sender").agg(F.count(F.lit(1)).alias("sent"))
    counted = ends.groupBy("sender", "key", "id").agg(F.lit(1).alias("one")).groupBy("sender", "key").agg(F.count("one").alias("n")).join(sent, "sender")
    recur = counted.filter((F.col("n") >= RECUR_MESSAGES) & (F.col("n") >= RECUR_SHARE * F.col("sent"))).select("sender", "key")
    return ends.join(recur, ["sender", "key"], "left_semi").select("id", "line_no")


def not_newly_written(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """id and line_no (from 0) of every line with visible text that its sender didn't newly write."""
    found = scratch.cut(judged(messages.filter("id is not null")))
    by_form = found.select("id", F.explode("cases").alias("line_no"))
    return by_form.unionByName(repeated_of_thread(found)).unionByName(recurrent_of_sender(found)).distinct()


def bodies(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """id and the newly written text of every message (tags and markup of HTML bodies stay on their lines)."""
    gone = lines.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    body = F.coalesce("text", "html")
    kept = F.filter(F.split(body, "\n"), lambda line, i: F.col("gone").isNull() | ~F.array_contains("gone", i))
    out = messages.filter("id is not null").join(gone, "id", "left")
    return out.select("id", F.when(body.isNotNull(), F.trim(F.regexp_replace(F.concat_ws("\n", kept), r"\n{3,}", "\n\n"))).alias("body"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))
