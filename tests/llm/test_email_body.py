import datetime as dt

import pytest

from tidemill.llm import email_body as eb
from tidemill.tables import Scratch

SCHEMA = "id string, subject string, author string, sender string, at timestamp, text string, html string, key long, line_no int"
AT = dt.datetime(2026, 1, 1)


def cases(body, html=False, author="Ann Lee"):
    m = eb.Message(body, html, author)
    return {i for i in range(len(m.raw)) if m.case[i]}


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("Hi Bob,\n\nNew text.\n\nBest,\nAnn\nEditor at large", {4, 5, 6}),
        ("New.\n\n-- \nAnn Lee\nhttps://x.example", {2, 3, 4}),
        ("New.\n\nOn 5/14/25, Bob Ray wrote:\n> Old\n> > Older\nrest\n\nMore new.", {2, 3, 4, 5}),
        ("New.\r\n\r\nFrom: Bob Ray <b@x.example>\r\nSent: 3/26/25\r\nTo: Ann\r\nSubject: x\r\n\r\nOld.\r\n", {2, 3, 4, 5, 7}),
        ("Am 7/17/23 schrieb Zoë Tollandry:\n| Alt\n\nNeu.\n| Alt\n", {0, 1, 4}),
        ("El 2025-09-24 11:02, Ana Paz <a@x.example>\nescribió:\n    Viejo\n    viejo\n\nNuevo.", {0, 1, 2, 3}),
        ("2024-10-16 12:16, Pascoe Dunmoreth:\nOld text\nto the end", {0, 1, 2}),
        ("New.\n\nSent from my pocket slate", {2}),
        ("New.\n\nYou get this letter because you joined the list of X.\nLeave the list: https://x.example/1", {2, 3}),
        ("New.\n\nPlease think of the trees before printing. If you received it in\nerror, delete it.", {2, 3}),
        ("-- that was my first thought, at least.\nOn Monday we wrote: less is more.\na > b in the table\nTo: or not to, that was the joke.\nFrom: the first page on, it is better.\nRegards to the whole desk, they did well.\nSent three notes already, none came back.", set()),
        ("New.\n\n---------- Forwarded message ---------\nFrom: Bob Ray <b@x.example>\nSubject: y\n\nOld", {2, 3, 4, 6}),
        ("> \n>\n\n", set()),
        ("", set()),
    ],
)
def test_text_bodies(body, wanted):
    assert cases(body) == wanted


def test_html_bodies():
    body = '<html><body>\n<p>New &gt; old</p>\n<div>On 7/11/24, Zoë Ray &lt;z@x.example&gt; wrote:</div>\n<div class="prior">\n<div>Old</div>\n<blockquote>\nOlder<br>\n</blockquote>\n</div>\n<p>New again</p>\n<br>\n<p>-- </p>\n<p>Ann</p>\n</body></html>'
    assert cases(body, True) == {2, 4, 6, 11, 12}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def lines(spark, rows):
    return {(r["id"], r["line_no"]) for r in eb.not_newly_written(frame(spark, rows), Scratch(spark, "t")).collect()}


def test_history_without_marks_is_found_by_the_thread(spark):
    said = "The harbour closed its ledgers on a cold morning in the north of the country."
    rows = [
        ("m1", "Plan", "Ann", "ann@x", AT, said, None), ("m2", "RE: plan", "Bob", "bob@x", AT + dt.timedelta(days=1), f"I agree.\n\n{said}", None),
        ("m3", "Fwd: Re: Plan", "Ann", "ann@x", AT + dt.timedelta(days=2), said, None), ("m4", "Other", "Cy", "cy@x", AT + dt.timedelta(days=3), said, None), ("m5", None, "Cy", "cy@x", AT, said, None),
    ]
    assert lines(spark, rows) == {("m2", 2)}


def test_short_lines_and_own_repeats_count_beside_history(spark):
    said = "The harbour closed its ledgers on a cold morning in the north of the country."
    more = "Nobody in the south had heard of it before the second week of the month."
    rows = [
        ("m1", "Plan", "Ann", "ann@x", AT, f"{said}\nWhy?\n{more}", None), ("m2", "Re: Plan", "Bob", "bob@x", AT + dt.timedelta(1), f"Yes.\n\n{said}\nWhy?\n{more}", None),
        ("m3", "Re: Plan", "Ann", "ann@x", AT + dt.timedelta(2), f"Again:\n{said}\nWhy?\nWell.", None), ("m4", "Plan", "Cy", "cy@x", AT + dt.timedelta(3), said, None), ("m5", "Re: Plan", "Ann", "ann@x", AT + dt.timedelta(4), f"Once more\n{said}\nnew", None),
        ("m6", "Re: Plan", "Di", "di@x", AT + dt.timedelta(5), "Why?", None),
    ]
    assert lines(spark, rows) == {("m2", 2), ("m2", 3), ("m2", 4), ("m3", 1), ("m3", 2)}


def test_a_hot_thread_is_ranked_salt_by_salt(spark):
    said = "The harbour closed its ledgers on a cold morning in the north of the country."
    rows = [(f"m{i:03d}", "Re: Hot", f"A{i}", f"a{i}@x", AT + dt.timedelta(hours=(i * 37) % 200), f"Own text of number {'abcdefghij'[i % 10] * (i + 3)}.\n\n{said}", None) for i in range(200)]
    first = min(rows, key=lambda r: (r[4], r[0]))[0]
    assert lines(spark, rows) == {(r[0], 2) for r in rows if r[0] != first}


def test_lines_that_close_a_senders_messages(spark):
    rows = [(f"m{i}", None, "Ann", "ann@x", AT, f"Text number {'abcdefgh'[i]} of this kind.\n\nOnward and upward, as ever", None) for i in range(6)]
    rows += [("o", None, "Bob", "bob@x", AT, "Text.\n\nOnward and upward, as ever", None)]
    assert lines(spark, rows) == {(f"m{i}", 2) for i in range(6)}


def test_odd_messages(spark):
    rows = [("n", None, None, None, None, None, None), ("e", "", "", "", AT, "", "<p>x</p>"), ("h", "s", "A", "a@x", AT, None, "<p>-- </p>\n<p>A</p>"), (None, "s", "A", "a@x", AT, "> x", None), ("l", "s", "A", "a@x", AT, "word " * 60_000 + "\n> x", None)]
    assert lines(spark, rows) == {("h", 0), ("h", 1), ("l", 1)}
    df = frame(spark, rows)
    got = {r["id"]: r["body"] for r in eb.bodies(df, eb.not_newly_written(df, Scratch(spark, "t"))).collect()}
    assert got["n"] is None and got["e"] == "" and got["l"].startswith("word") and len(got) == 4
    assert eb.not_newly_written(df.limit(0), Scratch(spark, "t")).count() == 0
