import pytest

from tidemill.llm import page_body as pb
from tidemill.llm.page_markup import aligned, segments
from tidemill.tables import Scratch

SCHEMA = "id string, text string, markup string, title string, source string, author string, confidence double, key long, line_no int"
PROSE = "The patient harbour kept its ledgers open while the younger firms looked for reasons to close theirs early."


def page(name, broken=False):
    close = "" if broken else "</p>"
    blocks = [
        ("nav", "Home", '<header><ul><li><a href="/">Home</a></li></ul></header>'),
        ("title", f"Title {name}", f'<article class="c"><h1>Title {name}</h1>'),
        ("byline", "By Ann Lee", f"<p>By Ann Lee{close}"),
        ("body", f"{PROSE} {name}", f'<p class="t">{PROSE} <em>{name}</em>{close}'),
        ("promo", "Join 5 readers, free of charge.", '<div class="promo">Join 5 readers, free of charge.</div>'),
        ("body", "Why?", f'<p class="t">Why?{close}'),
        ("body", "A subhead here", "<h2>A subhead here</h2>"),
        ("body", "Caption &", "<figure><figcaption>Caption &amp;</figcaption></figure>"),
        ("note", f"Ann Lee: The Site. {PROSE}", f"<p><em>Ann Lee: The Site. {PROSE}</em>{close}</article>"),
        ("related", "Read next", "<h3>Read next</h3>"),
        ("related", "Another title", f'<p><a href="/p/1">Another title</a>{close}'),
        ("teaser", PROSE + " Teaser.", f"<p>{PROSE} Teaser.{close}"),
        ("promo", "Join 7 readers, free of charge.", '<div class="promo">Join 7 readers, free of charge.</div>'),
        ("comments", "3 comments", "<h3>3 comments</h3>"),
        ("comments", "Bob, 9:15", "<div>Bob, 9:15</div>"),
        ("comments", PROSE + " Comment.", f"<p>{PROSE} Comment.{close}"),
        ("footer", "© 2024 The Site", f"<footer><p>© 2024 The Site{close}</footer>"),
    ]
    text = "\n".join(b[1] for b in blocks)
    markup = "<html><head><title>x</title><script>var a='<p>';</script></head><body>\n" + "\n".join(b[2] for b in blocks) + "\n</body></html>"
    return text, markup, {i for i, b in enumerate(blocks) if b[0] not in ("title", "body")}


def found(spark, rows):
    out = {}
    for r in pb.furniture_lines(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect():
        out.setdefault(r["id"], set()).add(r["line_no"])
    return out


@pytest.mark.parametrize("broken", [False, True])
def test_lines_of_a_page(spark, broken):
    rows, want = [], {}
    for i in range(4):
        text, markup, cases = page(f"n{i}", broken)
        rows.append((f"p{i}", text, markup, f"Title n{i}", "the-site", "Ann Lee", None, 1, 2))
        want[f"p{i}"] = cases
    assert found(spark, rows) == want


def test_furniture_is_a_matter_of_the_site(spark):
    """A line that stands outside bodies on many sites, but on few pages of each, stays in a body; so does a rare one."""
    said = "Members of the circle read every letter two days before all others do."
    def one(i, site, inside):
        body = [f"Title n{i}", f"{PROSE} {i}", *([said] if inside else [])]
        outside = [] if inside else [said]
        markup = "<body><article><h1>" + body[0] + "</h1>" + "".join(f"<p>{x}</p>" for x in body[1:]) + "</article><div>" + "".join(f"<p>{x}</p>" for x in outside) + "</div></body>"
        return (f"{site}{i}", "\n".join(body + outside), markup, body[0], site, None, None, 1, 2)
    spread = [one(i, f"site{i}", False) for i in range(9)] + [one(50, "other", True)]
    assert "other50" not in found(spark, spread)
    assert found(spark, [one(i, "same", False) for i in range(9)] + [one(50, "same", True)])["same50"] == {2}


def test_odd_pages(spark):
    long = "\n".join(["Menu", *[PROSE * 3] * 2000, "© x"])
    rows = [("null", None, None, None, None, None, None, 1, 2), ("empty", "", "<p>", "t", "s", "a", 0.5, 1, 2), ("blank", " \n ", None, "t", "s", None, 0.5, 1, 2), ("plain", f"Menu\nHome\nTitle\n{PROSE}\n{PROSE}\n© 2024", None, "Title", "s", None, 0.5, 1, 2), ("notitle", f"a\n{PROSE}\n{PROSE}\nb", "<div><p>" + PROSE, None, None, None, 0.5, 1, 2), ("long", long, None, None, None, None, 0.1, 1, 2), (None, "x", None, None, None, None, None, 1, 2)]
    got = found(spark, rows)
    assert got["plain"] == {0, 1, 5} and not got.keys() & {"null", "empty", "blank"} and got["long"] == {0, 2001}
    df = spark.createDataFrame(rows, SCHEMA)
    bodies = {r["id"]: r for r in pb.bodies(df, pb.furniture_lines(df, Scratch(spark, "t"))).collect()}
    assert len(bodies) == 6 and bodies["null"]["body"] is None and bodies["plain"]["body"].startswith("Title\n")
    assert pb.furniture_lines(df.limit(0), Scratch(spark, "t")).count() == 0


def test_the_distribution_finds_the_surge_and_the_dive():
    assert pb.densest(["a", "b", PROSE, PROSE, PROSE, "c", "d"]) == (2, 5)
    assert pb.densest([]) == (0, 0) and pb.densest(["", " "]) == (0, 0)
    assert pb.densest([PROSE]) == (0, 1)


def test_alignment_of_crossed_markup():
    markup = "<body><div class=x><p>One <b>two</div> three &amp; four<li>five<!-- no --><style>p{}</style><div>six"
    lines = ["One two", "three & four", "five", "six"]
    assert all(line.found for line in aligned(lines, segments(markup)))
    assert segments("") == [] and segments("< p >") and not aligned(["nothing like it"], segments(markup))[0].found


def test_alignment_over_many_unmatched_segments(spark):
    menu = "".join(f'<td><a href="/{i}">Place {i}</a></td>' for i in range(400))
    rest = f'<p class="t">{PROSE} Second.</p><p class="t">{PROSE} Third.</p></article><footer><p>© 2024 The Site</p></footer>'
    markup = f'<body><article><h1>Title</h1><p class="t">{PROSE} First.</p><table><tr>{menu}</tr></table>{rest}</body>'
    text = "\n".join(["Title", f"{PROSE} First.", "A line of no markup at all stands in this very place.", f"{PROSE} Second.", f"{PROSE} Third.", "© 2024 The Site"])
    assert [m.found for m in aligned(text.split("\n"), segments(markup))] == [True, True, False, True, True, True]
    assert found(spark, [("p", text, markup, "Title", "the-site", None, None, 1, 2)]) == {"p": {5}}


def test_a_line_found_far_ahead_does_not_cost_the_rest():
    markup = "<p>one</p><p>two</p><p>three</p><p>more</p>"
    assert [m.found for m in aligned(["more", "one", "two", "three"], segments(markup))] == [False, True, True, True]
