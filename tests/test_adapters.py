import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as tx, validation as va
from tidemill.sources import adapters as ad
from tidemill.sources.selectors import compiled, selected, text_of
from tidemill.tables import is_small, latest_of_wide

from .conftest import rows

PAGE = '<html><body><nav class="a b"><a href="/x">Menu</a></nav><article class="post big"><h1 id="t">A &amp; B</h1><div class="longform"><p>One<br>two</p><script>no()</script><p>three<div class="longform">in</div></article><p>out'


@pytest.mark.parametrize("selector, want", [("h1", "A & B"), ("#t", "A & B"), ("article.post .longform", "One\ntwo\nthree\nin"), (".a a", "Menu"), ('a[href^="/"]', "Menu"), ("[href]", "Menu"), ("section p", ""), ("article p", "One\ntwo\nthree\nin")])
def test_selectors(selector, want):
    assert text_of(PAGE, compiled(selector)).replace("\n\n", "\n") == want


def test_selected_column_and_bad_selectors(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("",), ("< no",)], "h string")
    assert [r[0] for r in df.select(selected(F.col("h"), "h1")).collect()] == ["A & B", None, "", ""]
    with pytest.raises(ValueError):
        compiled("a > b")


def test_scan_stops_where_a_page_fails(spark):
    pages = spark.createDataFrame([("s", 1, 200, 2), ("s", 2, 200, 1), ("s", 3, 404, 0), ("s", 4, 200, 5), ("t", 1, 404, 1), ("u", 1, 200, 0), ("u", 2, 200, 3)], "source_id string, page int, status int, n int")
    assert rows(ad.reached(pages, F.col("n")).select("source_id", "page")) == [("s", 1), ("s", 2), ("t", 1)]


def test_bodies_inline_deferred_and_previews(spark):
    src = ad.Source("s", "feed", "https://s.example", selector="article p", stop="(?i)THE END")
    df = spark.createDataFrame([("a", "<p>Inline text. The end. More</p>", None), ("b", None, PAGE), ("c", "", "<p>x</p>"), ("d", "<p>This post is for paid subscribers</p>", None)], "link string, inline string, fetched string")
    got = {r["link"]: (r["text"], r["error"]) for r in ad.bodies(df, src).collect()}
    assert got["a"] == ("Inline text.", None) and got["b"][1] is None and got["c"][1] == "no_body" and got["d"][1] == "partial_preview"
    bare = {r["link"]: r["error"] for r in ad.bodies(df, ad.Source("s", "feed", "https://s.example")).collect()}
    assert bare["b"] == "no_selector" and bare["a"] is None


def test_sitemap_fills_up_only_if_asked(spark):
    src = ad.Source("s", "sitemap", "https://s.example", deny="^links-for-")
    listed = spark.createDataFrame([("s", "https://s.example/p/one", "One")], "source_id string, link string, title string")
    xml = "".join(f"<loc>https://s.example/p/{x}#top</loc>" for x in ("one", "links-for-may", "big-cat", "big-cat")) + "<loc>https://t.example/p/y</loc>"
    maps = spark.createDataFrame([("s", 200, xml), ("s", 429, "<loc>https://s.example/p/refused</loc>")], "source_id string, status int, body string")
    assert ad.with_sitemap(listed, maps, src, 1).count() == 1
    assert rows(ad.with_sitemap(listed, maps, src, 2).select("link", "title")) == [("https://s.example/p/big-cat", "Big Cat"), ("https://s.example/p/one", "One")]


def test_registry_knows_each_source_once():
    reg = ad.Registry()
    reg.add(ad.Source("a", "feed", "https://a.example"))
    assert reg["a"].kind == "feed"
    with pytest.raises(ValueError):
        reg.add(ad.Source("a", "index", "https://b.example"))


def test_page_source(spark, tmp_path):
    (tmp_path / "https%3A%2F%2Fa.example%2F").write_text("hello é")
    (tmp_path / "big").write_bytes(b"x" * (ad.MOST_BYTES + 5))
    spark.dataSource.register(ad.PageSource)
    got = {r["url"]: r for r in spark.read.format("fetched_pages").load(str(tmp_path)).collect()}
    assert got["https://a.example/"]["body"] == "hello é" and got["https://a.example/"]["whole"]
    assert not got["big"]["whole"] and len(got["big"]["body"]) == ad.MOST_BYTES


def test_verdicts_and_fields(spark):
    sound = '{"version": "standalone-v1", "format": "media", "reason": "r", "bodyEvidence": ["a  b"]}'
    df = spark.createDataFrame([(sound,), (sound.replace("media", "novel"),), (sound[:-4],), (None,), (sound.replace('["a  b"]', "[]"),)], "c string")
    assert [r[0] for r in df.select(va.valid_verdict(va.verdict(F.col("c")))).collect()] == [True, False, False, False, False]
    texts = spark.createDataFrame([("x a b y", "a  b"), ("z" * 90, "z" * 85 + "q"), (None, "a"), ("a", None)], "t string, q string")
    assert [r[0] for r in texts.select(va.quoted(F.col("t"), F.col("q"))).collect()] == [True, True, False, False]


def test_keywords_fences_and_chunks(spark):
    df = spark.createDataFrame([("t", ["a", "t", "a​", "why?", None, " "]), (None, None)], "t string, k array<string>")
    assert [r[0] for r in df.select(tx.keywords(F.col("t"), F.col("k"), ["t", "u", "v"])).collect()] == [["t", "a", "u"], ["t", "u", "v"]]
    f = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 1}',), (None,)], "x string")
    assert [r[0] for r in f.select(tx.unfenced(F.col("x"))).collect()] == ['{"a": 1}', '{"a": 1}', None]
    text = " ".join(f"Sentence number {i} stands here." for i in range(300))
    pieces = tx.chunk_text(text, 400, 60, 0.5)
    at = 0
    for p in pieces:
        at = text.index(p, max(0, at - 60))
        assert len(p) <= 401 and (p.endswith(".") or p is pieces[-1])
        at += len(p)
    assert at == len(text) and tx.chunk_text("", 5, 1, 0.5) == [""] and "".join(tx.chunk_text("x" * 23, 10, 0, 0.6)) == "x" * 23


def test_latest_of_wide_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "q"), (None, 1, "n"), ("c", 1, "z"), ("c", 1, "z")], "k string, v int, s string")
    assert rows(latest_of_wide(df, "k", [F.col("v")])) == [("a", 2, "y"), ("b", None, "q"), ("c", 1, "z")]
    assert latest_of_wide(df.limit(0), "k", [F.col("v")]).count() == 0 and not is_small(df, 3) and is_small(df, 6) and not is_small(df, 6, 10)
