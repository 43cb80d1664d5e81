import pytest
from pyspark.sql import functions as F

from tidemill.sources import feeds

from .conftest import rows

RSS = """<rss xmlns:dc="d" xmlns:content="c"><channel>
<item><title>A &amp; B</title><link>https://x.example/a?utm_source=f#t</link><dc:creator>Ann</dc:creator><pubDate>Tue, 11 Mar 2025 11:56:50 +0000</pubDate><content:encoded><![CDATA[<p>Body</p>]]></content:encoded><category>one</category><category>two</category></item>
<item><title>No link</title><description>text</description></item>
<item><title>No body</title><link>https://x.example/c</link></item>
</channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    got = feeds.read_rss(spark, str(tmp_path / "feed.xml")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["title"], r["link"], r["author"], r["body"], r["categories"]) == ("A & B", "https://x.example/a", "Ann", "<p>Body</p>", ["one", "two"]) and r["published_at"] is not None


def test_first_page_holds(spark):
    df = spark.createDataFrame([("u", 3, "c"), ("u", 1, "a"), ("v", 2, "b")], "link string, page int, x string")
    assert rows(feeds.first_seen(df).select("link", "x")) == [("u", "a"), ("v", "b")]


def test_sitemap_both_ways(spark):
    df = spark.createDataFrame([(["https://x.example/p/a?b=1&c=2", "https://x.example/p/d#e", "https://y.example/p/z", "https://x.example/q"],)], "u array<string>")
    xml = df.select(feeds.sitemap(F.col("u")).alias("x"))
    assert xml.select(feeds.sitemap_links(F.col("x"), "https://x.example")).first()[0] == ["https://x.example/p/a?b=1&c=2", "https://x.example/p/d"]


@pytest.mark.parametrize("href, wanted", [("/a", "https://x.example/a"), ("b.html", "https://x.example/d/b.html"), ("//y.example/c", "https://y.example/c"), ("#top", None), ("javascript:x()", None), ("HTTPS://Z.example/Q", "https://z.example/Q")])
def test_links_are_resolved(spark, href, wanted):
    df = spark.createDataFrame([(1, f'<a href="{href}">t</a>', "https://x.example/d/e.html")], "id int, h string, u string")
    got = feeds.page_links(df, "h", "u", "id").collect()
    assert [r["href"] for r in got] == ([wanted] if wanted else [])


def test_mail_codes(spark):
    cols = "message_id string, source_id string, subject string, author string, published_at string, html_body string, text_body string, canonical_url string, from_address string, to_address string"
    df = spark.createDataFrame(
        [
            ("<a@b>", "s", " Hi ", None, "22/01/2025", "<p>x</p>", None, None, "me@Mail.example", None),
            ("<c@d>", None, "t", "a", None, None, "x", "https://q.example/?utm_x=1", None, None),
            ("<e@f>", "s", " ", "a", "n/a", None, "x", None, None, None),
            ("<g@h>", "s", "t", "a", None, None, " ", None, None, None),
        ],
        cols,
    )
    got = {r["message_id"]: r for r in feeds.parsed_mail(df).collect()}
    assert got["<a@b>"]["error"] is None and got["<a@b>"]["author"] == "s" and got["<a@b>"]["title"] == "Hi" and got["<a@b>"]["text"] == "x"
    assert got["<a@b>"]["canonical_url"] == "https://mail.example/mail/a@b" and got["<a@b>"]["published_at"] is not None
    assert got["<c@d>"]["error"] == "missing_source" and got["<c@d>"]["canonical_url"] == "https://q.example/"
    assert got["<e@f>"]["error"] == "missing_subject" and got["<e@f>"]["published_at"] is None and got["<g@h>"]["error"] == "missing_body"
