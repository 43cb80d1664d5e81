import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, hashing, numbers, text as tx, urls, vectors


def one(spark, column, **values):
    frame = spark.createDataFrame(pd.DataFrame([values])) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_rounding_goes_up_on_the_double(spark):
    assert one(spark, numbers.round3(F.lit(-0.0005))) == 0.0
    assert one(spark, numbers.round3(F.lit(1.2344))) == 1.234 and one(spark, numbers.round3(F.lit(0.0005))) == 0.001
    assert one(spark, numbers.clamp(F.lit(2.0), -0.9, 0.9)) == 0.9
    assert one(spark, numbers.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None


def test_known_hashes(spark):
    assert hashing.fnv1a_int("Paul") == 3446310579 == one(spark, hashing.fnv1a(F.lit("Paul")))
    assert [hashing.mix_int(i) for i in range(4)] == [0, 824515495, 1722258072, 3753300549]
    assert one(spark, hashing.jitter(F.lit("2026-09-08:a"))) == 0.224
    assert one(spark, hashing.jitter(F.lit("2026-09-08:b"))) == 0.217
    assert one(spark, hashing.fnv1a_any(F.lit("😀é"))) == hashing.fnv1a_int("😀é")
    assert one(spark, hashing.fnv1a(F.lit(None).cast("string"))) is None
    assert len(one(spark, hashing.stable_id(F.lit("x")))) == 32


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("https://Ex.org/a?utm_source=x&#038;b=2&amp;a=1#top", "https://ex.org/a?a=1&b=2"),
        ("https://ex.org", "https://ex.org/"),
        ("https://ex.org/?fbclid=1&GCLID=2", "https://ex.org/"),
        (" https://ex.org/x?b=1&b=0 ", "https://ex.org/x?b=1&b=0"),
        ("mailto:a@b.c", None),
        (None, None),
    ],
)
def test_urls(spark, given, wanted):
    assert one(spark, urls.normalized_url(F.lit(given).cast("string"))) == wanted


def test_first_link(spark):
    assert one(spark, urls.first_link_to(F.lit("see (https://www.a.example/x?utm_a=1), or https://a.example/y"), "a\\.example")) == "https://www.a.example/x"
    assert one(spark, urls.first_link_to(F.lit("nothing"), "a\\.example")) is None


def test_markup(spark):
    page = "<head><title>A &amp; B</title></head><script>no()</script><p>One&nbsp;two &#8211; &#x41;</p><div>three<br>four</div><!-- x -->"
    assert one(spark, tx.stripped(F.lit(page))) == "A & B One two – A\nthree\nfour"
    assert one(spark, tx.decoded(F.lit("&amp;lt; &#55296; &#x1F600;"))) == "< &#55296; 😀"
    assert one(spark, tx.page_title(F.lit(page))) == "A & B"
    assert one(spark, tx.meta(F.lit('<meta property="og:title" content="T">'), "og:title")) == "T"
    got = one(spark, tx.links(F.lit('<a class="k" href="/x?a=1&amp;b=2">An <b>x</b></a><a>no</a>')))
    assert [(r["href"], r["text"]) for r in got] == [("/x?a=1&b=2", "An x")]


def test_texts(spark):
    assert one(spark, tx.word_count(F.lit("It's a well-known 3rd – case"))) == 5
    assert one(spark, tx.word_count(F.lit(None).cast("string"))) == 0
    assert one(spark, tx.normalized(F.lit(" a  b \n\n\n c "))) == "a b\nc"
    assert one(spark, tx.sentences(F.lit("One. Two? 三。四"))) == ["One.", "Two?", "三。", "四"]
    assert one(spark, tx.cut_at_punctuation(F.lit("Abc. Defghi"), 8)) == "Abc."
    assert one(spark, tx.title_from_slug(F.lit("https://x.example/p/one-two-3?x=1"))) == "One Two 3"


def test_chunks_keep_all(spark):
    text = "A sentence here. " * 500 + "END"
    got = tx.chunk_text(text, 1400, 100, 0.55)
    assert got[-1].endswith("END") and max(map(len, got)) <= 1401
    joined, at = got[0], 0
    for c in got[1:]:
        assert c[:50] in joined
        joined += c[100:] if joined.endswith(c[:100]) else c
    assert one(spark, tx.chunks(F.lit(None).cast("string"))) == [] and one(spark, tx.chunks(F.lit(""))) == [""]


def test_dates(spark):
    at = F.timestamp_micros(F.lit(int(dt.datetime(2026, 8, 25, 21, 59, 59, tzinfo=dt.UTC).timestamp() * 1e6)))
    w = one(spark, dates.health_window(at))
    assert str(w["day"]) == "2026-08-26" and w["minutes"] == 359 and str(w["expected"]) == "2026-08-25" and not w["grace"]
    w = one(spark, dates.health_window(at + F.expr("interval 1 second")))
    assert str(w["expected"]) == "2026-08-26" and w["grace"]
    for given in ("2025-03-11T11:56:50Z", "2025-03-11 11:56:50", "Tue, 11 Mar 2025 11:56:50 +0000"):
        assert one(spark, F.unix_seconds(dates.parsed(F.lit(given)))) == 1741694210
    assert one(spark, dates.parsed(F.lit("n/a"))) is None
    assert one(spark, dates.public_parts(F.lit("2026-08-25").cast("date"))) == ("AUG", "25", "2026", "TUESDAY")


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert abs(one(spark, vectors.cosine(a, b)) - 0.96) < 1e-12
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0 == one(spark, vectors.cosine(a, F.lit(None).cast("array<double>")))
    assert one(spark, vectors.unit(F.array(F.lit(0.0)))) == [0.0]
    p = one(spark, vectors.projected(F.transform(F.sequence(F.lit(1), F.lit(384)), lambda x: x.cast("double")), 384))
    assert len(p) == 64 and abs(sum(x * x for x in p) - 1) < 1e-9
    assert not one(spark, vectors.usable(F.array(F.lit(float("nan"))), 1)) and not one(spark, vectors.usable(F.lit(None).cast("array<double>"), 1))
