import random

from tidemill.llm import site_lines as s
from tidemill.tables import Scratch

from .brute import repeated_lines

SCHEMA = "source_id string, article_id string, author string, text string, hi long, lo long, key string, line_no int"


def frame(spark, articles):
    return spark.createDataFrame([(src, id, "Ann Lee", t, 1, 2, "x", 3) for src, id, t in articles], SCHEMA)


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    stock = ["Support us from 12 coins!", "support us, from 99 coins", "© 2024", "Ab1", "abc", "Share this", "", "  ", "Reading time: 3 minutes\r", "Lesezeit: 4", "ÉÈ 5 é"]
    articles = []
    for i in range(120):
        src = rng.choice(["hot"] * 6 + ["b", None])
        text = "\n".join(rng.choice(stock) if rng.random() < 0.5 else f"one {chr(97 + rng.randrange(26))} of {rng.randrange(9)} thousand unlike lines {chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(rng.randrange(9)))
        articles.append((src, f"a{i}", rng.choice([text, text, text, None, "", " \n "])))
    articles += articles[:5] + [("hot", "long", "word " * 50_000 + "\nabc")]
    got = {(r["article_id"], r["line_no"]) for r in s.exact_lines(s.repeated_lines(frame(spark, articles), Scratch(spark, "t"))).collect()}
    assert got == repeated_lines([(a or "", b, c) for a, b, c in articles])


WORDS = "every reader of this letter may send it on to friends and family who care for the written word in all lands and we thank them for it each week".split()


def test_near_lines_are_one_cluster_over_any_number_of_steps(spark):
    """Each text has the line with one more word changed than the one before; only neighbours are alike."""
    articles = []
    for i in range(8):
        words = [f"{w}x" if 10 <= k < 10 + i else w for k, w in enumerate([*WORDS, *(w + "y" for w in WORDS)])]
        articles.append(("s", f"a{i}", f"own text number {'abcdefgh'[i] * 7} with nothing alike {'qrstuvwx'[i]}\n" + " ".join(words)))
    repeated = s.repeated_lines(frame(spark, articles), Scratch(spark, "t"))
    assert {r["article_id"]: r["places"] for r in repeated.collect()} == {a[1]: [1] for a in articles}
    clean = {r["article_id"]: r["text"] for r in s.without_lines(frame(spark, articles), repeated).collect()}
    assert len(clean) == 8 and all(t.startswith("own text") and "\n" not in t for t in clean.values())


def test_masked_lines_are_alike_and_exact_ones_are_held_to_their_letters(spark):
    names = ["Ann Lee", "Bob Ray", "Cy Dee", "Flo Fee", "Gus Gee", "Hal Hee"]
    lines = [f"Written by {n} on {i + 3} {m} {2020 + i}" for i, (n, m) in enumerate(zip(names, ["May", "June", "Juli", "agosto", "March", "Jan"]))]
    articles = [("s", f"a{i}", f"own text {'abcdefgh'[i] * 9} of this\n{line}\nShare it.") for i, line in enumerate(lines)]
    repeated = s.repeated_lines(frame(spark, articles), Scratch(spark, "t"))
    assert {(r["article_id"], p) for r in repeated.collect() for p in r["places"]} == {(a[1], k) for a in articles for k in (1, 2)}
    assert {(r["article_id"], r["line_no"]) for r in s.exact_lines(repeated).collect()} == {(a[1], 2) for a in articles}


def test_equal_letters_meet_whatever_their_words_and_masks(spark):
    """The author's own name is masked in one text only, and words are split in other ways."""
    rows = [("s", "a1", "Ann Lee", "more by ann lee on the e-mail"), ("s", "a2", "Bob", "more by ann lee on the email"), ("s", "a3", "Cy", "more by annlee on the e mail!")]
    rows += [("s", f"b{i}", "X", f"alone {'pqrst'[i] * 5}") for i in range(5)]
    df = spark.createDataFrame([(*r[:3], r[3], 1, 2, "x", 3) for r in rows], SCHEMA)
    assert {(r["article_id"], r["line_no"]) for r in s.exact_lines(s.repeated_lines(df, Scratch(spark, "t"))).collect()} == {("a1", 0), ("a2", 0), ("a3", 0)}


def test_lines_of_capitals_are_no_names():
    mask = s.Masker()
    mask.of("the-site", "Ann Lee")
    words = lambda line: mask(line, line.lower())
    assert words("The Patient Harbour") != words("The Global Draft") and words("by Ann Lee here") == words("by Bob Marley Ray here")


def test_empty(spark):
    none = frame(spark, [("s", "a", "x")]).limit(0)
    repeated = s.repeated_lines(none, Scratch(spark, "t"))
    assert repeated.count() == 0 and s.exact_lines(repeated).count() == 0 and s.without_lines(none, repeated).count() == 0
