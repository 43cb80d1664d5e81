import base64
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemill.llm import mixing as mx, tokens as tk
from tidemill.tables import Scratch, read

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tk.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n \t", "a" * 30_000, "ab" * 5000, "　 x\x1c\x1d", "é̂" * 400, "👩‍💻<|endoftext|>", "漢字かな" * 300, "I'll we've it's 'S", "\x00￿", "１２３ ²³ Ⅷ"]


def test_odd_texts(public):
    enc = tk.encoder(tk.VOCABULARY)
    for text in ODD:
        assert enc.encode(text) == public.encode_ordinary(text) and enc.count(text) == len(public.encode_ordinary(text))
    assert enc.encode(None) == [] and enc.count(None) == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_comes_back(text):
    enc = tk.encoder(tk.VOCABULARY)
    back = {v: k for k, v in enc.ranks.items()} if not hasattr(enc, "back") else enc.back
    enc.back = back
    assert b"".join(back[i] for i in enc.encode(text)).decode() == text


def test_whole_table(spark, data, public):
    docs = read(spark, data, "documents")
    got = {r["doc_id"]: r["ids"] for r in tk.encode(docs.select("doc_id", "text")).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r["doc_id"]] == public.encode_ordinary(r["text"] or "")


def test_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y")], "k int, text string, ids string")
    got = sorted((r["k"], r["ids"]) for r in tk.encode(df).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, [])]
    assert tk.count(df.limit(0)).count() == 0 and tk.encode(df.limit(0)).count() == 0


DOCS = "doc_id long, source string, tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, seed=1, n=600):
    rng = random.Random(seed)
    names = ["Hot "] * 6 + ["mid", " MID", "small", None, "other"]
    return spark.createDataFrame([(i, rng.choice(names), rng.choice([0, 5, 40, 300])) for i in range(n)], DOCS)


def targets(spark):
    return spark.createDataFrame([("hot", 0.2, 1), ("Mid", 0.3, 4), ("small", 0.4, 2), ("absent", 0.1, 9)], TARGETS)


def test_plan_and_shares(spark):
    docs = corpus(spark)
    total = docs.agg(F.sum("tokens")).first()[0]
    planned = mx.plan(docs, targets(spark)).cache()
    by = {r["source"]: r for r in planned.collect()}
    for name, repeats, share in (("hot", 1, 0.2), ("mid", 4, 0.3), ("small", 2, 0.4), ("absent", 9, 0.1)):
        have = docs.filter(F.lower(F.trim("source")) == name).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        assert by[name]["tokens"] == have and by[name]["short"] == (have * repeats < share * total) and by[name]["budget_tokens"] == min(int(share * total), have * repeats)
    used = mx.realise(docs, planned)
    tokens = {r["doc_id"]: r["tokens"] for r in docs.collect()}
    for r in used.collect():
        assert r["repeats"] <= by[r["source"]]["max_repeats"] and r["tokens"] == tokens[r["doc_id"]]
    for r in mx.reached(used, planned).collect():
        assert 0 <= r["budget_tokens"] - r["used_tokens"] <= 300 and abs(r["share_of_corpus"] - r["used_tokens"] / total) < 1e-12
    assert abs(sum(r["share_of_mix"] for r in mx.reached(used, planned).collect()) - 1) < 1e-9


def test_exponents():
    natural = [0.7, 0.2, 0.1]
    target = [0.2, 0.3, 0.5]
    e = mx.exponent_for_limits(natural, target, 100, [140, 60, 30])
    assert 0 < e < 1 and mx.blend(natural, target, e)[2] * 100 <= 30 + 1e-6 and mx.blend(natural, target, e + 1e-6)[2] * 100 > 30
    assert mx.exponent_for_limits(natural, target, 100, [100, 100, 100]) == 1.0
    h = mx.entropy([0.5, 0.3, 0.2])
    assert abs(mx.entropy(mx.temper(natural, mx.exponent_for_entropy(natural, h))) - h) < 1e-9
    assert mx.temper([0.0, 0.0], 0.5) == [0.0, 0.0] and mx.blend([0.0, 1.0], [1.0, 0.0], 0.5) == [0.0, 0.0]


def test_odd_targets(spark):
    odd = spark.createDataFrame([("hot", 0.1, 1), (" HOT", 0.3, 2), (None, 0.5, 1), ("mid", None, None), ("small", -1.0, 3)], TARGETS)
    by = {r["source"]: (r["target_share"], r["max_repeats"]) for r in mx.plan(corpus(spark), odd).collect()}
    assert by == {"hot": (0.3, 2), "mid": (0.0, 0), "small": (0.0, 3)}
    none = mx.plan(corpus(spark).limit(0), targets(spark))
    assert not any(r["short"] or r["budget_tokens"] for r in none.collect()) and mx.realise(corpus(spark).limit(0), none).count() == 0
    assert mx.plan(corpus(spark), targets(spark).limit(0)).count() == 0
