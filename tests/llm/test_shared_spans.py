import random

import numpy as np
import pytest

from tidemill.llm import shared_spans as sp
from tidemill.tables import Scratch

from .brute import shared

SCHEMA = "doc_id long, text string, hash long, place int, side long, id string"


def frame(spark, texts):
    data = [(k, t, 1, 2, 3, "x") for k, t in texts.items()]
    return spark.createDataFrame(data + data[:3] + [(None, "y" * 500, 1, 2, 3, "x")], SCHEMA)


def corpus(seed, n=40):
    rng = random.Random(seed)
    letters = "abcdefghij ëß漢😀"
    free = lambda k: "".join(rng.choice(letters) for _ in range(k))
    spans = [free(k) for k in (199, 200, 201, 260, 700)] + ["na" * 150]
    texts = {i: free(rng.randrange(400)) + rng.choice(spans) + free(rng.randrange(300)) + (rng.choice(spans) if rng.random() < 0.3 else "") for i in range(n)}
    texts |= {900: None, 901: "", 902: " ", 903: spans[1], 904: spans[0], 905: texts[0], 906: texts[0]}
    return texts


@pytest.mark.parametrize("few", [32, 2])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(sp, "FEW", few)
    texts = corpus(few)
    scratch, docs = Scratch(spark, "t"), frame(spark, texts)
    found = sp.runs(sp.repeated_windows(docs, scratch), scratch)
    pairs, cover = shared(texts)
    assert {tuple(r) for r in sp.pairs(found).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in sp.covered(docs, found).collect()} == cover


def test_one_passage_in_very_many_documents(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefg ") for _ in range(230))
    texts = {i: "".join(rng.choice("hijkl ") for _ in range(60)) + passage + "".join(rng.choice("mnopq ") for _ in range(60)) for i in range(80)}
    scratch = Scratch(spark, "t")
    found = sp.runs(sp.repeated_windows(frame(spark, texts), scratch), scratch)
    pairs, cover = shared(texts)
    assert len(pairs) == 80 * 79 // 2 and found.crowded.count() > 0
    assert {tuple(r) for r in sp.pairs(found).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in sp.covered(frame(spark, texts), found).collect()} == cover


def test_every_stretch_holds_a_sample():
    rng = np.random.default_rng(1)
    for chars in (rng.integers(0, 5, 3000).astype("<u4"), np.zeros(1000, "<u4"), rng.integers(0, 2, 200).astype("<u4")):
        places, hashes = sp.Sampler()(chars)
        gaps = np.diff(np.concatenate([[-1], places, [len(chars) - sp.WINDOW + 1]]))
        assert gaps.max() <= sp.LEAST - sp.WINDOW + 1
        again, same = sp.Sampler()(np.concatenate([[7, 8, 9], chars]).astype("<u4"))
        assert set(hashes) <= set(same) | {hashes[0], hashes[-1]}
    assert len(sp.Sampler()(np.zeros(199, "<u4"))[0]) == 0


def test_long_text_and_empty(spark):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(400_000))
    texts = {1: text, 2: "x" * 250 + text[200_000:200_230], 3: "y" * 10}
    scratch = Scratch(spark, "t")
    found = sp.runs(sp.repeated_windows(frame(spark, texts), scratch), scratch)
    assert {tuple(r) for r in sp.pairs(found).collect()} == {(1, 2)}
    none = frame(spark, texts).limit(0)
    found = sp.runs(sp.repeated_windows(none, scratch), scratch)
    assert sp.pairs(found).count() == 0 and sp.covered(none, found).count() == 0


def test_sketches_merge_as_a_tree_and_fill_without_loss(spark, monkeypatch):
    """Tiny sketches, flushed often and merged two at a time, still lose no window."""
    monkeypatch.setattr(sp, "FAN", 2)
    monkeypatch.setattr(sp, "FLUSH", 50)
    monkeypatch.setattr(sp, "LEAST_BITS", 10)
    monkeypatch.setattr(sp, "MOST_BITS", 11)
    rng = random.Random(12)
    passages = ["".join(rng.choice("abcdef ") for _ in range(260)) for _ in range(6)]
    texts = {i: "".join(rng.choice("ghijk ") for _ in range(400)) + (rng.choice(passages) if i % 3 else "") + "".join(rng.choice("lmno ") for _ in range(300)) for i in range(60)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(9)
    found = sp.runs(sp.repeated_windows(df, Scratch(spark, "t")), Scratch(spark, "t"))
    assert {tuple(r) for r in sp.pairs(found).collect()} == shared(texts)[0]


def test_cells_follow_the_corpus():
    assert sp.cell_bits(0) == sp.LEAST_BITS and sp.cell_bits(10**9) == 25 and sp.cell_bits(10**14) == sp.MOST_BITS
