import random

import numpy as np
import pytest

from tidemill.llm import near_duplicates as nd
from tidemill.tables import Scratch

from .brute import near_pairs

SCHEMA = "id string, version int, text string, hi long, rep string, a string"


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = {}
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120]))]
        out[f"d{i:03d}"] = " ".join(base)
        for k in range(rng.randrange(3)):
            edited = list(base)
            for _ in range(rng.randrange(6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            out[f"d{i:03d}-{k}"] = rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in edited)
    out |= {"null": None, "empty": "", "blank": " \n", "short": "two words", "rep1": "na " * 300, "rep2": "na " * 290, "rep3": "na na na"}
    return out


def frame(spark, texts):
    data = [(k, 1, t, 0, "x", "y") for k, t in texts.items()]
    return spark.createDataFrame(data + data[:4] + [(None, 1, "a b c d e f", 0, "x", "y")], SCHEMA)


@pytest.mark.parametrize("setup", [nd.Setup(words=3, similarity=0.6, bands=32, rows=3, bags=False), nd.Setup(words=5, similarity=0.8)])
def test_pairs_against_brute_force(spark, setup):
    texts = corpus(setup.words)
    found = nd.classes(frame(spark, texts), Scratch(spark, "t"), setup)
    got = {tuple(r) for r in nd.pairs_of_members(found).collect()}
    assert got == near_pairs(texts, setup.words, setup.similarity, setup.bags)


def test_groups_and_links(spark):
    a = " ".join(f"w{i}" for i in range(60))
    texts = {"a": a, "b": a, "c": a + " x y", "d": a + " z", "e": "something else altogether in this text here", "n": None}
    scratch = Scratch(spark, "t")
    got = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in nd.groups(nd.classes(frame(spark, texts), scratch, nd.Setup()), scratch).collect()}
    assert got["a"] == ("a", "a", 2) and got["b"] == ("a", "a", 2) and got["c"] == ("c", "a", 3) and got["d"] == ("d", "a", 3)
    assert got["e"] == ("e", "e", 0) and got["n"] == ("n", "n", 0)


def test_latest_version_holds(spark):
    a = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("x", 1, a), ("x", 2, "quite another text with more than five words"), ("y", 1, a)], "id string, version int, text string")
    assert nd.classes(df, Scratch(spark, "t"), nd.Setup()).pairs.count() == 0


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(70)] + [("x", "y")], "p string, q string")
    got = {r["id"]: r["label"] for r in nd.components(edges, Scratch(spark, "t"), "p", "q").collect()}
    assert set(got.values()) == {"000", "x"} and len(got) == 73


def test_signatures_estimate_weighted_similarity_without_bias():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(150):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        a = rng.integers(0, 9, 60).astype(float)
        b = np.maximum(0, a + rng.integers(-3, 4, 60))
        parts = [(base[w > 0], w[w > 0]) for w in (a, b)]
        x, y = nd.bag_min_hash(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([len(p[0]) for p in parts]), 96)
        gaps.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.07


def test_empty(spark):
    scratch = Scratch(spark, "t")
    found = nd.classes(frame(spark, {"a": "x"}).limit(0), scratch, nd.Setup())
    assert nd.pairs_of_members(found).count() == 0 and nd.groups(found, scratch).count() == 0
