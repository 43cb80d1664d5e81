import numpy as np
import pytest

from tidemill.llm import neighbours as nb
from tidemill.tables import Scratch

SCHEMA = "id string, version int, vec array<float>, cell long, other string"


def clustered(n, d, seed, tight=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(tight, d))
    return (centres[rng.integers(0, tight, n)] + rng.normal(size=(n, d)) * 0.8) * rng.uniform(0.1, 9, (n, 1))


def frame(spark, x):
    return spark.createDataFrame([(f"v{i:05d}", 1, [float(v) for v in r], 0, "o") for i, r in enumerate(x)], SCHEMA)


def brute(x, k):
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 12)
    np.fill_diagonal(c, -2)
    return {f"v{i:05d}": {f"v{j:05d}" for j in np.argsort(-c[i], kind="stable")[:k]} for i in range(len(x))}


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], set()).add(r["other"])
    return out


def built(spark, df, d):
    scratch = Scratch(spark, "t")
    return nb.build(nb.vectors(df, scratch, d), scratch), scratch


def test_recall_of_join_and_search(spark):
    x = clustered(1500, 32, 3)
    graph, scratch = built(spark, frame(spark, x), 32)
    want = brute(x, 5)
    got = lists(nb.expanded(graph, scratch, 5))
    assert len(got) == 1500 and np.mean([len(got[k] & want[k]) / 5 for k in want]) >= 0.95
    found = lists(nb.search(graph, frame(spark, x).filter("id like '%00'"), scratch, 5))
    assert len(found) == 15 and np.mean([len(found[k] & want[k]) / 5 for k in found]) >= 0.9


def test_the_rounds_make_the_lists(spark):
    x = clustered(1500, 32, 3)
    scratch = Scratch(spark, "t")
    v = nb.vectors(frame(spark, x), scratch, 32)
    pairs = lambda df: {(r["id"], o) for r in df.collect() for o in r["others"]}
    start, end = pairs(nb.start_lists(v)), pairs(nb.build(v, scratch).lists)
    assert len(end - start) >= 0.5 * len(end)
    want = brute(x, 5)
    names = {r["node"]: r["id"] for r in v.nodes.collect()}
    recall = lambda got: sum(names[b] in want[names[a]] for a, b in got) / (5 * len(want))
    assert recall(start) < 0.9 < recall(end)


def test_vectors_of_one_tight_clump(spark):
    """A third of all rows so alike that they fill each other's lists."""
    rng = np.random.default_rng(8)
    base = clustered(800, 32, 4)
    x = np.concatenate([base, base[:1] + rng.normal(size=(400, 32)) * 0.05])[rng.permutation(1200)]
    graph, scratch = built(spark, frame(spark, x), 32)
    want, got = brute(x, 5), lists(nb.expanded(graph, scratch, 5))
    assert np.mean([len(got[k] & want[k]) / 5 for k in want]) >= 0.9


def test_copies_ties_and_dirty_rows(spark):
    base = clustered(12, 8, 1)
    x = np.concatenate([np.repeat(base[:1], 9, axis=0), base[1:], base[1:2]])
    rows = [(f"v{i:05d}", 1, [float(v) for v in r], 0, "o") for i, r in enumerate(x)]
    dirty = [("d1", 1, None, 0, "o"), ("d2", 1, [], 0, "o"), ("d3", 1, [1.0] * 7, 0, "o"), ("d4", 1, [0.0] * 8, 0, "o"), ("d5", 1, [float("nan")] + [1.0] * 7, 0, "o"), ("d6", 1, [float("inf")] + [1.0] * 7, 0, "o"), (None, 1, [1.0] * 8, 0, "o"), ("v00003", 0, [5.0] * 8, 0, "o")]
    graph, scratch = built(spark, spark.createDataFrame(rows + rows[:5] + dirty, SCHEMA), 8)
    assert lists(nb.expanded(graph, scratch, 5)) == brute(x, 5)


@pytest.mark.parametrize("copies", [40, 120])
def test_copies_of_other_norms(spark, copies):
    rng = np.random.default_rng(4)
    base = clustered(60, 16, 6)
    x = np.concatenate([base, base[:1] * rng.uniform(0.1, 9, (copies, 1))])[rng.permutation(60 + copies)]
    graph, scratch = built(spark, frame(spark, x), 16)
    want, got = brute(x, 5), lists(nb.expanded(graph, scratch, 5))
    near = np.round((lambda u: u @ u[int(np.flatnonzero((np.abs(u @ u.T - 1) < 1e-9).sum(1) > 9)[0])])(x / np.linalg.norm(x, axis=1, keepdims=True)), 9) == 1
    assert all(got[f"v{i:05d}"] == want[f"v{i:05d}"] for i in np.flatnonzero(near)) and near.sum() == copies + 1
    assert np.mean([len(got[k] & want[k]) / 5 for k in want]) >= 0.97


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_vectors(spark, n):
    x = clustered(max(n, 1), 8, 2)[:n]
    graph, scratch = built(spark, frame(spark, x) if n else frame(spark, clustered(1, 8, 2)).limit(0), 8)
    got = lists(nb.expanded(graph, scratch, 5))
    assert got == ({} if n < 2 else brute(x, min(5, n - 1)))


def test_search_asks_and_answers_with_copies(spark):
    base = clustered(160, 16, 7)
    x = np.concatenate([base, np.repeat(base[:1], 80, axis=0), base[1:30]])
    graph, scratch = built(spark, frame(spark, x), 16)
    want = brute(x, 5)
    got = lists(nb.search_members(graph, graph.vectors.members, scratch, 5))
    assert len(got) == len(x) and np.mean([len(got[k] & want[k]) / 5 for k in want]) >= 0.98
    copies = [f"v{i:05d}" for i in (0, *range(160, 240))]
    assert all(got[k] == want[k] for k in copies)
    assert lists(nb.search(graph, frame(spark, x).filter("id in ('v00000', 'v00001')"), scratch, 5)) == {k: want[k] for k in ("v00000", "v00001")}
