import numpy as np
import pytest

from tidemill.llm import buckets, near_duplicates as nd
from tidemill.tables import Scratch


@pytest.mark.parametrize("few, block", [(24, 256), (3, 7)])
def test_crowded_buckets_give_the_same_pairs(spark, monkeypatch, few, block):
    monkeypatch.setattr(buckets, "FEW", few)
    monkeypatch.setattr(buckets, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (6, 8)).astype(np.uint8)
    signs = {f"i{k:03d}": np.where(rng.random(8) < 0.3, rng.integers(0, 256, 8), base[k % 6]).astype(np.uint8) for k in range(90)}
    bands = [(b, i) for b in range(3) for i in signs if b == 0 or hash((b, i)) % 9 == 0 or i < "i004"]
    got = buckets.pairs(spark.createDataFrame(bands, "band int, id string"), spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in signs.items()], "id string, signature binary"), 8, 0.6, Scratch(spark, "t"))
    keys = sorted(signs)
    want = {(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if (signs[a] == signs[b]).mean() >= 0.6}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_a_band_of_many_members_is_compared_whole(spark):
    """Three thousand texts of one template: all in each other's bands, most of them near-duplicates of none."""
    common = " ".join(f"w{i}" for i in range(40))
    texts = [(f"t{i:04d}", 1, common + " " + " ".join(f"x{i}y{k}" for k in range(30))) for i in range(3000)] + [("twin", 1, common + " " + " ".join(f"x7y{k}" for k in range(29)))]
    found = nd.classes(spark.createDataFrame(texts, "id string, version int, text string"), Scratch(spark, "t"), nd.Setup())
    assert {tuple(r) for r in nd.pairs_of_members(found).collect()} == {("t0007", "twin")}


def test_copies_by_the_thousand_are_paired_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nd, "ROWS_A_PART", 16)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(f"c{i:03d}", 1, text) for i in range(60)] + [(f"d{i:03d}", 1, text + " z") for i in range(40)]
    found = nd.classes(spark.createDataFrame(rows, "id string, version int, text string"), Scratch(spark, "t"), nd.Setup())
    pairs = [tuple(r) for r in nd.pairs_of_members(found).collect()]
    assert len(pairs) == len(set(pairs)) == 100 * 99 // 2 and all(a < b for a, b in pairs)
