"""Long exact spans shared between records.

Every run of `least` characters holds a sampled window: of the hashes of all windows of `window` characters, the least
one in each stretch of `least - window + 1` places is taken, so two texts that share `least` characters share at least
one sampled window at the same characters. A count-min prefilter says which windows can be repeated: each partition
makes a sketch with two rows of two bits per cell (seen, seen again), the sketches are merged by segment, and the merged
cells overestimate a window's count, never underestimate it. A second pass takes the sampled windows again and groups
exactly those estimated repeated, by hash and document; what the sketch lets through wrongly falls out here, and none is
lost. Of the windows that remain the characters around them that decide about a run of `least` are then compared.

A partition sends its filled cells, sorted, and no empty ones. Sketches are merged as a tree, FAN at a time within each
segment of cells, so no task holds more than FAN of them. The sketch has about two cells for each window, by the length of
all texts, and at most 2^MOST_BITS, which bounds what is broadcast (64 MB). Beyond that it fills, lets more through and
saves less: at worst 20 bytes for every 69 characters are grouped. The result is the same.

Defined cases: texts shorter than `least` (null and empty ones too) share nothing; spans are compared by code point,
exactly; several spans of one pair give one pair; a passage twice in one text is not shared with itself; repeated rows
of one id are one document (rows of one id with other texts count together); rows without id are dropped; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..tables import Scratch, size_checked
from .arrow import map_arrow, mix64
from .near_duplicates import joined_apart

LEAST, WINDOW = 200, 64
LEAST_BITS, MOST_BITS, SEGMENTS, FAN = 16, 28, 256, 64
FLUSH = 1 << 21
FEW = 32
MOST_BROADCAST, MOST_BYTES = 200_000, 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so its powers have inverses modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Sampler:
    """Places and hashes of a text's sampled windows."""

    def __init__(self, least: int = LEAST, window: int = WINDOW):
        self.least, self.window, self.stretch = least, window, least - window + 1
        self.powers = self.inverses = np.empty(0, dtype=np.uint64)

    def __call__(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(chars) - self.window + 1
        if len(chars) < self.least:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        if len(self.powers) < len(chars):
            size = max(1 << 14, 1 << len(chars).bit_length())
            self.powers, self.inverses = _powers(_BASE, size), _powers(_INVERSE, size)
        sums = np.zeros(len(chars) + 1, dtype=np.uint64)
        np.cumsum(mix64(chars.astype(np.uint64) + np.uint64(1)) * self.powers[: len(chars)], out=sums[1:])
        hashes = mix64((sums[self.window :] - sums[:-self.window]) * self.inverses[:n])
        # The least of each stretch, by blocks: suffix minima of one block meet prefix minima of the next.
        k, m = self.stretch, n - self.stretch + 1
        padded = np.full(-(-n // k) * k, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = hashes
        blocks = padded.reshape(-1, k)
        prefix = np.minimum.accumulate(blocks, axis=1).ravel()
        suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(suffix[:m], prefix[k - 1 : k - 1 + m])
        # Equal hashes are equal windows; all places that hold a minimum of a stretch around them are taken.
        chosen = np.zeros(n, dtype=bool)
        changes = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        ends = np.concatenate([changes[1:], [m]])
        for a, b in zip(changes, ends):
            stretch = hashes[a : b - 1 + k]
            chosen[a + np.flatnonzero(stretch == least[a])] = True
        places = np.flatnonzero(chosen)
        return places, hashes[places]


def cell_bits(characters: int, least: int = LEAST, window: int = WINDOW) -> int:
    """Bits of a cell's number: about two cells for each sampled window of so many characters."""
    windows = max(1, 2 * characters // (least - window + 2))
    return min(MOST_BITS, max(LEAST_BITS, (2 * windows - 1).bit_length()))


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the two rows; those of the second stand behind those of the first."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(64 - bits)) & mask).astype(np.int64) + (1 << bits)


def _told(cells: np.ndarray, again: np.ndarray) -> bytes:
    """Filled cells of a segment and whether more than one text filled them."""
    return zlib.compress((cells.astype(np.uint32) << np.uint32(1) | again.astype(np.uint32)).tobytes(), 1)


def _heard(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), dtype=np.uint32)
    return (both >> np.uint32(1)).astype(np.int64), (both & np.uint32(1)).astype(bool)


def repeated_cells(documents: DataFrame, bits: int, least: int, window: int) -> np.ndarray:
    """Two rows of packed bits: the cells that more than one text may have filled."""
    step = (2 << bits) // SEGMENTS
    schema = T.StructType.fromDDL("segment int, part int, cells binary")
    names = ["segment", "part", "cells"]

    def told(part: int, held: list[np.ndarray]):
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        starts = np.searchsorted(cells, np.arange(SEGMENTS + 1) * step)
        filled = np.flatnonzero(np.diff(starts))
        data = [_told(cells[starts[s] : starts[s + 1]] - s * step, counts[starts[s] : starts[s + 1]] > 1) for s in filled]
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(np.full(len(filled), part, np.int32)), pa.array(data, pa.binary())], names=names)

    def sketch(batches):
        from pyspark import TaskContext

        part, sampler, held, size = TaskContext.get().partitionId(), Sampler(least, window), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and len(text) >= least:
                    hashes = np.unique(sampler(code_points(text))[1])  # a window twice in one text is one
                    for cells in _cells(hashes, bits):
                        held.append(np.unique(cells))
                        size += len(cells)
            if size > FLUSH:
                yield told(part, held)
                held, size = [], 0
        if held:
            yield told(part, held)

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        once, again = np.zeros(step, dtype=bool), np.zeros(step, dtype=bool)
        for data in frame["cells"]:
            cells, twice = _heard(data)
            again[cells] |= once[cells] | twice
            once[cells] = True
        at = np.flatnonzero(once)
        return pd.DataFrame({"segment": [key[0]], "part": [key[1]], "cells": [_told(at, again[at])]}).astype({"segment": "int32", "part": "int32"})

    texts = documents.select("text")
    parts = texts.mapInArrow(sketch, schema)
    left = texts.rdd.getNumPartitions()
    while True:
        left = -(-left // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("segment", "part").applyInPandas(merged, schema)
        if left <= 1:
            break
    out = np.zeros((SEGMENTS, step // 8), dtype=np.uint8)
    for row in parts.toLocalIterator():
        cells, again = _heard(bytes(row["cells"]))
        bit = np.zeros(step, dtype=bool)
        bit[cells[again]] = True
        out[row["segment"]] = np.packbits(bit)
    return out.ravel()


def repeated_windows(documents: DataFrame, scratch: Scratch, id: str = "doc_id", least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """id, hash, place and the surroundings of each sampled window that stands in more than one document.

    Only ids, hashes and places are shuffled to find the windows; then the texts that hold some are met with their
    places. A sketch that is full sends more places, in proportion to the texts, and no more surroundings.
    """
    spark = documents.sparkSession
    chosen = documents.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), "text")
    size = cell_bits(chosen.agg(F.sum(F.length("text"))).first()[0] or 0, least, window)
    bits = spark.sparkContext.broadcast(repeated_cells(chosen, size, least, window))
    around = least - window

    def places(part: pa.RecordBatch) -> dict:
        sampler, cells = Sampler(least, window), bits.value
        rows, hashes_out, places_out = [], [], []
        for row, text in enumerate(part.column(1).to_pylist()):
            if not text or len(text) < least:
                continue
            at, hashes = sampler(code_points(text))
            both = np.ones(len(hashes), dtype=bool)
            for c in _cells(hashes, size):
                both &= (cells[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
            rows.append(np.full(int(both.sum()), row))
            hashes_out.append(hashes[both].view(np.int64))
            places_out.append(at[both])
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, hashes_out, places_out)]
        return {"id": part.column(0).take(pa.array(joined[0], pa.int64())), "hash": joined[1], "place": joined[2].astype(np.int32)}

    narrow = scratch.cut(map_arrow(chosen, T.StructType([chosen.schema["id"], *T.StructType.fromDDL("hash long, place int").fields]), "text", places))
    repeated = narrow.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("hash")
    held = narrow.join(repeated, "hash").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("place", "hash"))).alias("w"))
    # Two plain arrays are a third of an array of structs when they are broadcast.
    held = scratch.cut(held.select("id", F.transform("w", lambda w: w["place"]).alias("places"), F.transform("w", lambda w: w["hash"]).alias("hashes")))
    scratch.drop(narrow)
    texts = chosen.join(size_checked(held, MOST_BROADCAST, MOST_BYTES), "id")

    def surroundings(part: pa.RecordBatch) -> dict:
        rows, hashes_out, places_out, left, right = [], [], [], [], []
        for row, (text, at, hashes) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))):
            for p, h in zip(at, hashes) if text else ():
                if p + window <= len(text):
                    rows.append(row)
                    hashes_out.append(h)
                    places_out.append(p)
                    left.append(text[max(0, p - around) : p])
                    right.append(text[p : p + window + around])
        return {"id": part.column(0).take(pa.array(rows, pa.int64())), "hash": hashes_out, "place": places_out, "left": left, "right": right}

    schema = T.StructType([chosen.schema["id"], *T.StructType.fromDDL("hash long, place int, left string, right string").fields])
    return scratch.cut(map_arrow(texts.select("id", "text", "places", "hashes"), schema, "text", surroundings))


@F.pandas_udf(T.StructType([T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType())]))
def extensions(left_a: pd.Series, right_a: pd.Series, left_b: pd.Series, right_b: pd.Series) -> pd.DataFrame:
    """How many characters agree before the place and from it on."""

    def common(x: str, y: str) -> int:
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            return n
        low, high = 0, n
        while high - low > 1:  # x[:low] agrees, x[:high] does not
            middle = (low + high) // 2
            low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle)
        return low

    back = [common(x[::-1], y[::-1]) for x, y in zip(left_a, left_b)]
    on = [common(x, y) for x, y in zip(right_a, right_b)]
    return pd.DataFrame({"l": back, "r": on}, dtype="int32")


@dataclass
class Runs:
    members: DataFrame  # id, hash, place, side: windows by class of equal surroundings
    between: DataFrame  # hash, side_a, side_b, l, r: runs between classes, or inside one of several documents
    crowded: DataFrame  # key, hash, side, l, r: classes that hold one and the same span of `least` characters


def runs(windows: DataFrame, scratch: Scratch, least: int = LEAST, window: int = WINDOW) -> Runs:
    """The spans of at least `least` characters around repeated windows.

    Windows of one hash whose surroundings are wholly equal are one class, so copies by the thousand cost one
    comparison. Up to FEW classes of a hash are compared with each other; where there are more, each class is spread
    to all its spans of exactly `least` characters around the window and these are grouped, which takes time in
    proportion to the classes and finds the same.
    """
    grouped = windows.withColumn("side", F.xxhash64("left", F.lit(1), "right", F.lit(2)))
    members = scratch.cut(grouped.select("id", "hash", "place", "side").distinct())
    faces = scratch.cut(grouped.groupBy("hash", "side").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.min("id").alias("low"), F.max("id").alias("high")))
    sizes = faces.groupBy("hash").agg(F.count(F.lit(1)).alias("faces")).filter("faces > 1")
    several = faces.join(sizes, "hash")
    few, many = several.filter(F.col("faces") <= FEW), several.filter(F.col("faces") > FEW)

    a = few.select("hash", F.col("side").alias("side_a"), F.col("left").alias("la"), F.col("right").alias("ra"))
    b = few.select("hash", F.col("side").alias("side_b"), F.col("left").alias("lb"), F.col("right").alias("rb"))
    met = a.join(b, "hash").filter("side_a < side_b").withColumn("e", extensions("la", "ra", "lb", "rb"))
    across = met.filter((F.col("e.r") >= window) & (F.col("e.l") + F.col("e.r") >= least)).select("hash", "side_a", "side_b", "e.l", "e.r")
    whole = F.length("left") + F.length("right")
    within = faces.filter((F.col("low") != F.col("high")) & (whole >= least)).select("hash", F.col("side").alias("side_a"), F.col("side").alias("side_b"), F.length("left").alias("l"), F.length("right").alias("r"))

    def spread(part: pa.RecordBatch) -> dict:
        hashes, sides, keys, l_out, r_out = [], [], [], [], []
        for h, side, left, right in zip(*(part.column(k).to_pylist() for k in range(4))):
            text, n = left + right, len(left)
            for start in range(max(0, n + window - least), min(n, len(text) - least) + 1):
                hashes.append(h)
                sides.append(side)
                keys.append(xxhash.xxh3_128_digest(text[start : start + least].encode()))
                l_out.append(n - start)
                r_out.append(least - (n - start))
        return {"key": keys, "hash": hashes, "side": sides, "l": l_out, "r": r_out}

    spans = map_arrow(many.select("hash", "side", "left", "right"), "key binary, hash long, side long, l int, r int", None, spread)
    spans = scratch.cut(spans)
    met_keys = spans.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return Runs(members, scratch.cut(across.unionByName(within)), scratch.cut(spans.join(met_keys, "key")))


def _seal() -> list:
    """What tells sets of documents apart: their number and two sums of hashes."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(3))).alias("x")]


def pairs(found: Runs) -> DataFrame:
    """id_a < id_b of all documents with a run in common.

    The same documents meet in many windows: of the meetings with the same documents on both sides one is expanded, the
    documents of a crowded side in parts (`joined_apart`).
    """
    holders = found.members.select("hash", "side", "id").distinct()
    sealed = holders.groupBy("hash", "side").agg(*_seal()).select("hash", "side", F.struct("n", "s", "x").alias("seal"))
    sizes = sealed.select("hash", "side", F.col("seal.n").alias("n"))
    a, b = sealed.select("hash", F.col("side").alias("side_a"), F.col("seal").alias("seal_a")), sealed.select("hash", F.col("side").alias("side_b"), F.col("seal").alias("seal_b"))
    once = found.between.select("hash", "side_a", "side_b").join(a, ["hash", "side_a"]).join(b, ["hash", "side_b"]).groupBy("seal_a", "seal_b").agg(F.min(F.struct("hash", "side_a", "side_b")).alias("m")).select("m.*")
    as_ = lambda df, side: df.withColumnRenamed("side", f"side_{side}").withColumnRenamed("id", side)
    first = joined_apart(once, as_(holders, "a"), as_(sizes, "a"), ["hash", "side_a"], "a")
    met = joined_apart(first, as_(holders, "b"), as_(sizes, "b"), ["hash", "side_b"], "b").filter("a != b").select("a", "b")
    keyed = found.crowded.select("key", "hash", "side").join(holders, ["hash", "side"]).select("key", "id").distinct()
    kept = keyed.groupBy("key").agg(*_seal()).filter("n > 1").groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n")
    keyed = keyed.join(kept.select("key"), "key")
    crowd = joined_apart(keyed.select("key", F.col("id").alias("a")), keyed.select("key", F.col("id").alias("b")), kept, ["key"], "b").filter("a < b").select("a", "b")
    return met.unionByName(crowd).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def covered(documents: DataFrame, found: Runs, id: str = "doc_id") -> DataFrame:
    """Per document: characters, characters that stand in spans shared with another document, and their share.

    The greatest reach of each class over all its runs is taken per window; windows lie so close that the reaches of
    one shared span overlap, and their union is the span.
    """
    held = found.crowded.join(found.members, ["hash", "side"]).groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("key")
    ends = found.between.select("hash", F.col("side_a").alias("side"), "l", "r").unionByName(found.between.select("hash", F.col("side_b").alias("side"), "l", "r"))
    ends = ends.unionByName(found.crowded.join(held, "key").select("hash", "side", "l", "r")).distinct()
    spans = found.members.join(ends, ["hash", "side"]).select("id", (F.col("place") - F.col("l")).alias("start"), (F.col("place") + F.col("r")).alias("stop")).distinct()
    before = W.partitionBy("id").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    fresh = spans.withColumn("reach", F.coalesce(F.max("stop").over(before), F.lit(0))).withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach")))
    shared = fresh.groupBy("id").agg(F.sum("new").alias("shared_chars"))
    sizes = documents.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    out = sizes.join(shared, "id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.select(F.col("id").alias(id), "chars", "shared_chars", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0).alias("shared_share"))
