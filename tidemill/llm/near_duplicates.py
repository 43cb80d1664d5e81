"""Near-duplicate records with small edits: weighted Jaccard similarity by BagMinHash.

An element of weight w (a shingle that stands w times in a text) owns the discretised weight levels 1..w. The levels
form dyadic blocks [2^j, 2^(j+1)); each block of each element is a Poisson process of its size, whose points fall in
order of time on a random register and a random level of the block, and count if the element owns that level. A
register holds its earliest point, and two texts agree on a register with a probability of exactly their weighted
Jaccard similarity. Points are drawn block by block only up to the time by which all registers are filled, so a text
takes time in proportion to its distinct elements and not to elements times registers.

Signatures are banded; pairs of one bucket are held against the whole signatures (crowded buckets block by block, see
`buckets`) and then verified by the overlap of their multisets (40-bit shingle hashes). Texts with equal multisets are one class and enter once; pairs between classes
are found and verified, and only the pairs asked for are expanded to members.

Defined cases: texts with fewer words than a shingle (null, empty and blank ones too) have no partner; repeated rows of
one id are one record, the latest holds; rows without id are dropped; ties don't arise; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..tables import Scratch
from . import buckets
from .arrow import map_arrow, mix64

_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_STEP, _BLOCK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_FILL = 4.0  # the first time limit leaves a register empty with a probability of about e^-4 in all
HASH_BYTES = 5


@dataclass(frozen=True)
class Setup:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4
    bags: bool = True  # multisets; else every weight is 1

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def bag_min_hash(elements: np.ndarray, weights: np.ndarray, lengths: np.ndarray, registers: int) -> np.ndarray:
    """A row of registers per text: their earliest times, as 64-bit words that agree only for the same point.

    `elements` and `weights` of the texts stand one after the other, `lengths` (1 at least) of them for each text.
    """
    text = np.repeat(np.arange(len(lengths)), lengths)
    blocks = np.floor(np.log2(weights)).astype(np.int64)
    owner = np.arange(len(elements))
    if blocks.any():
        repeat = blocks + 1
        owner = np.repeat(owner, repeat)
        blocks = np.arange(len(owner)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    seeds = mix64(elements[owner] + blocks.astype(np.uint64) * _BLOCK)
    rates, owned, texts = np.exp2(blocks), weights[owner], text[owner]
    limits = registers * (np.log(registers) + _FILL) / np.bincount(text, weights, len(lengths))
    earliest = np.full(len(lengths) * registers, np.inf)
    open_texts = np.ones(len(lengths), dtype=bool)
    while True:
        live = np.flatnonzero(open_texts[texts])
        state, at, rate, own, most = seeds[live], texts[live], rates[live], owned[live], limits[texts[live]]
        time = np.zeros(len(live))
        while len(state):
            state = state + _STEP
            draw = mix64(state)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            on = np.flatnonzero(time < most)
            time, state, draw, at, rate, own, most = time[on], state[on], draw[on], at[on], rate[on], own[on], most[on]
            fall = mix64(draw ^ _BLOCK)
            register = (((fall >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
            level = rate + np.floor((fall & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate)
            hit = level <= own
            np.minimum.at(earliest, (at * registers + register)[hit], time[hit])
        open_texts = ~np.isfinite(earliest).reshape(len(lengths), registers).all(axis=1)
        if not open_texts.any():
            return mix64(earliest.view(np.uint64)).reshape(len(lengths), registers)
        limits[open_texts] *= 2


class Shingler:
    """Word shingles of a text as 64-bit hashes; word hashes are kept within a batch."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        self.factors = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        found = _WORDS.findall(text.lower()) if text else ()
        n = len(found) - self.words + 1
        if n < 1:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        try:
            hashes = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.words):
            out += hashes[k : k + n] * self.factors[k]
        return mix64(out)


def multiset(shingles: np.ndarray, bags: bool) -> tuple[np.ndarray, np.ndarray]:
    if not bags:
        elements = np.sort(shingles)
        if len(elements) > 1:
            elements = elements[np.concatenate([[True], elements[1:] != elements[:-1]])]
        return elements, np.ones(len(elements))
    elements, counts = np.unique(shingles, return_counts=True)
    return elements, counts.astype(np.float64)


def sketches(records: DataFrame, setup: Setup) -> DataFrame:
    """id, version, class (128 bits of the multiset), size, signature (a byte a register), bands."""
    schema = T.StructType([records.schema["id"], records.schema["version"], *T.StructType.fromDDL("hi long, lo long, size long, signature binary, bands array<long>").fields])

    def make(part: pa.RecordBatch) -> dict:
        shingle = Shingler(setup.words)
        n = part.num_rows
        hi, lo, size, signature, bands = [None] * n, [None] * n, [0] * n, [None] * n, [None] * n
        filled, elements, weights = [], [], []
        for row, text in enumerate(part.column(2).to_pylist()):
            e, w = multiset(shingle(text), setup.bags)
            if len(e):
                filled.append(row)
                elements.append(e)
                weights.append(w)
                size[row] = int(w.sum())
                hi[row], lo[row] = np.frombuffer(xxhash.xxh3_128_digest(e.tobytes() + w.tobytes() if setup.bags else e.tobytes()), dtype=">i8").tolist()
        if filled:
            words = bag_min_hash(np.concatenate(elements), np.concatenate(weights), np.fromiter(map(len, elements), np.int64, len(elements)), setup.registers)
            grid = words.reshape(-1, setup.bands, setup.rows)
            band = np.broadcast_to(mix64(np.arange(1, setup.bands + 1, dtype=np.uint64)), grid.shape[:2])
            for k in range(setup.rows):
                band = mix64(band ^ grid[:, :, k]) + np.uint64(k)
            tops, band = (words >> np.uint64(56)).astype(np.uint8), band.view(np.int64)
            for at, row in enumerate(filled):
                signature[row], bands[row] = tops[at].tobytes(), band[at]
        return {"id": part.column(0), "version": part.column(1), "hi": hi, "lo": lo, "size": size, "signature": signature, "bands": bands}

    return map_arrow(records.select("id", "version", "text"), schema, "text", make)


def packed(hashes: np.ndarray) -> bytes:
    """The set of some hashes, sorted, HASH_BYTES bytes each."""
    kept = np.unique(hashes & np.uint64((1 << 8 * HASH_BYTES) - 1))
    return kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def packed_sets(records: DataFrame, setup: Setup) -> DataFrame:
    """id and the sorted shingles, HASH_BYTES bytes each, with counts appended as further shingles."""
    schema = T.StructType([records.schema["id"], T.StructField("packed", T.BinaryType())])

    def make(part: pa.RecordBatch) -> dict:
        shingle = Shingler(setup.words)
        out = []
        for text in part.column(1).to_pylist():
            hashes = shingle(text)
            if setup.bags:  # the k-th occurrence of a shingle is an element of its own
                hashes = np.sort(hashes)
                first = np.searchsorted(hashes, hashes)
                hashes = mix64(hashes + (np.arange(len(hashes)) - first).astype(np.uint64) * _BLOCK)
            out.append(packed(hashes))
        return {"id": part.column(0), "packed": out}

    return map_arrow(records.select("id", "text"), schema, "text", make)


def _unpacked(packed: bytes) -> np.ndarray:
    cells = np.zeros((len(packed) // HASH_BYTES, 8), dtype=np.uint8)
    cells[:, :HASH_BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, HASH_BYTES)
    return cells.view("<u8").ravel()


def similarity() -> object:
    """Jaccard similarity of two packed sets."""

    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = _unpacked(x), _unpacked(y)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(jaccard, T.DoubleType())


@dataclass
class Classes:
    members: DataFrame  # id, hi, lo of every record; hi and lo are null where it has no shingle
    pairs: DataFrame  # rep_a < rep_b, similarity
    representatives: DataFrame  # hi, lo, rep, copies


def classes(records: DataFrame, scratch: Scratch, setup: Setup) -> Classes:
    """Classes of equal multisets and the verified pairs of their representatives. `records`: id, version, text."""
    records = records.filter("id is not null")
    sketched = scratch.cut(sketches(records, setup))
    members = scratch.cut(sketched.groupBy("id").agg(F.max_by(F.struct("hi", "lo"), F.struct("version", "size", "hi", "lo")).alias("c")).select("id", "c.hi", "c.lo"))
    reps = members.filter("hi is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.cut(reps)
    chosen = sketched.join(reps.select(F.col("rep").alias("id"), "hi", "lo"), ["id", "hi", "lo"]).dropDuplicates(["id"])
    chosen = scratch.cut(chosen.select("id", "size", "signature", "bands"))
    scratch.drop(sketched)  # members and the chosen rows are tables of their own

    banded = chosen.select("id", F.explode("bands").alias("band"))
    alike = lambda: F.least("size_a", "size_b") >= s * F.greatest("size_a", "size_b")
    s = setup.similarity
    slack = 5 * float(np.sqrt(s * (1 - s) / setup.registers))
    near = scratch.cut(buckets.pairs(banded, chosen.select("id", "size", "signature"), setup.registers, s - slack, scratch, alike))

    scratch.drop(chosen)
    involved = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    latest = records.join(involved, "id", "left_semi")
    latest = latest.groupBy("id").agg(F.max_by("text", F.struct("version", F.length("text"), "text")).alias("text"))
    sets = scratch.cut(packed_sets(latest, setup))
    both = near.join(sets.select(F.col("id").alias("a"), F.col("packed").alias("p")), "a").join(sets.select(F.col("id").alias("b"), F.col("packed").alias("q")), "b")
    verified = both.select("a", "b", similarity()("p", "q").alias("similarity")).filter(F.col("similarity") >= s - 1e-12)
    return Classes(members, scratch.cut(verified.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "similarity")), reps)


ROWS_A_PART = 512


def joined_apart(left: DataFrame, members: DataFrame, sizes: DataFrame, key: list[str], id: str) -> DataFrame:
    """`left` joined with `members` (key, id), the members of a large key in parts of about ROWS_A_PART rows, so that the
    rows of a key are made by many tasks. `sizes`: key, n."""
    parted = sizes.select(*key, F.ceil(F.col("n") / ROWS_A_PART).cast("int").alias("_parts"))
    salted = members.join(parted, key).withColumn("_salt", F.pmod(F.xxhash64(id), F.col("_parts")).cast("int")).drop("_parts")
    return left.join(parted, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").join(salted, [*key, "_salt"]).drop("_salt")


def pairs_of_members(found: Classes) -> DataFrame:
    """Every pair of records: those of two linked classes, and those within one class."""
    sizes = found.representatives.select("rep", F.col("copies").alias("n"))
    named = found.members.join(found.representatives, ["hi", "lo"]).select("id", "rep", "copies")
    as_ = lambda df, side: df.withColumnRenamed("rep", f"rep_{side}")
    first = joined_apart(found.pairs.select("rep_a", "rep_b"), as_(named.select(F.col("id").alias("a"), "rep"), "a"), as_(sizes, "a"), ["rep_a"], "a")
    across = joined_apart(first.select("a", "rep_b"), as_(named.select(F.col("id").alias("b"), "rep"), "b"), as_(sizes, "b"), ["rep_b"], "b").select("a", "b")
    several = named.filter("copies > 1")
    within = joined_apart(several.select(F.col("id").alias("a"), "rep"), several.select(F.col("id").alias("b"), "rep"), sizes.filter("n > 1"), ["rep"], "b").filter("a < b").select("a", "b")
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within)


def components(edges: DataFrame, scratch: Scratch, a: str, b: str) -> DataFrame:
    """id and the least id of its component, for every id in an edge. Labels fall to the least neighbour's and then jump.

    Each round joins labels with edges and labels with labels; the rounds grow with the logarithm of the diameter.
    """
    both = scratch.cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = scratch.cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        around = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("around"))
        lowered = labels.join(around, "id").select("id", "label", F.least("label", "around").alias("low"))
        jumped = lowered.join(labels.select(F.col("id").alias("low"), F.col("label").alias("far")), "low", "left")
        nxt = scratch.cut(jumped.select("id", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) != F.col("label")).alias("moved")))
        changed = bool(nxt.filter("moved").limit(1).collect())
        scratch.drop(labels)
        labels = nxt.drop("moved")
        if not changed:
            return labels


def groups(found: Classes, scratch: Scratch) -> DataFrame:
    """One row per record: id, class_id (its least copy), group_id (least record of its component), links.

    `links` counts the record's partners in other classes; copies are not expanded.
    """
    labels = components(found.pairs, scratch, "rep_a", "rep_b")
    ends = found.pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).union(found.pairs.select("rep_b", "rep_a"))
    links = ends.join(found.representatives.select(F.col("rep").alias("other"), F.col("copies").alias("n")), "other").groupBy("rep").agg(F.sum("n").alias("links"))
    reps = found.representatives.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").join(links, "rep", "left")
    joined = found.members.join(reps, ["hi", "lo"], "left")
    return joined.select("id", F.coalesce("rep", "id").alias("class_id"), F.coalesce("label", "rep", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
