"""Most similar vectors for every vector: NN-descent by iterative Spark joins.

Vectors with equal components are one class and stand in the graph once, as a numbered node in the order of ids. One
pass over the vectors turns each into a code (a fixed random rotation, four bits a place: the cosine of two codes is off
by about 0.01) and a few sign hashes. The start lists are poor on purpose: in each of ORDERS orders by sign hash a node
meets the WINDOW nodes before and after it and keeps the SEEDS best. Then NN-descent does the work. In each round a hub
is joined with the codes of its members (its list and up to BACK of those that list it); members of one hub are scored
with each other if one of them is new there, each proposes the PROPOSED best to each other where they beat the end of
its list, and lists keep the WIDTH best, ties going to smaller nodes. It ends after LEAST_ROUNDS rounds when hardly any entry is new. All of it is
alike at every size: nothing is gathered but one number a round, and no switch depends on the number of vectors.

Codes can't order vectors that lie closer than their error. Where a whole list is nearer than TIGHT, its node goes on
with the vectors themselves in place of the codes, and SHARPER entries are added to its list.

The pairs that can still be among the k nearest, by the error of the codes, are then scored exactly on the vectors.
Queries walk the graph greedily: from the nodes of their own sign hash, and some of all, the lists of the best nodes
seen are scored, until the best have all been expanded. Neighbours in two orders are links of the walk, so the graph is one.

NN-descent is approximate by design: BACK, PROPOSED and the seeds sample candidates; recall against brute force is
measured in the tests and given in the README.

Defined cases: vectors that are null, of another length, all zero or not finite are left out; of several usable vectors
of one article the latest holds; equal cosines go to the smaller id; rows without id are dropped; fewer than k other
vectors give shorter lists; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..tables import Scratch, size_checked
from .arrow import list_array, map_arrow

CODE_PLACES, STEP, CODE_ERROR = 384, 0.3352, 0.015  # the step suits a normal distribution; the error is of either code
ORDERS, HASH_BITS, WINDOW, SEEDS = 8, 30, 12, 4
WIDTH, BACK, PROPOSED = 24, 24, 6
LEAST_ROUNDS, ROUNDS, SETTLED = 4, 8, 0.03
TIGHT, SHARPER = 0.9, 12
DIGITS = 12
MOST_BROADCAST = 200_000
HUBS_AT_ONCE, ENTRIES_AT_ONCE = 64, 1 << 20
ENTRY_BITS, ENTRIES, COMMON_ENTRIES = 10, 8, 16


def unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def stacked(values: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and float32 rows of the usable vectors of a list column."""
    right = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(values), -1)) == dimensions
    at = np.flatnonzero(right)
    flat = values.take(pa.array(at)).flatten().cast(pa.float32())
    rows = flat.to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return at[good], rows[good]


@lru_cache(maxsize=4)
def turns(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations that spread a vector evenly over at least CODE_PLACES places, and the planes of the sign hashes."""
    rng = np.random.default_rng(5)
    copies = -(-CODE_PLACES // dimensions)
    rotations = np.concatenate([np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(copies)], axis=1)
    if rotations.shape[1] % 2:
        rotations = np.concatenate([rotations, rotations[:, :1]], axis=1)
    return rotations.astype(np.float32) * np.float32(np.sqrt(dimensions)), rng.standard_normal((dimensions, ORDERS * HASH_BITS)).astype(np.float32)


def encoded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (bytes of two places each) and ORDERS sign hashes of float32 rows."""
    rotations, planes = turns(rows.shape[1])
    units = unit(rows).astype(np.float32)
    places = (np.clip(np.floor(units @ rotations / np.float32(STEP)), -8, 7) + 8).astype(np.uint8)
    signs = (units @ planes > 0).reshape(len(rows), ORDERS, HASH_BITS)
    return places[:, ::2] << 4 | places[:, 1::2], signs @ (1 << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64))


def decoded(codes: pa.Array) -> np.ndarray:
    """Unit float32 rows of a column of codes."""
    packed = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(len(codes), -1)
    out = np.empty((len(packed), packed.shape[1] * 2), dtype=np.float32)
    out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
    out -= np.float32(7.5)
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out


@dataclass
class Vectors:
    raw: DataFrame  # the rows given: id, version, vec
    members: DataFrame  # id, rep: every usable id and the least id with the same vector
    nodes: DataFrame  # node, id, version, h, code, hashes: one row per class, numbered in the order of ids
    dimensions: int

    def of(self, nodes: DataFrame) -> DataFrame:
        """node and vec (binary of float32) of some nodes (node); the rows are told by id, version and hash."""
        dimensions = self.dimensions
        wanted = self.nodes.join(nodes, "node", "left_semi").select("node", "id", "version", "h")
        kept = self.raw.withColumn("h", F.xxhash64("vec")).join(size_checked(wanted, MOST_BROADCAST), ["id", "version", "h"])

        def make(part: pa.RecordBatch) -> dict:
            at, rows = stacked(part.column(1), dimensions)
            return {"node": part.column(0).take(pa.array(at)), "vec": [r.tobytes() for r in rows]}

        return map_arrow(kept.select("node", "vec"), "node long, vec binary", None, make).dropDuplicates(["node"])


def vectors(rows: DataFrame, scratch: Scratch, dimensions: int) -> Vectors:
    """`rows`: id (string), version (orderable), vec (array of float)."""
    rows = rows.filter("id is not null and vec is not null").withColumn("version", F.coalesce(F.col("version"), F.lit(0).cast(rows.schema["version"].dataType)))
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL("h long, hi long, lo long, code binary, hashes array<int>").fields])

    def make(part: pa.RecordBatch) -> dict:
        at, vecs = stacked(part.column(2), dimensions)
        taken = part.take(pa.array(at))
        keys = b"".join(xxhash.xxh3_128_digest((v + np.float32(0)).tobytes()) for v in vecs)
        pair = np.frombuffer(keys, dtype=">i8").astype(np.int64).reshape(-1, 2)
        codes, hashes = encoded(vecs) if len(vecs) else (vecs, vecs)
        return {"id": taken.column(0), "version": taken.column(1), "h": taken.column(3), "hi": pair[:, 0], "lo": pair[:, 1], "code": [c.tobytes() for c in codes], "hashes": list_array(hashes.astype(np.int32).ravel(), np.full(len(vecs), ORDERS), pa.int32())}

    rows = rows.select("id", "version", "vec")
    narrow = map_arrow(rows.withColumn("h", F.xxhash64("vec")), schema, None, make)
    newest = scratch.cut(narrow.groupBy("id").agg(F.max(F.struct("version", "hi", "lo", "h", "code", "hashes")).alias("m")).select("id", "m.*"))
    reps = newest.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    members = scratch.cut(newest.select("id", "hi", "lo").join(reps, ["hi", "lo"]).select("id", "rep"))
    own = newest.join(members.filter("id = rep").select("id"), "id", "left_semi").orderBy("id")
    nodes = scratch.cut(own.select(F.monotonically_increasing_id().alias("node"), "id", "version", "h", "code", "hashes"))
    scratch.drop(newest)
    return Vectors(rows, members, nodes, dimensions)


def runs(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew where its value changes, `at_least` rows together where there are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < at_least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        if whole.num_rows:
            yield whole


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def best_of(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, new: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each id the `most` best others, best first, each once (as old where it was known), equal ones by smaller node."""
    order = np.lexsort((new, others, ids))
    ids, others, sims, new = ids[order], others[order], sims[order], new[order]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
    ids, others, sims, new = ids[first], others[first], sims[first], new[first]
    order = np.lexsort((others, -sims, ids))
    ids, others, sims, new = ids[order], others[order], sims[order], new[order]
    starts, sizes = grouped(ids)
    kept = np.arange(len(ids)) - np.repeat(starts, sizes) < most
    return ids[kept], others[kept], sims[kept], new[kept]


LISTS = "id long, others array<long>, sims array<float>, fresh array<boolean>"


def listed(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    """One row per id of entries sorted by id."""
    starts, sizes = grouped(ids)
    cols = [pa.array(ids[starts], pa.int64()), list_array(others, sizes, pa.int64()), list_array(sims.astype(np.float32), sizes, pa.float32()), list_array(new, sizes, pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "others", "sims", "fresh"])


def _flat(table: pa.Table, column: int) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def merged(lists: DataFrame, most: int) -> DataFrame:
    """Lists of one id put together, the `most` best kept."""

    def run(batches):
        for table in runs(batches, 1 << 14):
            sizes = pa.compute.list_value_length(table.column(1)).to_numpy()
            ids = np.repeat(table.column(0).to_numpy(), sizes)
            if len(ids):
                yield listed(*best_of(ids, _flat(table, 1), _flat(table, 2), _flat(table, 3), most))

    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(run, LISTS)


def ordered(v: Vectors, orders: range) -> DataFrame:
    """hash, node, code of every node in each order, sorted by hash and node over range partitions."""
    each = F.array(*[F.shiftleft(F.lit(t).cast("long"), HASH_BITS) + F.get("hashes", F.lit(t)) for t in orders])
    return v.nodes.select(F.explode(each).alias("hash"), "node", "code").repartitionByRange("hash", "node").sortWithinPartitions("hash", "node")


def start_lists(v: Vectors) -> DataFrame:
    """The SEEDS best of the WINDOW nodes before and after each node in each order."""

    def run(batches):
        hashes, nodes, codes = np.empty(0, np.int64), np.empty(0, np.int64), None
        done = 0  # rows at the front whose later neighbours were seen too
        for batch in batches:
            if not batch.num_rows:
                continue
            more = decoded(batch.column(2))
            hashes, nodes = np.concatenate([hashes, batch.column(0).to_numpy()]), np.concatenate([nodes, batch.column(1).to_numpy()])
            codes = more if codes is None else np.concatenate([codes, more])
            n = len(nodes)
            sims = np.full((2 * WINDOW, n), -2, dtype=np.float32)
            for gap in range(1, min(WINDOW, n - 1) + 1):
                near = np.einsum("ij,ij->i", codes[gap:], codes[:-gap])
                near[hashes[gap:] >> HASH_BITS != hashes[:-gap] >> HASH_BITS] = -2
                sims[gap - 1, :-gap], sims[WINDOW + gap - 1, gap:] = near, near
            k = min(SEEDS, 2 * WINDOW)
            best = np.argpartition(-sims, k - 1, axis=0)[:k]
            value = np.take_along_axis(sims, best, 0)
            gaps = np.where(best < WINDOW, best + 1, WINDOW - 1 - best)
            row, place = np.nonzero((value > -2).T[done:])
            at = row + done
            yield listed(*best_of(nodes[at], nodes[at + gaps[place, at]], value[place, at], np.ones(len(at), dtype=bool), SEEDS))
            rest = max(0, n - WINDOW)
            # The last rows come again with their later neighbours; what is told twice is merged.
            hashes, nodes, codes = hashes[max(0, rest - WINDOW) :], nodes[max(0, rest - WINDOW) :], codes[max(0, rest - WINDOW) :]
            done = min(WINDOW, rest)

    return merged(ordered(v, range(ORDERS)).mapInArrow(run, LISTS), WIDTH)


def as_they_are(rows: pa.Array) -> np.ndarray:
    """Unit float32 rows of a column of raw float32 vectors."""
    return unit(np.frombuffer(b"".join(rows.to_pylist()), dtype=np.float32).reshape(len(rows), -1)).astype(np.float32)


def local_joins(batches: Iterator[pa.RecordBatch], read=decoded) -> Iterator[pa.RecordBatch]:
    """Proposals among the members of each hub. Columns: hub, member, fresh, least, code; sorted by hub."""
    held: list[tuple[np.ndarray, ...]] = []
    for table in runs(batches, 1 << 12):
        hubs, members, fresh, least = (table.column(k).to_numpy() for k in range(4))
        codes = read(table.column(4).combine_chunks())
        starts, sizes = grouped(hubs)
        for a in range(0, len(starts), HUBS_AT_ONCE):
            some, lengths = starts[a : a + HUBS_AT_ONCE], sizes[a : a + HUBS_AT_ONCE]
            rows = np.arange(some[0], some[-1] + lengths[-1])
            hub = np.repeat(np.arange(len(some)), lengths)
            place = rows - some[hub]
            width = int(lengths.max())
            if width < 2:
                continue
            grid = np.zeros((len(some), width, codes.shape[1]), dtype=np.float32)
            grid[hub, place] = codes[rows]
            who = np.full((len(some), width), -1, dtype=np.int64)
            who[hub, place] = members[rows]
            new = np.zeros((len(some), width), dtype=bool)
            new[hub, place] = fresh[rows]
            limit = np.full((len(some), width), 2, dtype=np.float32)
            limit[hub, place] = least[rows]
            sims = grid @ grid.transpose(0, 2, 1)
            sims[~(new[:, :, None] | new[:, None, :]) | (who[:, None, :] < 0) | (who[:, :, None] == who[:, None, :]) | (sims < limit[:, :, None])] = -2
            k = min(PROPOSED, width)
            best = np.argpartition(-sims, k - 1, axis=2)[:, :, :k]
            value = np.take_along_axis(sims, best, 2)
            g, i, j = np.nonzero(value > -2)
            held.append((who[g, i], who[g, best[g, i, j]], value[g, i, j]))
        if sum(len(h[0]) for h in held) > ENTRIES_AT_ONCE:
            yield _proposals(held)
            held = []
    if held:
        yield _proposals(held)


def _proposals(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, others, sims = (np.concatenate(x) for x in zip(*held))
    return listed(*best_of(ids, others, sims, np.ones(len(ids), dtype=bool), WIDTH))


def descended(codes: DataFrame, lists: DataFrame, turn: int, read=decoded, anew: bool = False) -> DataFrame:
    """Lists after one round: neighbours of neighbours meet at their hubs. `codes`: node, code.

    With `anew` the lists only say who meets: hubs meet their members too, and the lists are made from what is scored.
    """
    edges = lists.select("id", F.explode(F.arrays_zip("others", "fresh")).alias("e")).select("id", F.col("e.others").alias("other"), (F.col("e.fresh") | F.lit(anew)).alias("fresh"))
    by = W.partitionBy("other").orderBy(F.col("fresh").desc(), F.xxhash64("id", "other", F.lit(turn)))
    back = edges.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= BACK).select(F.col("other").alias("hub"), F.col("id").alias("member"), "fresh")
    both = edges.select(F.col("id").alias("hub"), F.col("other").alias("member"), "fresh").unionByName(back)
    if anew:
        both = both.unionByName(lists.select(F.col("id").alias("hub"), F.col("id").alias("member"), F.lit(True).alias("fresh")))
    around = both.repartition("member").groupBy("member", "hub").agg(F.bool_or("fresh").alias("fresh"))
    known = codes.select(F.col("node").alias("member"), "code")
    if anew:
        known = known.withColumn("least", F.lit(-1.5).cast("float"))
    else:
        least = lists.select(F.col("id").alias("member"), F.when(F.size("sims") >= WIDTH, F.array_min("sims")).otherwise(F.lit(-1.5)).cast("float").alias("least"))
        known = known.join(least, "member", "left").withColumn("least", F.coalesce("least", F.lit(-1.5).cast("float")))
    met = around.join(known, "member").select("hub", "member", "fresh", "least", "code").repartition("hub").sortWithinPartitions("hub")
    proposed = met.mapInArrow(lambda batches: local_joins(batches, read), LISTS)
    return merged(proposed if anew else proposed.unionByName(lists.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))), WIDTH)


def released(df: DataFrame) -> None:
    """Let Spark's cleaner find the shuffle files of what is no longer referred to, round by round."""
    if jvm := getattr(df.sparkSession.sparkContext, "_jvm", None):
        jvm.java.lang.System.gc()


def rounds_of(codes: DataFrame, lists: DataFrame, scratch: Scratch, read=decoded, anew: bool = False) -> tuple[DataFrame, int]:
    """Rounds until hardly any entry is new; `lists` is a table of the scratch folder and is dropped."""
    for turn in range(1, ROUNDS + 1):
        after = scratch.cut(descended(codes, lists, turn, read, anew and turn == 1))
        scratch.drop(lists)
        lists = after
        released(lists)
        n = lists.agg(F.sum(F.size("others")).alias("all"), F.sum(F.size(F.filter("fresh", lambda x: x))).alias("fresh")).first()
        if not n["fresh"] or turn >= LEAST_ROUNDS and n["fresh"] <= SETTLED * n["all"]:
            break
    return lists, turn


@dataclass
class Graph:
    lists: DataFrame  # id (a node), others, sims, fresh: the WIDTH nearest nodes of each node by their codes
    vectors: Vectors
    rounds: int


def build(v: Vectors, scratch: Scratch) -> Graph:
    lists, turns_made = rounds_of(v.nodes, scratch.cut(start_lists(v)), scratch)
    # Codes can't order what is as near as a whole list of TIGHT entries; those nodes go on with their vectors.
    full = lists.filter((F.size("others") >= WIDTH) & (F.array_min("sims") >= TIGHT))
    if full.limit(1).collect():
        tight = scratch.cut(full)
        own = tight.select(F.col("id").alias("other"))
        entries = tight.select("id", F.explode("others").alias("other")).join(own, "other").groupBy("id").agg(F.collect_list("other").alias("others"))
        start = entries.select("id", "others", F.transform("others", lambda x: F.lit(-1.0).cast("float")).alias("sims"), F.transform("others", lambda x: F.lit(True)).alias("fresh"))
        codes = scratch.cut(v.of(tight.select(F.col("id").alias("node"))).withColumnRenamed("vec", "code"))
        sharp, _ = rounds_of(codes, scratch.cut(start), scratch, as_they_are, anew=True)
        lists = scratch.cut(merged(lists.unionByName(sharp), WIDTH + SHARPER))
    return Graph(lists, v, turns_made)


@F.pandas_udf(T.DoubleType())
def raw_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """To DIGITS places, so that equal cosines are equal however they were summed."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (unit(np.frombuffer(b"".join(s), dtype=np.float32).reshape(len(s), -1)) for s in (a, b))
    return pd.Series(np.round(np.einsum("ij,ij->i", x, y), DIGITS))


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each id; lists are short, as every source of edges gives few per id."""
    w = W.partitionBy("id").orderBy(F.col("cosine").desc(), F.col("other"))
    return edges.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("place")


def exact_edges(graph: Graph, scratch: Scratch, k: int, least: float | None = None) -> DataFrame:
    """id, other (nodes), cosine: the k nearest of each node's list, exactly; with `least` only what is that near.

    Entries that the error of the codes leaves below the k-th, or below `least`, are not scored.
    """
    at = F.coalesce(F.get("sims", F.lit(k - 1)), F.lit(-1.0)) - 2 * CODE_ERROR
    limit = at if least is None else F.greatest(at, F.lit(least - 2 * CODE_ERROR))
    entries = graph.lists.select("id", F.explode(F.arrays_zip("others", "sims")).alias("e"), limit.alias("limit")).filter(F.col("e.sims") >= F.col("limit"))
    pairs = scratch.cut(entries.select(F.least("id", "e.others").alias("a"), F.greatest("id", "e.others").alias("b")).distinct())
    raw = scratch.cut(graph.vectors.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    scored = pairs.join(raw.select(F.col("node").alias("a"), F.col("vec").alias("p")), "a").join(raw.select(F.col("node").alias("b"), F.col("vec").alias("q")), "b").select("a", "b", raw_cosine("p", "q").alias("cosine"))
    if least is not None:
        scored = scored.filter(F.col("cosine") >= least)
    exact = scratch.cut(scored)
    scratch.drop(raw)
    both = exact.select(F.col("a").alias("id"), F.col("b").alias("other"), "cosine").unionByName(exact.select(F.col("b").alias("id"), F.col("a").alias("other"), "cosine"))
    return nearest(both, k)


def named(v: Vectors, edges: DataFrame) -> DataFrame:
    """rep, other_rep, cosine of edges between nodes."""
    ids = v.nodes.select("node", F.col("id").alias("name"))
    out = edges.join(ids.select(F.col("node").alias("id"), F.col("name").alias("rep")), "id").join(ids.select(F.col("node").alias("other"), F.col("name").alias("other_rep")), "other")
    return out.select("rep", "other_rep", "cosine")


def spread(v: Vectors, lists: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """id, other, cosine: the k nearest other ids of every row of `asked` (id, rep), from `lists` (rep, other_rep, cosine)
    of near classes, each class taken as its members.

    Of a class at most the k + 1 smallest ids can be among anyone's k nearest; those are taken salt by salt.
    """
    some = v.members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for w in (W.partitionBy("rep", "salt").orderBy("id"), W.partitionBy("rep").orderBy("id")):
        some = some.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1).drop("place")
    some = some.select(F.col("rep").alias("other_rep"), F.col("id").alias("other"))
    joined = lists.join(some, "other_rep")
    short = joined.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy(F.col("cosine").desc(), "other"))).filter(F.col("place") <= k + 1).drop("place")
    return nearest(asked.join(short, "rep").filter("id != other").select("id", "other", "cosine"), k)


def expanded(graph: Graph, scratch: Scratch, k: int, least: float | None = None) -> DataFrame:
    """id, other, cosine: the k nearest other ids of every id, classes expanded to their members."""
    members = graph.vectors.members
    near = named(graph.vectors, exact_edges(graph, scratch, k, least))
    own = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    own = (own.filter("n > 1") if least is not None else own).select("rep", F.col("rep").alias("other_rep"), F.lit(1.0).alias("cosine"))
    return spread(graph.vectors, near.unionByName(own), members, k)


def search_members(graph: Graph, ids: DataFrame, scratch: Scratch, k: int = 5, **walk) -> DataFrame:
    """id, other, cosine: the k nearest other ids found for each of some usable ids; those of one class share a walk."""
    v = graph.vectors
    asked = scratch.cut(v.members.join(ids.select("id").distinct(), "id", "left_semi"))
    reps = asked.select(F.col("rep").alias("id")).distinct()
    queries = scratch.cut(v.nodes.join(reps, "id", "left_semi").select("node", "id", "hashes"))
    vec = scratch.cut(v.of(queries.select("node")).join(queries, "node").select("id", "vec", "hashes"))
    return spread(v, _found(graph, vec, scratch, k, **walk).unionByName(reps.select(F.col("id").alias("rep"), F.col("id").alias("other_rep"), F.lit(1.0).alias("cosine"))).groupBy("rep", "other_rep").agg(F.max("cosine").alias("cosine")), asked, k)


def search(graph: Graph, queries: DataFrame, scratch: Scratch, k: int = 5, **walk) -> DataFrame:
    """id, other, cosine: the k nearest ids found for each query (id, vec array of float); an id of its own is no answer."""
    dimensions = graph.vectors.dimensions

    def make(part: pa.RecordBatch) -> dict:
        at, rows = stacked(part.column(1), dimensions)
        hashes = encoded(rows)[1] if len(rows) else rows
        return {"id": part.column(0).take(pa.array(at)), "vec": [r.tobytes() for r in rows], "hashes": list_array(hashes.astype(np.int32).ravel(), np.full(len(rows), ORDERS), pa.int32())}

    vec = scratch.cut(map_arrow(queries.select(F.col("id").cast("string").alias("id"), "vec"), "id string, vec binary, hashes array<int>", None, make))
    return spread(graph.vectors, _found(graph, vec, scratch, k, **walk), vec.select("id", F.col("id").alias("rep")), k)


def _found(graph: Graph, queries: DataFrame, scratch: Scratch, k: int, **walk) -> DataFrame:
    """rep (of the query), other_rep, cosine: the nearest classes."""
    near = nearest(walked(graph, queries, scratch, **walk), k + 1)
    ids = graph.vectors.nodes.select(F.col("node").alias("other"), F.col("id").alias("other_rep"))
    return scratch.cut(near.join(ids, "other").select(F.col("id").alias("rep"), "other_rep", "cosine"))


def walked(graph: Graph, queries: DataFrame, scratch: Scratch, keep: int = 32, expand: int = 8, most_rounds: int = 12) -> DataFrame:
    """id, other (a node), cosine: the nodes seen from each query (id, vec binary of float32, hashes)."""
    v = graph.vectors
    # A node is entered from the queries that share the first ENTRY_BITS of a sign hash with it; of such a bucket ENTRIES nodes are entries.
    half = lambda nodes, *more: nodes.select(*more, F.explode(F.array(*[F.shiftleft(F.lit(t).cast("long"), HASH_BITS) + F.shiftright(F.get("hashes", F.lit(t)), HASH_BITS - ENTRY_BITS) for t in range(ORDERS)])).alias("bucket"))
    by = W.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
    entry = half(v.nodes, "node").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= ENTRIES).select("bucket", F.col("node").alias("other"))
    common = v.nodes.select(F.col("node").alias("other")).orderBy(F.xxhash64("node"), "node").limit(COMMON_ENTRIES)
    asked = scratch.cut(queries.select("id", "vec"))
    raw = scratch.cut(v.of(v.nodes.select("node")).select(F.col("node").alias("other"), F.col("vec").alias("q")))
    out = graph.lists.select(F.col("id").alias("via"), F.explode("others").alias("other"))
    back = out.withColumn("n", F.row_number().over(W.partitionBy("other").orderBy(F.xxhash64("via"), "via"))).filter(F.col("n") <= BACK).select(F.col("other").alias("via"), F.col("via").alias("other"))
    places = W.partitionBy("part").orderBy("hash", "node")
    beside = ordered(v, range(2)).select("hash", "node", F.spark_partition_id().alias("part")).withColumn("other", F.lead("node").over(places)).filter("other is not null")
    links = beside.select(F.col("node").alias("via"), "other").unionByName(beside.select(F.col("other").alias("via"), F.col("node").alias("other")))
    edges = scratch.cut(out.unionByName(back).unionByName(links).distinct())

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().join(asked, "id").join(raw, "other").select("id", "other", raw_cosine("vec", "q").alias("cosine"))

    starts = half(queries, "id").join(entry, "bucket").select("id", "other").unionByName(asked.select("id").join(F.broadcast(common)))
    seen = scratch.cut(scored(starts).withColumn("done", F.lit(False)))
    for _ in range(most_rounds):
        best = seen.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))).filter(F.col("place") <= keep)
        ahead = best.filter("not done").withColumn("turn", F.row_number().over(W.partitionBy("id").orderBy("place"))).filter(F.col("turn") <= expand)
        ahead = scratch.cut(ahead.select("id", F.col("other").alias("via")))
        if not ahead.limit(1).collect():
            break
        reached = ahead.join(edges, "via").select("id", "other").distinct().join(seen.select("id", "other"), ["id", "other"], "left_anti")
        marked = seen.join(ahead.select("id", F.col("via").alias("other"), F.lit(True).alias("now")), ["id", "other"], "left").select("id", "other", "cosine", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        seen = scratch.cut(marked.unionByName(scored(reached).withColumn("done", F.lit(False))))
    return seen.drop("done")
