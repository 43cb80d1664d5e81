"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; every piece is merged by a segment tree over the ranks of its
adjacent pairs. The root of the tree yields the leftmost pair of lowest rank; a merge changes three leaves, so a
piece of n bytes takes O(n log n) however long it is. Frequent pieces are remembered per worker, up to a fixed
number; that changes the time, not the result.

Defined cases: a null text and an empty text give an empty list (count 0); blanks are encoded like any text; the
strings of special tokens are ordinary text; every row gives exactly one row, repeated rows included.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .arrow import list_array, map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte_bpe rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED_PIECES, REMEMBERED_LENGTH = 1 << 18, 64
NO_PAIR = 1 << 62


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: merge the leftmost pair of lowest rank until no adjacent pair has a rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    leaves = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * leaves)

    def key(i: int) -> int:  # rank first, then place: the smallest key is the leftmost pair of lowest rank
        j = after[i]
        if j >= n:
            return NO_PAIR
        rank = ranks.get(parts[i] + parts[j])
        return NO_PAIR if rank is None else rank * n + i

    def put(i: int, value: int) -> None:
        at = leaves + i
        tree[at] = value
        at >>= 1
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            low = left if left < right else right
            if tree[at] == low:
                break
            tree[at] = low
            at >>= 1

    for i in range(n - 1):
        tree[leaves + i] = key(i)
    for at in range(leaves - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right
    while tree[1] < NO_PAIR:
        i = tree[1] % n
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, NO_PAIR)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    return [ranks[p] for p in parts if p is not None]


class Encoder(dict):
    """Pieces to ids; a missing piece is encoded when it is first asked for."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> list[int]:
        ids = merge_piece(piece.encode(), self.ranks)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.split(text)))) if text else 0


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def shipped(spark: SparkSession, vocabulary: str) -> None:
    """Send the vocabulary's file from the driver to the executors, once for each application."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _SHIPPED:
        spark.sparkContext.addFile(vocabulary)
        _SHIPPED.add(key)


_SHIPPED: set[tuple[str, str]] = set()


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """`df` with the list column `out` in place of `text`. A clashing column named `out` is replaced."""
    return _tokens(df, text, out, T.ArrayType(T.IntegerType(), False), vocabulary)


def count(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """`df` with the number of tokens as the long column `out` in place of `text`."""
    return _tokens(df, text, out, T.LongType(), vocabulary)


def _tokens(df: DataFrame, text: str, out: str, kind: T.DataType, vocabulary: str) -> DataFrame:
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, kind, False)])
    listed = isinstance(kind, T.ArrayType)
    shipped(df.sparkSession, vocabulary)
    name = os.path.basename(vocabulary)

    def make(part: pa.RecordBatch) -> dict:
        enc = encoder(SparkFiles.get(name))
        texts = part.column(part.schema.get_field_index(text)).to_pylist()
        cols = {c: part.column(part.schema.get_field_index(c)) for c in kept}
        if listed:
            rows = [enc.encode(t) for t in texts]
            lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            ids = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(lengths.sum()))
            return cols | {out: list_array(ids, lengths, pa.int32())}
        return cols | {out: [enc.count(t) for t in texts]}

    return map_arrow(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")), schema, text, make)
