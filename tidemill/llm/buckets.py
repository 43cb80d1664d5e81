"""Pairs that share a bucket and agree on their signatures, whatever the size of the bucket.

Buckets of two and of a few are joined in the JVM. A crowded one is cut into blocks by hash, and each pair of blocks is
compared in one group of at most about 2 * BLOCK rows: no task sees a whole bucket, every pair is compared once, and only
the pairs that agree leave. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..tables import Scratch

FEW, BLOCK = 24, 256


def agreeing(registers: int) -> object:
    """The share of equal bytes of two signatures."""

    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, registers) for s in (a, b))
        return pd.Series((x == y).mean(axis=1))

    return F.pandas_udf(share, T.DoubleType())


def compared(registers: int, least: float, kind: str):
    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        ids, parts = frame["id"].to_numpy(), frame["part"].to_numpy()
        x = np.frombuffer(b"".join(frame["signature"]), dtype=np.uint8).reshape(-1, registers)
        left, right = np.flatnonzero(parts == i), np.flatnonzero(parts == j)
        out = []
        for start in range(0, len(left), 64):
            rows = left[start : start + 64]
            hit = (x[rows][:, None, :] == x[right][None, :, :]).mean(axis=2) >= least
            p, q = np.nonzero(hit)
            out.append(np.stack([rows[p], right[q]]))
        p, q = np.concatenate(out, axis=1) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
        a, b = ids[p], ids[q]
        kept = a < b if i == j else a != b
        a, b = a[kept], b[kept]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b)}) if len(a) else pd.DataFrame({"a": pd.Series([], dtype=kind), "b": pd.Series([], dtype=kind)})

    return compare


def pairs(banded: DataFrame, signatures: DataFrame, registers: int, least: float, scratch: Scratch, fits=None) -> DataFrame:
    """a < b, once each, of all ids that share a band and agree on a share `least` of their registers.

    `banded`: band, id; `signatures`: id, signature, and what `fits(a row's columns with suffix _a, _b)` needs.
    """
    shared = scratch.cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter("n > 1"))
    twos = shared.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    several = scratch.cut(banded.join(shared.filter("n > 2").select("band", "n"), "band"))
    few = several.filter(F.col("n") <= FEW)
    met = few.select("band", F.col("id").alias("a")).join(few.select("band", F.col("id").alias("b")), "band").filter("a < b").select("a", "b")
    sides = [signatures.select(*[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in signatures.columns]) for side in "ab"]
    small = twos.unionByName(met).distinct().join(sides[0], "a").join(sides[1], "b")
    if fits is not None:
        small = small.filter(fits())
    small = small.filter(agreeing(registers)("signature_a", "signature_b") >= least).select("a", "b")

    crowded = several.filter(F.col("n") > FEW).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    crowded = crowded.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(signatures.select("id", "signature"), "id")
    spread = crowded.select("band", "id", "signature", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = spread.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "signature", "part")
    kind = banded.schema["id"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    many = blocks.groupBy("band", "i", "j").applyInPandas(compared(registers, least, "int64" if isinstance(kind, T.LongType) else "object"), out)
    if fits is not None:
        many = many.distinct().join(sides[0].drop("signature_a"), "a").join(sides[1].drop("signature_b"), "b").filter(fits()).select("a", "b")
    return small.unionByName(many).distinct()
