"""Features and regularised least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import WORD, fnv1a
from ..functions.vectors import let, unit
from .ranking import WEIGHTS, weighted_score

BASIS, PRIME = 2166136261, np.uint64(16777619)


def hashed_category(value: Column, dimensions: int) -> Column:
    """A signed one-hot array of the lower-cased value."""
    h = fnv1a(F.lower(value))
    sign = F.when(h.bitwiseAND(F.lit(0x80000000)) == 0, 1.0).otherwise(-1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.when(h % dimensions == i, sign).otherwise(0.0))


def article_features(projection: Column, scores: list[str]) -> Column:
    """Constant, scores, length, projection, hashed author and theme, as one array."""
    length = F.least(F.lit(1.5), F.log1p(F.col("word_count").cast("double")) / 10)
    head = F.array(F.lit(1.0), *[F.col(c) / 10 for c in scores], length)
    return F.concat(head, projection, hashed_category(F.col("author"), 6), hashed_category(F.col("primary_theme"), 6))


def gram(rows: DataFrame, features: str, label: str, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the number of rows: one small matrix per partition is summed, never a row collected."""
    cells = width * width + width + 1

    def partial(batches):
        total = np.zeros(cells)
        for frame in batches:
            x = np.array(frame["x"].tolist(), dtype=np.float64).reshape(-1, width)
            y = frame["y"].to_numpy(dtype=np.float64)
            total[: width * width] += (x.T @ x).ravel()
            total[width * width : -1] += x.T @ y
            total[-1] += len(y)
        yield pd.DataFrame({"cell": np.arange(cells), "v": total})

    sums = rows.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("double").alias("y")).mapInPandas(partial, "cell long, v double")
    got = np.zeros(cells)
    for r in sums.groupBy("cell").agg(F.sum("v").alias("v")).collect():  # width^2 numbers
        got[r["cell"]] = r["v"]
    return got[: width * width].reshape(width, width), got[width * width : -1], int(got[-1])


def ridge(xx: np.ndarray, xy: np.ndarray, penalty: float = 2.5) -> np.ndarray:
    """Weights of the regularised normal equations; the first column, the constant, carries no penalty."""
    eye = np.eye(len(xy)) * penalty
    eye[0, 0] = 0.0
    return np.linalg.lstsq(xx + eye, xy, rcond=1e-12)[0]


def influence(samples: int) -> float:
    """How much a model of so many samples may move a score."""
    return max([0.0, *(v for n, v in ((10, 0.05), (30, 0.1), (60, 0.15), (100, 0.2), (200, 0.3)) if samples >= n)])


def raw_fit(features: Column, weights: np.ndarray) -> Column:
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def personal_fit(features: Column, weights: np.ndarray, strength: float) -> Column:
    return F.tanh(raw_fit(features, weights)) * strength * 3


def weighted_mean(df: DataFrame, key: str, vec: str, weight: str) -> DataFrame:
    """key and `vec`: the mean of a key's vectors by weight, made a unit vector; sums by place combine before the shuffle."""
    flat = df.filter(F.col(vec).isNotNull()).select(key, F.col(weight).cast("double").alias("_w"), F.posexplode(vec).alias("_i", "_x"))
    means = flat.groupBy(key, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    listed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_l"))  # as many as places
    return listed.select(key, unit(F.transform("_l", lambda s: s["_m"])).alias("vec"))


# Base, and what may be added, of the scores by rule.
CONNECTIVES = r"(?i)\b(?:because|therefore|however|although|for example|the reason|but)\b"
TOPICAL = "(?i)today|this week|breaking"
OWN_VIEW = "(?i)I believe|I think|my view|the paradox|the problem"


def rule_analysis(df: DataFrame, text: str) -> DataFrame:
    """`df` (with title and word_count) with five scores by rule, their weighted sum and the name of the strongest."""
    length = F.least(F.lit(1.0), F.log10(F.greatest(F.coalesce("word_count", F.lit(0)), F.lit(100)).cast("double")) / 4)
    score = lambda base, extra: F.least(F.lit(9.2), F.floor((F.lit(base) + length + extra) * 10 + 0.5) / 10)
    signals = F.regexp_count(text, F.lit(CONNECTIVES)).cast("double")
    paragraphs = F.size(F.filter(F.split(text, "\n+"), lambda p: p != "")).cast("double")
    scored = df.withColumns({
        "long_term_value": score(6.8, F.when(F.coalesce("title", F.lit("")).rlike(TOPICAL), -0.4).otherwise(0.4)),
        "idea_density": score(6.9, F.least(F.lit(0.8), signals / 50)),
        "argument_quality": score(6.7, F.least(F.lit(0.9), signals / 40)),
        "originality": score(6.8, F.when(F.col(text).rlike(OWN_VIEW), 0.5).otherwise(0.2)),
        "clarity_structure": score(7.0, F.least(F.lit(0.7), paragraphs / 100)),
    })
    dims = F.array(*WEIGHTS)
    strongest = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.array_position(dims, F.array_max(dims)).cast("int"))
    return scored.withColumn("intrinsic_score", weighted_score()).withColumn("strongest", strongest)


class WordHashes:
    """FNV-1a of the words of a batch and of their pairs, all words of one length at a time."""

    def __init__(self, words: list[str]):
        self.of: dict[str, int] = {}
        for w in words:
            self.of.setdefault(w, len(self.of))
        units = [np.frombuffer(w.encode("utf-16-le"), dtype=np.uint16) for w in self.of]
        self.lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.units = np.concatenate(units).astype(np.uint64) if units else np.empty(0, dtype=np.uint64)

    def hashed(self, ids: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
        """The hashes of some words, going on from a state."""
        state = np.full(len(ids), BASIS, dtype=np.uint64) if state is None else state.copy()
        lengths, starts = self.lengths[ids], self.starts[ids]
        live, k = np.arange(len(ids)), 0
        while True:
            live = live[lengths[live] > k]
            if not len(live):
                return state
            state[live] = ((state[live] ^ self.units[starts[live] + k]) * PRIME) & np.uint64(WORD)
            k += 1

    def paired(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The hashes of the pairs `first_second`; each distinct pair is hashed once."""
        pairs, back = np.unique(first * len(self.of) + second, return_inverse=True)
        head = self.hashed(np.arange(len(self.of)))
        joined = ((head ^ np.uint64(ord("_"))) * PRIME) & np.uint64(WORD)
        return self.hashed(pairs % len(self.of), joined[pairs // len(self.of)])[back]


def feature_hash_embedding(df: DataFrame, id: str, title: str, text: str, dimensions: int) -> DataFrame:
    """id and the unit vector of hashed words (the title twice) and word pairs; all-zero where there are no words.

    Arrow batches: words are found text by text, hashed and summed for the whole batch at once.
    """
    import regex

    schema = T.StructType([df.schema[id], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches):
        word = regex.compile(r"[\p{L}\p{N}]{2,}")
        for frame in batches:
            found = [word.findall(f"{a or ''} {a or ''} {b or ''}".lower()) for a, b in zip(frame["_a"], frame["_b"])]
            words = [w for f in found for w in f]
            sums = np.zeros(len(found) * dimensions)
            if words:
                table = WordHashes(words)
                ids = np.fromiter(map(table.of.__getitem__, words), dtype=np.int64, count=len(words))
                doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
                inner = np.flatnonzero(doc[1:] == doc[:-1])
                for h, at, weight in ((table.hashed(np.arange(len(table.of)))[ids], doc, 1.0), (table.paired(ids[inner], ids[inner + 1]), doc[inner], 0.6)):
                    sign = np.where(h & np.uint64(0x80000000), -1.0, 1.0)
                    # Whole numbers are summed, so the order of words doesn't show.
                    sums += weight * np.bincount(at * dimensions + (h % np.uint64(dimensions)).astype(np.int64), sign, len(sums))
            grid = sums.reshape(len(found), dimensions)
            norms = np.linalg.norm(grid, axis=1, keepdims=True)
            yield pd.DataFrame({id: frame[id], "vec": list(grid / np.where(norms > 0, norms, 1.0))})

    return df.select(id, F.col(title).alias("_a"), F.col(text).alias("_b")).mapInPandas(run, schema)


def literals(pattern: str) -> tuple[list[str], list[str]]:
    """The alternatives of a pattern: plain substrings, and those that need a pattern."""
    parts = pattern.split("|")
    return [p for p in parts if p.isalnum()], [p for p in parts if not p.isalnum()]


def found_in(text: Column, pattern: str) -> Column:
    plain, rest = literals(pattern)
    tests = [F.contains(text, F.lit(p)) for p in plain] + [text.rlike(p) for p in rest]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def themes_of(title: Column, text: Column, themes: list[tuple[str, str]], default: str, first: int | None = None, more: int | None = None) -> Column:
    """A struct of the first theme whose (lower-case) pattern is found in title and text, and up to three further ones
    found in the text. `first` and `more` cut the text for either. Every pattern is sought once in a text lowered once."""
    head = F.lower(F.concat_ws(" ", title, text if first is None else F.substring(text, 1, first)))
    body = F.lower(F.coalesce(text if more is None else F.substring(text, 1, more), F.lit("")))
    names = F.array(*[F.lit(n) for n, _ in themes])
    hits = lambda x: F.array(*[found_in(x, p) for _, p in themes])
    pick = lambda found: F.filter(names, lambda n, i: F.get(found, i))
    return let(let(head, hits), lambda a: let(let(body, hits), lambda b: let(F.coalesce(F.get(pick(a), F.lit(0)), F.lit(default)), lambda p: F.struct(p.alias("primary"), F.slice(F.filter(pick(b), lambda n: n != p), 1, 3).alias("more")))))
