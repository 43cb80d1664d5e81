"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

from collections import defaultdict

import regex


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingles(text, n):
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def near_pairs(texts: dict, n: int, least: float, bags: bool = False):
    from collections import Counter

    sets = {k: Counter(shingles(t, n)) if bags else Counter(set(shingles(t, n))) for k, t in texts.items()}
    keys = sorted(k for k, s in sets.items() if s)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = sum((sets[a] & sets[b]).values())
            if both >= least * sum((sets[a] | sets[b]).values()):
                out.add((a, b))
    return out


def repeated_lines(articles, least=3, percent=5):
    """articles: (source, id, text)"""
    sizes, where, lines = defaultdict(set), defaultdict(set), []
    for source, id, text in articles:
        sizes[source].add(id)
        for i, line in enumerate((text or "").split("\n")):
            key = regex.sub(r"\P{L}+", "", line.lower())
            if len(key) >= 3:
                where[source, key].add(id)
                lines.append((source, key, id, i))
    return {(id, i) for s, k, id, i in lines if len(where[s, k]) >= least and 100 * len(where[s, k]) >= percent * len(sizes[s])}


def shared(texts: dict, least: int = 200):
    """Pairs of documents and characters of each that stand in a shared span."""
    windows = defaultdict(set)
    for k, t in texts.items():
        for p in range(len(t or "") - least + 1):
            windows[t[p : p + least]].add(k)
    pairs = {(a, b) for s in windows.values() for a in s for b in s if a < b}
    cover = {}
    for k, t in texts.items():
        got = set()
        for p in range(len(t or "") - least + 1):
            if len(windows[t[p : p + least]]) > 1:
                got.update(range(p, p + least))
        cover[k] = len(got)
    return pairs, cover
