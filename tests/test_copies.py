"""Copies in near-duplicate search, against brute force row by row."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import dedup


def greedy_by_brute_force(rows, threshold):
    """rows: (id, text). The order of ids; the most similar kept one, ties by id; equal texts count as similar."""
    kept, out = [], {}
    for i, t in sorted(rows):
        w = t.split()
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        best = []
        for k, kt, ks in kept:
            score = 1.0 if kt == t else len(own & ks) / len(own | ks) if own and ks else 0.0
            if score >= threshold:
                best.append((-score, k))
        out[i] = min(best)[1] if best else None
        if not best:
            kept.append((i, t, own))
    return out


def test_greedy_resolves_every_copy(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "z"])
    nearer = " ".join([*base[:-1], "z", "y"])
    far = " ".join([*base[:-3], "q", "z", "y"])
    cycle, turned = "a b c d e a b c d e", "b c d e a b c d e a"  # the same shingles
    texts = [" ".join(base), near, far, nearer, " ".join(base), near, far, nearer, "two words", "two words", "", "", "other", cycle, turned, cycle, near, far]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3).select("id", "text", text.shingles(F.col("text")).alias("tokens"))
    got = dedup.greedy_keepers(docs.select("id"), dedup.similar_pairs(docs, 0.88), dedup.representatives(docs)).collect()
    want = greedy_by_brute_force(rows, 0.88)
    assert len(got) == len(rows) and {r.id: r.duplicate_of for r in got} == want
    assert sum(x is not None for x in want.values()) >= 10


def test_short_texts_of_one_token_set_and_copies(spark):
    texts = ["turn the radio down", "turn the the radio down", "turn the radio down", "radio the turn down", "sing", "sing", "turn the radio", "", "", "the radio turn", "turn the radio"]
    rows = list(enumerate(texts))
    got = dedup.similar_short_texts(spark.createDataFrame(rows, "id long, text string"), 0.6, 0.82).collect()
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    want = {(first[t], i): 1.0 for i, t in rows if t and first[t] != i}
    for a in first:
        for b in first:
            x, y = set(a.split()), set(b.split())
            if first[a] < first[b] and x and y and len(x & y) >= 0.6 * len(x | y) and (r := SequenceMatcher(None, a, b, autojunk=False).ratio()) >= 0.82:
                want[first[a], first[b]] = r
    assert {(r.a, r.b): r.ratio for r in got} == want and len(got) == len(want)
    assert (0, 1) in want and (0, 2) in want
