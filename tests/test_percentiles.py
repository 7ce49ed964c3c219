"""Exact order statistics against sorted lists, brackets and small groups alike."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from skein.operators import dedup, percentiles


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_percentiles_are_those_of_sorted_lists(spark, monkeypatch, accuracy):
    monkeypatch.setattr(percentiles, "ACCURACY", accuracy)
    rng = random.Random(8)
    rows = [("hot", rng.choice([1e9, *([rng.gauss(0, 1)] * 30), 3.0, 3.0])) for _ in range(4000)] + [("one", 5.0), (None, 1.0), (None, 2.0), ("null", None), ("hot", None)] + [("ties", 7.0)] * 300
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    own = defaultdict(list)
    for k, v in rows:
        if v is not None:
            own[k].append(v)
    own = {k: sorted(v) for k, v in own.items()}
    shares = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r.k: r for r in percentiles.linear(df, "k", "v", shares).collect()}
    near = {r.k: r for r in percentiles.nearest(df, "k", "v", shares).collect()}
    even = {r.k: r for r in percentiles.rounded(df, "k", "v", shares).collect()}
    assert got.keys() == near.keys() == even.keys() == own.keys()
    for k, v in own.items():
        for name, q in shares.items():
            at = (len(v) - 1) * q
            assert got[k][name] == pytest.approx(v[math.floor(at)] + (at - math.floor(at)) * (v[math.ceil(at)] - v[math.floor(at)]))
            assert near[k][name] == v[max(1, math.ceil(len(v) * q - 1e-9)) - 1] and even[k][name] == v[round(at)]
        assert got[k].n == len(v)
    assert percentiles.linear(df.limit(0), "k", "v", shares).isEmpty()


def test_shared_runs_dealt_or_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e a b c"), (2, "x a b c d"), (3, "a b"), (4, None), (1, "d e f")], "doc long, text string")
    items = spark.createDataFrame([(7, "b c d  a b c"), (8, "a b c"), (9, "")], "item long, text string")
    want = {(1, 7): 2, (2, 7): 2, (1, 8): 1, (2, 8): 1}
    for most in (100, 0):
        monkeypatch.setattr(dedup, "MOST_RUNS", most)
        assert {(r.doc, r.item): r.n_shared for r in dedup.shared_runs(docs, "doc", items, "item", "text", 3).collect()} == want
