"""Look-back duplicates, coverage, weighted scores, nested windows and speech against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.functions import speech
from skein.operators import coverage, intervals, lookback, trees
from skein.plans import catalog, signals


def marked_by_brute_force(rows, share=0.8, most=30):
    """rows: (key, id, side, a, b)."""
    kept, out = defaultdict(list), {}
    for key, id, side, a, b in sorted(rows, key=lambda r: (str(r[0]), r[3] or 0, r[1])):
        match = None
        if a is not None and b is not None:
            for other, other_side, c, d in reversed(kept[key][-most:]):
                shorter = min(b - a, d - c)
                if other_side != side and shorter > 0 and min(b, d) - max(a, c) >= share * shorter:
                    match = other
                    break
            if match is None:
                kept[key].append((id, side, a, b))
        out[id] = match
    return out


def test_overlaps_of_a_hot_room(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.choice([True, False, None]), rng.randrange(40_000), 0) for i in range(1500)]
    rows = [(k, i, s, a, a + rng.choice([0, 5, 40, 300, 3000])) for k, i, s, a, _ in rows] + [("hot", 9000, True, None, 5), ("cold", 9001, True, 5, None)]
    df = spark.createDataFrame(rows, "island string, _slot long, side boolean, a long, b long").repartition(5)
    for most in (30, 3):
        got = {r.id: r.duplicate_of for r in lookback.mark_overlaps(df, "island", "_slot", "side", "a", "b", 1000, 0.8, most).collect()}
        want = marked_by_brute_force(rows, 0.8, most)
        assert got == want and sum(v is not None for v in want.values()) > 100
    assert lookback.mark_overlaps(df.limit(0), "island", "_slot", "side", "a", "b", 1000).isEmpty()


def test_overlap_duplicates_query(spark, sf_dir):
    rows = [(r.u % 10, r.event_id, r.event_type in ("view", "click"), r.a, r.a + round(r.value * 120e6)) for r in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id AS u", "event_type", "unix_micros(cast(ts AS timestamp)) AS a", "value").collect()]
    got = {r.event_id: r.duplicate_of for r in catalog.QUERIES["overlap_duplicates"](spark, sf_dir).collect()}
    assert got == marked_by_brute_force(rows) and any(v is not None for v in got.values())


def ranked_by_brute_force(rows, quotas, target, scarce):
    taken, left, out = dict.fromkeys(quotas, 0), {i: {t for t in tags or [] if t in quotas} for i, tags in rows}, []
    while left and len(out) < target:
        lack = lambda i: sum(max(0, quotas[t] - taken[t]) for t in left[i])
        best = max(left, key=lambda i: (not (scarce in left[i] and taken[scarce] >= quotas[scarce]), lack(i), -sum(taken[t] for t in left[i]), i))
        out.append((len(out) + 1, best, lack(best)))
        for t in left.pop(best):
            taken[t] += 1
    return out


def test_coverage_is_plain_greedy(spark):
    rng = random.Random(6)
    quotas = {"a": 5, "b": 9, "c": 2, "d": 30, "rare": 3}
    rows = [(i, [t for t in [*"abcdx", "rare"] if rng.random() < 0.3] if i % 17 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc long, tags array<string>").repartition(4)
    for target in (0, 60, 1000):
        got = [tuple(r) for r in coverage.rank_by_coverage(df, "doc", "tags", quotas, target, "rare").orderBy("rank").collect()]
        assert got == ranked_by_brute_force(rows, quotas, target, "rare")


def test_coverage_ranking_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", signals.tags_of_documents().alias("t")).collect()
    got = [(r.rank, r.doc_id, r.gain) for r in catalog.QUERIES["coverage_ranking"](spark, sf_dir).orderBy("rank").collect()]
    assert got == ranked_by_brute_force([(r.doc_id, r.t) for r in docs], signals.QUOTAS, 120, "mail")


def test_weighted_scores_without_bounds_and_without_overlap(spark):
    scores = "array<struct<name: string, score: double>>"
    windows = spark.createDataFrame([("k", 0, 10, [("x", 1.0), ("y", 0.5)]), ("k", 10, 30, [("x", 0.0)]), ("loose", None, 5, [("z", 0.4)]), ("loose", 100, 110, [("z", 1.0)]), ("far", 50, 60, [("q", 0.3), ("q", 0.9)]), ("far", 40, None, [])], f"k string, wa long, wb long, scores {scores}")
    targets = spark.createDataFrame([(1, "k", 5, 15), (2, "loose", 0, 3), (3, "far", 0, 9), (4, "none", 0, 9), (5, "k", 500, 600)], "id long, k string, a long, b long")
    got = sorted(tuple(r) for r in intervals.weighted_scores(targets, windows, "k", "id", 7).collect())
    assert got == [(1, "x", 0.5, 1), (1, "y", 0.25, 2), (2, "z", 0.4, 1), (5, "x", 1.0, 1), (5, "y", 0.5, 2)]
    first = windows.where("k = 'far' and wb is not null")
    assert [tuple(r) for r in intervals.weighted_scores(targets.where("id = 3"), first, "k", "id", 7).collect()] == [(3, "q", 0.9, 1)]


def test_walk_reaches_any_depth(spark):
    deep = '{"a": ' * 30 + '{"emotions": [{"name": "x", "score": 2}]}' + "}" * 30
    df = spark.createDataFrame([(1, deep), (2, None), (3, "7"), (4, '[[], {}, [{"b": 1}]]')], "id long, j string").select("id", F.parse_json("j").alias("v"))
    nodes = trees.walk(df, "id", "v")
    assert sorted((r.id, r.depth, r.path) for r in nodes.where("id <> 1").collect()) == [(4, 1, "1"), (4, 2, "2.0")]
    assert nodes.where("id = 1").count() == 32
    found = trees.score_windows(nodes, "id").collect()
    assert [(r.id, r.path, r.name, r.score, r.begin) for r in found] == [(1, ".".join("a" * 30), "x", 1.0, None)]
    assert trees.walk(df.limit(0), "id", "v").isEmpty()


def test_nodes_of_repeated_ids_are_ranked_on_their_own(spark, monkeypatch):
    """A walk is one pass where the row is: nothing is written, and rows that share an id share no places."""
    one = '{"emotions": [{"name": "x", "score": %s}, {"label": "y"}, 7, {"score": 1}]}'
    rows = [(1, one % "0.5"), (1, one % "3"), (2, '[{"prosody": {"scores": {" z ": 0.25, "": 1, "n": null}}, "begin": 4}]')]
    df = spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("v"))
    monkeypatch.setattr("skein.sources.scratch.shared_folder", None)
    found = trees.score_windows(trees.walk(df, "id", "v"), "id")
    got = sorted((r.id, r.path, r.begin, r.kind, r.name, r.score, r.place) for r in found.collect())
    assert got == sorted([(1, "", None, "emotions", "x", 0.5, 1), (1, "", None, "emotions", "y", 0.0, 2), (1, "", None, "emotions", "x", 1.0, 1), (1, "", None, "emotions", "y", 0.0, 2), (2, "0", 4.0, "scores", "z", 0.25, 1)])
    assert len(trees.score_windows(trees.walk(df, "id", "v"), "id", 1).collect()) == 3
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def segments_by_brute_force(x, rate):
    size = max(1, round(rate * 0.03))
    frames = [x[i : i + size] for i in range(0, len(x), size)]
    energy = [math.sqrt(sum(v * v for v in f) / len(f)) for f in frames]
    if not energy:
        return []
    limit = max(sorted(energy)[max(0, int(len(energy) * 0.2) - 1)] * 2.5, max(energy) * 0.08, 100.0)
    runs = []
    for i, e in enumerate(energy):
        if e >= limit:
            if runs and i - runs[-1][1] <= max(1, round(0.55 / 0.03)):
                runs[-1][1] = i
            else:
                runs.append([i, i])
    out = []
    for a, b in runs:
        start, end = max(0.0, a * 0.03 - 0.15), min(len(x) / rate, (b + 1) * 0.03 + 0.15)
        while end - start > 25.0:
            out.append((start, start + 25.0))
            start += 25.0
        if end - start >= 0.45:
            out.append((start, end))
    return out


def test_segments_are_a_plain_loops():
    import numpy as np

    rng = np.random.default_rng(3)
    for rate in (1000, 8000, 16000):
        for _ in range(12):
            parts = [rng.normal(size=int(rate * s)) * loud for s, loud in zip(rng.exponential(0.6, 30), rng.choice([5, 5, 3000, 9000], 30))]
            x = np.concatenate(parts) if rng.random() < 0.9 else np.full(int(rate * 60), 5000.0)
            got, want = speech.segments(x, rate), segments_by_brute_force(x.tolist(), rate)
            assert np.allclose(got, want) and len(got) == len(want)
    assert speech.segments(np.zeros(0), 8000) == [] and speech.segments(np.zeros(8000), 8000) == []


def test_speech_segments_query(spark, sf_dir):
    got = defaultdict(list)
    for r in catalog.QUERIES["speech_segments"](spark, sf_dir).collect():
        got[r.doc_id].append((r.part, r.start_s, r.end_s))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    for r in docs:
        quiet = re.sub("[^b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]", " ", (r.text or "").replace("\n", " " * 25))
        x = [30840 if c != " " else 0 for c in quiet for _ in range(30)]
        want = [(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(segments_by_brute_force(x, 1000))]
        assert sorted(got[r.doc_id]) == [pytest.approx(w) for w in want]
    assert sum(map(len, got.values())) > len(got)


def test_recordings_of_texts():
    """A frame of 30 samples for each character that isn't a line end, whatever its size in bytes."""
    made = signals.recording_of("aB\n\U0001f600\u00e9x")
    assert made[:4] == b"RIFF" and len(made) == 44 + 60 * (2 + 25 + 3)
    x, rate = speech.samples_of(made)
    assert rate == 1000 and [bool(v) for v in x[::30]] == [False, True, *[False] * 27, True] and (x[-30:] == 30840 / 32768).all()
    assert signals.recording_of("")[40:] == bytes(4)
