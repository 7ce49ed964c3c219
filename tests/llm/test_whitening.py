"""Whitening against numpy on whole tables, and edge cases."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import whitening


def by_brute_force(rows, components=16):
    """rows: (id, vector) of one length. {component: (explained, projection of a row up to sign)}, n, sums."""
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    fit = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in distinct])
    cov = fit.T @ fit / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return kept, n, sums, e, u, np.trace(cov)


def check(out, rows):
    kept, n, sums, e, u, trace = by_brute_force(rows)
    got = defaultdict(list)
    for r in out:
        got[r.vec_id].append(r)
    assert sum(map(len, got.values())) == len(kept) * len(e)
    signs = {}
    for i, x in kept:
        for r in sorted(got[i], key=lambda r: r.component):
            k = r.component - 1
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r.explained == pytest.approx(e[k] / trace, rel=1e-6) and r.identity_error <= 1e-6
            want = float(np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ u[:, k] / np.sqrt(e[k]))
            if abs(want) > 1e-6:
                sign = signs.setdefault(k, np.sign(want * r.whitened))
                assert r.whitened * sign == pytest.approx(want, rel=1e-5, abs=1e-7)


def test_query_is_numpys(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(whitening.query(spark, sf_dir).collect(), rows)


def test_nulls_copies_and_ids(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 5)) * [9, 4, 2, 1, 0.5] + 3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(5000 + i, rows[0][1]) for i in range(2000)]
    bad = [(9000, None), (9001, [1.0, None, 2.0, 3.0, 4.0]), (9002, [float("nan")] * 5), (9003, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (9004, [])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, index long, at int").repartition(7)
    check(whitening.whiten(df).collect(), rows)
    twice = spark.createDataFrame([(None, v) for _, v in rows[:50]] + [(7, v) for _, v in rows[:50]], "vec_id long, embedding array<double>")
    out = whitening.whiten(twice).collect()
    assert len(out) == 500 and {r.n for r in out} == {len({tuple(math.floor(64 * c) for c in v) for _, v in rows[:50]})}


def test_no_variance_no_rows_and_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).isEmpty()
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).isEmpty()
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(out)] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)} and all(r.identity_error < 1e-9 for r in line)
    both = whitening.whiten(spark.createDataFrame([(i, [float(i)] * (1 + i % 2)) for i in range(8)], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in both) == sorted((i, k, 4) for i in range(8) for k in range(1, 2 + i % 2))


def test_beyond_longs(spark):
    rows = [(i, [float(2**40 * (i % 7)), float(i)]) for i in range(300)] + [(999, [1e300, -1e300])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = {i: [max(-(2**52), min(2**52, math.floor(64 * c) if abs(c) < 1e30 else (2**53 if c > 0 else -(2**53)))) + 1000000 for c in v] for i, v in rows}
    distinct = {tuple(v) for v in x.values()}
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    for r in out:
        assert r.n == n and r.deviation == min(2**63 - 1, sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)))
