"""Cosine search by blocks of matrices against the plain join, on hard rows."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import nearest, retrieval
from skein.plans import catalog


@pytest.fixture(scope="module")
def hard(spark):
    rng = random.Random(5)
    plain = [[rng.choice([-1.0, 0.5, 0.25, 3.0]) * rng.random() for _ in range(4)] for _ in range(40)]
    rows = [(i, i % 3, rng.choice(plain)) for i in range(900)]  # many copies
    rows += [(900 + i, 1, [3 * x for x in rng.choice(plain)]) for i in range(60)]
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 2.0], [1.0, 2.0], [math.nan, 1.0, 0.0, 0.0], [math.inf, 1.0, 0.0, 0.0], [1e-200, 0.0, 1e-200, 0.0], [1e200, 1e200, 0.0, 0.0], [0.2, math.sqrt(1 - 0.04), 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    rows += [(i, None if i % 4 else 2, v) for i, v in zip([*range(1000, 1000 + 50 * len(odd), 50), *range(2001, 2001 + len(odd))], odd * 2)]
    rows += [(50, 2, plain[0]), (951, 0, plain[1]), (None, 1, plain[2])]
    return spark.createDataFrame(rows, "vec_id long, label int, v array<double>").repartition(3).cache()


def _plain(hard):
    rows = hard.where("vec_id is not null").withColumn("norm", vectors.norm(F.col("v")))
    return retrieval.score_all(rows.where("vec_id % 50 = 0"), rows)


def _told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("k", [1, 2, 7])
@pytest.mark.parametrize("wave", [nearest.WAVE_BYTES, 600])
def test_first_of_each_query(hard, k, wave, monkeypatch):
    monkeypatch.setattr(nearest, "WAVE_BYTES", wave)
    monkeypatch.setattr(nearest, "_POINTS", 64)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda scored: scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = nearest.first(hard.where("vec_id % 50 = 0"), hard, k)
    assert _told(top(found.withColumn("score", F.round(F.element_at("cosines", 1), 9)))) == _told(top(_plain(hard)))
    # Copies don't pile up: there are up to k of each score in each partition.
    assert found.count() <= 4 * k * found.select("query_id").distinct().count() * hard.rdd.getNumPartitions()


@pytest.mark.parametrize("least", [0.2, 0.999999999, -0.5])
def test_counts_over_a_score(hard, least):
    want = _plain(hard).where(F.col("score") >= least).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    assert _told(nearest.over(hard.where("vec_id % 50 = 0"), hard, least)) == _told(want)


def test_relevant_rows_are_counted_without_pairs(hard):
    want = _plain(hard).groupBy("query_id").agg(F.count_if(F.col("label") == F.col("query_label")).alias("n_relevant"))
    assert _told(retrieval.relevant(hard.where("vec_id % 50 = 0"), hard)) == _told(want)


@pytest.fixture(scope="module")
def clones(tmp_path_factory):
    """Embeddings with copies, in one folder with ids that repeat."""
    rng = random.Random(3)
    plain = [[rng.gauss(0, 1) for _ in range(48)] for _ in range(30)]
    ids = [*range(400), 7, 50, 50, 100]
    values = [rng.choice(plain) if i % 3 else plain[0] for i in range(len(ids))]
    whole = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array([i % 4 for i in ids], pa.int32())})
    folder = tmp_path_factory.mktemp("clones")
    for name, rows in (("repeats", whole), ("once", whole.slice(0, 400))):
        (folder / name).mkdir()
        pq.write_table(rows, folder / name / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["resolve_requests", "rrf_catalog", "top2_margin", "rrf_memory", "cosine_topk", "retrieval_metrics", "cosine_min_score"])
def test_no_pairs_are_joined(name, spark, clones, same_rows):
    import duckdb

    folder = clones / ("repeats" if name in ("resolve_requests", "cosine_topk", "top2_margin", "cosine_min_score") else "once")
    found = catalog.QUERIES[name](spark, str(folder))
    same_rows(found.toPandas(), duckdb.sql(catalog.SQL[name].replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'")).df())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "vec_id#" not in "".join(x for x in plan.splitlines() if "Join" in x) or name == "resolve_requests"
    if name == "resolve_requests":
        assert catalog.QUERIES[name](spark, str(clones / "once"))._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
