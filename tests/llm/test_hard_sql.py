"""The queries and the pipeline on hard rows: against the same SQL as on clean tables."""

from __future__ import annotations

import os

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import queries
from tests.llm.conftest import SCHEMA


@pytest.fixture(scope="module")
def folder(spark, hard_rows, sf_dir, tmp_path_factory):
    """Tables of hard rows. The SQL compares ids, so rows without one stay out; the brute-force tests have those."""
    base = tmp_path_factory.mktemp("hard")
    rows = [r for r in hard_rows if r[0] is not None and len(r[1] or "") < 5000]  # the SQL is slow on very long texts
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(base / "documents.parquet"))
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(200)]
    vectors += [(1000, None), (1001, [float("nan")] * 6), (1050, [0.5, None, 0.5, 0.5, 0.5, 0.5]), (1051, [float("inf")] * 6), (1100, vectors[0][1])]
    spark.createDataFrame([(*v, "x", 3) for v in vectors], "vec_id long, embedding array<float>, rank string, score int").write.parquet(str(base / "embeddings.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(1, 14)] + [(2, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    turns = [(1, 0, "user", "Hello there everybody\nsecond line"), (1, 1, "assistant", "> Hello there everybody\n>> older\nfresh"), (1, 2, "user", None), (2, 0, "user", ""), (2, 1, "user", "> \n>" + " x" * 500), (3, 0, "system", "> Hello there everybody")]
    spark.createDataFrame([(*t, "n") for t in turns], "conv_id long, turn long, role string, text string, level string").write.parquet(str(base / "conversations.parquet"))
    return str(base)


@pytest.fixture(scope="module")
def duck_hard(folder):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}/*.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql_on_hard_rows(name, spark, folder, duck_hard, same_rows):
    same_rows(queries.QUERIES[name](spark, folder).toPandas(), duck_hard.sql(queries.SQL[name]).df())


def test_pipeline_on_hard_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id").distinct()
        docs = stage(spark, docs, folder)
        assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").isEmpty()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    packed = docs.collect()
    assert all(r.length == len(r.ids) and r.offset == 0 and r.length & (r.length - 1) == 0 for r in packed)
    whole = {}
    for r in packed:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert {sum(n for _, n in parts) % n_tokens for (_, n_tokens), parts in whole.items()} <= {0}


def test_pipeline_on_no_rows(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
