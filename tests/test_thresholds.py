"""Scores that lie on a threshold count alike in the query and in its SQL."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from skein.plans import catalog


def test_selective_risk_on_the_thresholds(spark, tmp_path, same_rows):
    on = [(i, n) for i in range(100) for n in range(1000) if ((n * 37 + i * 101) % 1000) * 4 + 60 * ((i * 7919) % 100) in (5000, 6000, 7000, 8000, 9000)]
    ids, n_chars = pa.array([i + 100_000 * at for at, (i, _) in enumerate(on)], pa.int64()), pa.array([n for _, n in on], pa.int64())
    text = pa.array(["x"] * len(on))
    pq.write_table(pa.table({"doc_id": ids, "text": text, "lang": text, "source": text, "n_chars": n_chars}), tmp_path / "documents.parquet")
    one = pa.array([1] * len(on), pa.int32())
    pq.write_table(pa.table({"doc_id": ids, "quality": one, "toxic": one}), tmp_path / "labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    same_rows(catalog.QUERIES["selective_risk"](spark, str(tmp_path)).toPandas(), con.sql(catalog.SQL["selective_risk"]).df())
