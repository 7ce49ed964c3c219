"""Vector retrieval: exact cosine, fused rankings, and how good they are.

A point's named spaces are slices of its vector. The queries are the vectors whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import nearest, retrieval
from skein.plans.registry import query, table

_COS = "coalesce(list_inner_product(q.v, c.v) / nullif(sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v)), 0), 0.0)"
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_SCORED = f"s AS (SELECT q.vec_id AS query_id, q.label AS ql, c.vec_id, c.label, round({_COS}, 9) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)"
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", spread=True).select("vec_id", "label", F.col("embedding").alias("v"))


def _asked(points):
    return points.where("vec_id % 50 = 0")


def _top(points, k):
    """The queries' first k by cosine with every other vector."""
    scored = nearest.first(_asked(points), points, k).withColumn("score", F.round(F.element_at("cosines", 1), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query(f"WITH {_V}, {_SCORED}, {_RANKED} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    return _top(_points(spark, sf_dir), 5).select("query_id", F.col("rank").cast("long"), "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_V}, {_SCORED} SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM s WHERE score >= 0.2 GROUP BY query_id")
def cosine_min_score(spark, sf_dir):
    points = _points(spark, sf_dir)
    return nearest.over(_asked(points), points, 0.2).select("query_id", "n", F.round("best", 6).alias("best"))


@query(f"WITH {_V}, {_SCORED}, {_RANKED} SELECT query_id, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS margin FROM r GROUP BY query_id")
def top2_margin(spark, sf_dir):
    first = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    return _top(_points(spark, sf_dir), 2).groupBy("query_id").agg(F.round(first(1) - first(2), 6).alias("margin"))


_SPACES = (("semantic", 1, 0.5), ("topic", 17, 0.3), ("intent", 33, 0.2))
_SPACE_ROWS = ", ".join(f"{{'space': '{s}', 'v': list_transform(embedding[{a}:{a + 15}], lambda x: CAST(x AS DOUBLE)), 'w': {w}}}" for s, a, w in _SPACES)
_FUSED = f"""
p AS (SELECT vec_id, unnest([{_SPACE_ROWS}]) AS x FROM embeddings),
sp AS (SELECT vec_id, x.space AS space, x.v AS v, CAST(x.w AS DOUBLE) AS w FROM p),
sc AS (SELECT q.vec_id AS query_id, q.space, q.w, c.vec_id, round({_COS}, 9) AS score FROM sp q JOIN sp c ON q.space = c.space AND q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, space ORDER BY score DESC, vec_id) AS rank FROM sc),
f AS (SELECT query_id, vec_id, round(least(1.0, sum(w / (60 + rank)) / (1.0 / 61)), 9) AS fusion, count(*) AS n_spaces, round(sum(w * score), 9) AS similarity FROM rk WHERE rank <= CUT AND score >= LEAST_SCORE GROUP BY 1, 2)"""


def _fused_sql(cut, least):
    return _FUSED.replace("CUT", str(cut)).replace("LEAST_SCORE", str(least))


def _fused(spark, sf_dir, cut, least):
    rows = table(spark, sf_dir, "embeddings", spread=True)
    points = rows.select("vec_id", "label", *[F.slice("embedding", a, 16).alias(s) for s, a, _ in _SPACES])
    return retrieval.fuse(_asked(points), points, {s: w for s, _, w in _SPACES}, cut, least)


@query(f"WITH {_fused_sql(15, 0.0)}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, n_spaces DESC, similarity DESC, vec_id) AS rank FROM f) SELECT query_id, rank, vec_id, n_spaces, round(fusion, 6) AS fusion FROM o WHERE rank <= 5")
def rrf_memory(spark, sf_dir):
    """Reciprocal rank fusion over named spaces: three sort keys, then the id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("fusion"), F.desc("n_spaces"), F.desc("similarity"), "vec_id")
    top = _fused(spark, sf_dir, 15, 0.0).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return top.select("query_id", F.col("rank").cast("long"), "vec_id", "n_spaces", F.round("fusion", 6).alias("fusion"))


@query(f"WITH {_fused_sql(20, -1.0)}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, vec_id) AS rank FROM f WHERE fusion >= 0.2) SELECT query_id, rank, vec_id, round(fusion, 6) AS fusion FROM o WHERE rank <= 5")
def rrf_catalog(spark, sf_dir):
    """The catalog's fusion: every space counts, a threshold after normalising, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("fusion"), "vec_id")
    top = _fused(spark, sf_dir, 20, -1.0).where("fusion >= 0.2").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return top.select("query_id", F.col("rank").cast("long"), "vec_id", F.round("fusion", 6).alias("fusion"))


_BASE = (("semantic", 0.40, " the "), ("topic", 0.20, "of"), ("intent", 0.15, "?"), ("decision", 0.15, "to "), ("person", 0.10, "he "))
_W = ", ".join(f"{w} * CASE WHEN contains(lower(text), '{m}') THEN 2 ELSE 1 END AS w{i}" for i, (_, w, m) in enumerate(_BASE))


@query(f"WITH w AS (SELECT conv_id, turn, {_W} FROM conversations WHERE role = 'user') SELECT conv_id, turn, {', '.join(f'round(CAST(w{i} / (w0 + w1 + w2 + w3 + w4) AS DOUBLE), 6) AS {s}' for i, (s, _, _) in enumerate(_BASE))} FROM w")
def adaptive_weights(spark, sf_dir):
    """A space whose marker the query has counts twice; then the weights are made to sum to one."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    raw = {s: F.lit(w) * F.when(F.contains(F.lower("text"), F.lit(m)), 2).otherwise(1) for s, w, m in _BASE}
    total = sum(raw.values(), F.lit(0.0))
    return rows.select("conv_id", "turn", *[F.round(x / total, 6).alias(s) for s, x in raw.items()])


@query(f"""
WITH {_V}, {_SCORED}, {_RANKED},
q AS (SELECT query_id, max(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END) AS hit, coalesce(1.0 / min(CASE WHEN label = ql THEN rank END), 0.0) AS rr,
  sum(CASE WHEN label = ql THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r WHERE rank <= 10 GROUP BY query_id),
i AS (SELECT query_id, (SELECT sum(1 / log2(k + 1)) FROM range(1, CAST(1 + least(10, n) AS BIGINT)) t(k)) AS ideal FROM (SELECT query_id, sum(CASE WHEN label = ql THEN 1 ELSE 0 END) AS n FROM s GROUP BY query_id))
SELECT count(*) AS n_queries, round(avg(hit)::DOUBLE, 6) AS recall_at_10, round(avg(rr), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0.0)), 6) AS ndcg_at_10 FROM q JOIN i USING (query_id)""")
def retrieval_metrics(spark, sf_dir):
    """Recall, reciprocal rank and binary nDCG at 10; relevant is what has the query's label."""
    points = _points(spark, sf_dir)
    top = _top(points, 10).withColumn("relevant", F.col("label") == F.col("query_label"))
    return retrieval.metrics(top, retrieval.relevant(_asked(points), points), 10)
