"""Exact scoring of a stated query set against all points, rank fusion, and retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import nearest


#: Queries that are broadcast at once; more come to the points in blocks.
MOST_QUERIES = 2000
_PARTS = 256


def beside(points: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every point with every query of the same keys, a query's own point aside; queries have query_id, points vec_id.

    Up to MOST_QUERIES queries are counted and broadcast. More are dealt into blocks of that
    size, and the points into parts; every block meets every part in a task of its own.
    """
    many = queries.count()
    other = F.col("vec_id") != F.col("query_id")
    if many <= MOST_QUERIES:
        return (points.join(F.broadcast(queries), list(keys)) if keys else points.crossJoin(F.broadcast(queries))).where(other)
    blocks = -(-many // MOST_QUERIES)
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    p = points.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(_PARTS))).withColumn("_block", number(blocks))
    q = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("_part", number(_PARTS))
    return p.join(q, [*keys, "_block", "_part"]).drop("_block", "_part").where(other)


def score_all(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Cosine of each query with each other point; rows: vec_id, label, v, norm."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    return beside(points, q).select("query_id", "query_label", "vec_id", "label", F.round(vectors.cosine(F.col("qv"), F.col("v"), F.col("qn"), F.col("norm")), 9).alias("score"))


def fuse(queries: DataFrame, points: DataFrame, weights: dict[str, float], cut: int, least: float, k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion; rows: vec_id, label, and a vector for each space that has a weight.

    Only the first ``cut`` of each space and those over ``least`` count. Normalised by the best
    that is possible: rank one in all spaces, whose weights sum to one.
    """
    score = F.round(F.element_at("cosines", 1), 9)
    each = [nearest.first(queries, points, cut, [s]).select("query_id", F.lit(s).alias("space"), F.lit(w).alias("weight"), "vec_id", score.alias("score")) for s, w in weights.items()]
    w = Window.partitionBy("query_id", "space").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, each).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= cut) & (F.col("score") >= least))
    fusion = F.least(F.lit(1.0), F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))) / (1.0 / (k + 1)))
    return ranked.groupBy("query_id", "vec_id").agg(F.round(fusion, 9).alias("fusion"), F.count("*").alias("n_spaces"), F.round(F.sum(F.col("weight") * F.col("score")), 9).alias("similarity"))


def relevant(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, n_relevant): how many other points have the query's label; rows: vec_id, label. Labels are counted, pairs aren't made."""
    held = points.where("vec_id is not null and label is not null").groupBy("label").agg(F.count("*").alias("held"))
    own = queries.groupBy(F.col("vec_id").alias("query_id"), "label").agg(F.count("*").alias("own"))  # an id may repeat
    n = F.coalesce(F.col("own") * (F.col("held") - F.col("own")), F.lit(0))
    return own.join(held, "label", "left").groupBy("query_id").agg(F.sum(n).alias("n_relevant"))


def metrics(top: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """n_queries, recall_at_k, mrr, ndcg_at_k from ranked rows (query_id, rank, relevant) and (query_id, n_relevant)."""
    each = top.groupBy("query_id").agg(
        F.max(F.col("relevant").cast("double")).alias("hit"),
        F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(F.col("relevant"), F.col("rank")))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("n_relevant"), 1 / F.log2(i + 1)).otherwise(0.0))
    both = each.join(relevant, "query_id").withColumn("ndcg", F.coalesce(F.try_divide("dcg", ideal), F.lit(0.0)))
    return both.agg(F.count("*").alias("n_queries"), F.round(F.avg("hit"), 6).alias(f"recall_at_{k}"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias(f"ndcg_at_{k}"))
