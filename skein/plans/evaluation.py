"""Routing evaluation, calibration statistics, components and splits.

Local stand-in for scored examples: labelled documents, the score a fixed expression of
the document, the label its quality, the group its source, the time its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import calibration, graph, splits
from skein.plans.registry import query, table
from skein.sources.scratch import write_table

_OBS = """obs AS (SELECT d.doc_id, d.source, d.lang, l.toxic, CAST(l.quality AS DOUBLE) AS y, ((d.n_chars * 37 + d.doc_id * 101) % 1000) / 1000.0::DOUBLE * 0.4 + 0.6 * l.quality * ((d.doc_id * 7919) % 100) / 100.0::DOUBLE AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _observations(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, sf_dir, "labels")  # noqa: E741
    # 0.6 * quality * n is a decimal in SQL, so exact: a product of doubles would lie beside it, and beside a threshold that p meets.
    tenths = 6 * F.col("quality") * F.pmod(F.col("doc_id") * 7919, F.lit(100))
    p = F.pmod(F.col("n_chars") * 37 + F.col("doc_id") * 101, F.lit(1000)) / 1000.0 * 0.4 + tenths / 10.0 / 100.0
    return d.join(l, "doc_id").select("doc_id", "source", "lang", "toxic", F.col("quality").cast("double").alias("y"), p.alias("p"))


@query(f"WITH {_OBS}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM obs GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(n * abs(acc - conf)) / sum(n) AS DOUBLE), 6) AS ece FROM b")
def ece_equal_width(spark, sf_dir):
    return calibration.ece_equal_width(_observations(spark, sf_dir))


@query(f"""
WITH {_OBS}, v AS (SELECT p, count(*) AS n, sum(y) AS y FROM obs GROUP BY p),
u AS (SELECT *, sum(n) OVER (ORDER BY p) AS upto, sum(n) OVER () AS total FROM v),
k AS (SELECT *, least(10, greatest(1, floor(total / 20))) AS bins FROM u),
b AS (SELECT len(list_filter(range(1, CAST(bins AS BIGINT) + 1), lambda b: greatest(1, CAST(round_even(b * total / bins, 0) AS BIGINT)) <= upto - n)) AS bin, n, y, p FROM k),
g AS (SELECT bin, sum(n) AS n, sum(y) / sum(n) AS acc, sum(p * n) / sum(n) AS conf FROM b GROUP BY bin)
SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_bins, round(CAST(sum(n * abs(acc - conf)) / sum(n) AS DOUBLE), 6) AS ece FROM g""")
def ece_equal_mass(spark, sf_dir):
    return calibration.ece_equal_mass(_observations(spark, sf_dir))


@query(f"WITH {_OBS}, c AS (SELECT y, p, greatest(1e-12, least(1 - 1e-12, p)) AS q FROM obs) SELECT round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM c")
def brier_logloss(spark, sf_dir):
    return calibration.brier_logloss(_observations(spark, sf_dir))


@query(f"WITH {_OBS}, t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (WHERE p >= threshold) AS support, round(count(*) FILTER (WHERE p >= threshold) / count(*)::DOUBLE, 6) AS coverage, round(1 - avg(y) FILTER (WHERE p >= threshold), 6) AS risk FROM obs, t GROUP BY threshold")
def selective_risk(spark, sf_dir):
    return calibration.selective_risk(_observations(spark, sf_dir))


@query(f"WITH {_OBS} SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS n_unsafe, round(CASE WHEN sum(toxic) = 0 THEN 1 - pow(0.05, 1.0 / count(*)) END, 6) AS bound FROM obs GROUP BY lang")
def zero_event_bound(spark, sf_dir):
    """Where nothing unsafe was seen: the 95 % upper bound of its probability."""
    n, unsafe = F.count("*"), F.sum("toxic")
    return _observations(spark, sf_dir).groupBy("lang").agg(n.alias("n"), unsafe.cast("long").alias("n_unsafe"), F.round(F.when(unsafe == 0, 1 - F.pow(F.lit(0.05), 1.0 / n)), 6).alias("bound"))


_GATES = (("accuracy", 0.80), ("recall", 0.95), ("precision", 0.80))
_METRICS = """m AS (SELECT source, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(coalesce(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(y), 0), 0.0), 6) AS recall,
  round(coalesce(sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 0), 0.0), 6) AS precision, round(avg(p), 6) AS mean_score FROM obs GROUP BY source)"""


def _routing(spark, sf_dir):
    taken = F.col("p") >= 0.5
    right = F.count_if(taken & (F.col("y") == 1))
    return _observations(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg((taken == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"),
        F.round(F.coalesce(F.try_divide(right, F.sum("y")), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.try_divide(right, F.count_if(taken)), F.lit(0.0)), 6).alias("precision"), F.round(F.avg("p"), 6).alias("mean_score"),
    )


@query(f"WITH {_OBS}, {_METRICS} SELECT * FROM m")
def routing_metrics_v1(spark, sf_dir):
    return _routing(spark, sf_dir)


@query(f"WITH {_OBS}, {_METRICS} SELECT source, array_to_string(list_filter([{', '.join(f'''CASE WHEN {g} < {t} THEN '{g}' END''' for g, t in _GATES)}], lambda x: x IS NOT NULL), ',') AS failed FROM m")
def gate_failures(spark, sf_dir):
    """The names of the quality gates that each source misses."""
    failed = F.array_compact(F.array(*[F.when(F.col(g) < t, F.lit(g)) for g, t in _GATES]))
    return _routing(spark, sf_dir).select("source", F.array_join(failed, ",").alias("failed"))


_EDGES = "edges AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity >= 49)"


def _edges(spark, sf_dir):
    """Customers and suppliers, linked by large urgent orders: nodes that share a token are one component."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()


@query(f"""
WITH RECURSIVE {_EDGES}, l AS (SELECT c * 2 AS a, s * 2 + 1 AS b FROM edges UNION ALL SELECT s * 2 + 1, c * 2 FROM edges),
r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node AND r.root < l.b)
SELECT root, count(*) AS size FROM (SELECT node, min(root) AS root FROM r GROUP BY node) GROUP BY root""")
def connected_components(spark, sf_dir):
    edges = write_table(_edges(spark, sf_dir), "edges")
    found = graph.components(edges)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.count("*").alias("size"))


@query(f"WITH {_OBS}, c AS (SELECT source, bool_or(toxic = 1) AS unsafe, count(*) AS n FROM obs GROUP BY source) SELECT unsafe, count(*) AS n_components, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY unsafe")
def component_unsafe(spark, sf_dir):
    """A component is unsafe if any of its rows is."""
    each = _observations(spark, sf_dir).groupBy("source").agg(F.bool_or(F.col("toxic") == 1).alias("unsafe"), F.count("*").alias("n"))
    return each.groupBy("unsafe").agg(F.count("*").alias("n_components"), F.sum("n").alias("n_rows"))


@query("""
WITH g AS (SELECT conv_id % 997 AS grp, conv_id * 100 + turn AS moment FROM conversations), s AS (SELECT grp, min(moment) AS first_at, max(moment) AS last_at FROM g GROUP BY grp),
r AS (SELECT *, row_number() OVER (ORDER BY last_at, grp) AS nth, count(*) OVER () AS n FROM s),
c AS (SELECT *, max(CASE WHEN nth <= floor(n * 0.8) THEN last_at END) OVER () AS cutoff FROM r)
SELECT grp, first_at, last_at, CASE WHEN last_at <= cutoff THEN 'train' WHEN first_at > cutoff THEN 'holdout' ELSE 'excluded' END AS split FROM c""")
def temporal_group_split(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 997).alias("grp"), (F.col("conv_id") * 100 + F.col("turn")).alias("moment"))
    return splits.temporal_group_split(rows, "grp", "moment")


@query("SELECT source, count(DISTINCT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'holdout' END) AS n_splits FROM documents GROUP BY source HAVING count(DISTINCT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'holdout' END) > 1")
def group_leakage(spark, sf_dir):
    """Sources that a split by document would put on both sides."""
    rows = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 10 < 8, F.lit("train")).otherwise(F.lit("holdout")).alias("split"))
    return splits.leaking_groups(rows, "source", "split")


@query("""SELECT d.doc_id, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'unsafe' WHEN l.quality = 1 THEN 'correct' ELSE 'incorrect' END AS outcome
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.n_chars % 10 <> 3""")
def observation_label_join(spark, sf_dir):
    """Observations keep their row without a label; a label for another snapshot is ignored."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    fresh = (d.doc_id == l.doc_id) & (d.n_chars % 10 != 3)
    outcome = F.when(l.doc_id.isNull(), F.lit("unlabelled")).when(l.toxic == 1, F.lit("unsafe")).when(l.quality == 1, F.lit("correct")).otherwise(F.lit("incorrect"))
    return d.join(l, fresh, "left").select(d.doc_id, l.quality, l.toxic, outcome.alias("outcome"))


@query()
def platt_fit(spark, sf_dir):
    return calibration.platt_fit(write_table(_observations(spark, sf_dir), "fit"))


@query()
def calibration_line(spark, sf_dir):
    """The logistic line of outcomes over the scores' log-odds: slope 1 and intercept 0 if calibrated; any sign."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    rows = _observations(spark, sf_dir).select(F.ln(p / (1 - p)).alias("p"), "y")
    return calibration.platt_fit(write_table(rows, "line"), least_slope=float("-inf"))


@query()
def bootstrap_ci(spark, sf_dir):
    return calibration.bootstrap_interval(_observations(spark, sf_dir).select("y", F.col("source").alias("group")))
