"""Plans and their labels, routing reports in full, labels by three keys, safety of components.

Local stand-ins: a plan is what a user did in a quarter of a day; a routing example is a labelled
document, its candidates fixed expressions of its id and length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph, plan_labels
from skein.plans.registry import query, table
from skein.sources.scratch import write_table

_PLANS = """
e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) // 6 AS BIGINT) AS part, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, event_id FROM events),
p AS (SELECT user_id, day, part, coalesce(list(event_type ORDER BY ts, event_id) FILTER (WHERE k < 60), []) AS predicted, coalesce(list(event_type ORDER BY ts, event_id) FILTER (WHERE k >= 20), []) AS expected,
  coalesce(list(k::VARCHAR ORDER BY ts, event_id) FILTER (WHERE k < 60), []) AS predicted_args, coalesce(list(CASE WHEN k % 10 = 3 THEN 'x' ELSE k::VARCHAR END ORDER BY ts, event_id) FILTER (WHERE k >= 20), []) AS expected_args FROM e GROUP BY 1, 2, 3),
a AS (SELECT *, user_id % 7 = 0 AS abstain, user_id % 5 <> 0 AS complete, len(predicted) = 0 AS silent FROM p),
s AS (SELECT *, CASE WHEN abstain THEN silent ELSE predicted = expected END AS sequence_correct FROM a),
x AS (SELECT *, CASE WHEN complete THEN sequence_correct AND predicted_args = expected_args END AS exact_correct FROM s),
told AS (SELECT user_id, day, part, sequence_correct, exact_correct, CASE WHEN abstain AND silent THEN 'safe_abstain' WHEN abstain THEN 'unsafe_resolution' WHEN silent THEN 'missed_action'
  WHEN sequence_correct AND exact_correct THEN 'safe_execute_correct' WHEN sequence_correct AND exact_correct IS NULL THEN NULL ELSE 'unsafe_resolution' END AS safety FROM x)"""


def _plans(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.floor(F.hour("ts") / 6).cast("long").alias("part"), F.struct("ts", "event_id", "event_type", k.alias("k")).alias("step"))
    plans = events.groupBy("user_id", "day", "part").agg(F.array_sort(F.collect_list("step")).alias("steps"))  # a user's steps of six hours
    done, due = F.filter("steps", lambda s: s.k < 60), F.filter("steps", lambda s: s.k >= 20)
    labels = plan_labels.plan_labels(
        F.transform(done, lambda s: s.event_type), F.transform(done, lambda s: s.k.cast("string")), F.transform(due, lambda s: s.event_type),
        F.transform(due, lambda s: F.when(s.k % 10 == 3, F.lit("x")).otherwise(s.k.cast("string"))), F.col("user_id") % 7 == 0, F.col("user_id") % 5 != 0,
    )
    return plans.select("user_id", "day", "part", labels.alias("told")).select("user_id", "day", "part", "told.*")


@query(f"WITH {_PLANS} SELECT * FROM told")
def derived_plan_labels(spark, sf_dir):
    """Are a plan's actions right, its arguments too, and was it safe; null where that can't be told."""
    return _plans(spark, sf_dir)


@query(f"""WITH {_PLANS} SELECT day, count(*) AS n, count(*) FILTER (WHERE exact_correct) AS n_exact, count(*) FILTER (WHERE exact_correct IS NULL) AS n_unknown, count(*) FILTER (WHERE safety = 'unsafe_resolution') AS n_unsafe,
  count(*) FILTER (WHERE safety = 'missed_action') AS n_missed, count(*) FILTER (WHERE safety IS NULL) AS n_untold, coalesce(bool_or(safety = 'unsafe_resolution'), false) AS any_unsafe FROM told GROUP BY day""")
def plan_safety_report(spark, sf_dir):
    """Plans of each day by what their labels say, three-valued."""
    safety = F.col("safety")
    return _plans(spark, sf_dir).groupBy("day").agg(
        F.count("*").alias("n"), F.count_if("exact_correct").alias("n_exact"), F.count_if(F.col("exact_correct").isNull()).alias("n_unknown"), F.count_if(safety == "unsafe_resolution").alias("n_unsafe"),
        F.count_if(safety == "missed_action").alias("n_missed"), F.count_if(safety.isNull()).alias("n_untold"), F.coalesce(F.bool_or(safety == "unsafe_resolution"), F.lit(False)).alias("any_unsafe"),
    )


_CARDS = """
c AS (SELECT d.doc_id AS example_id, d.doc_id // 3 AS base_id, d.lang, CASE WHEN d.doc_id % 11 <> 0 THEN 'a' || ((d.doc_id // 3) % 5) END AS expected, l.toxic = 1 AS ambiguous, ((d.doc_id * 13) % 100) / 100.0::DOUBLE AS confidence, d.n_chars
  FROM documents d JOIN labels l USING (doc_id)),
m AS (SELECT example_id, i, 'a' || ((example_id // 3 + i * (1 + n_chars % 3)) % 5) AS action, ((n_chars * 37 + example_id * 101 + i * 311) % 1000) / 1000.0::DOUBLE AS score FROM c, range(0, 3) t(i) WHERE i < n_chars % 4),
r AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, action DESC) AS nth FROM m),
k AS (SELECT c.*, max(CASE WHEN nth = 1 THEN score END) AS s1, max(CASE WHEN nth = 2 THEN score END) AS s2, min(CASE WHEN action = expected THEN nth END) AS place FROM c LEFT JOIN r USING (example_id) GROUP BY ALL),
cards AS (SELECT *, coalesce(place = 1, false) AS hit_at_1, place IS NOT NULL AS hit_at_k, coalesce(1.0::DOUBLE / place, 0.0) AS rr, s1 - s2 AS margin, coalesce(s1 < 0.3, true) AS below, confidence < 0.4 AS blocked,
  coalesce(s1 < 0.3, true) OR coalesce(s1 - s2 < 0.1, true) AS unsure, coalesce(s1 >= 0.3, false) AND coalesce(s1 - s2 >= 0.1, false) AS resolved FROM k),
catalog AS (SELECT DISTINCT 'a' || (doc_id % 6) AS action FROM documents),
per_action AS (SELECT lang, expected AS action, count(DISTINCT base_id) AS n FROM cards WHERE expected IS NOT NULL GROUP BY 1, 2),
bases AS (SELECT lang, count(DISTINCT base_id) AS n_bases, count(DISTINCT expected) AS n_actions FROM cards WHERE expected IS NOT NULL GROUP BY 1),
least AS (SELECT lang, min(n) AS least_bases FROM per_action GROUP BY 1),
met AS (SELECT l.lang, count(*) AS n_expected, count(p.n) AS n_covered, min(coalesce(p.n, 0)) AS least_expected FROM (SELECT DISTINCT lang FROM cards) l CROSS JOIN catalog LEFT JOIN per_action p ON p.lang = l.lang AND p.action = catalog.action GROUP BY 1)"""
_SHARE = lambda part, whole, empty="0.0": f"coalesce(count(*) FILTER (WHERE {part})::DOUBLE / nullif(count(*) FILTER (WHERE {whole}), 0), {empty})"
_FAILED = lambda pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in pairs) + "], lambda x: x IS NOT NULL), ',')"


def _cards(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels")
    base = F.floor(F.col("doc_id") / 3)
    action = lambda i: F.concat(F.lit("a"), ((base + i * (1 + F.col("n_chars") % 3)) % 5).cast("string"))
    match = lambda i: F.when(F.lit(i) < F.col("n_chars") % 4, F.struct(((F.col("n_chars") * 37 + F.col("doc_id") * 101 + i * 311) % 1000 / 1000.0).cast("double").alias("score"), action(i).alias("action")))
    rows = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("example_id"), base.alias("base_id"), "lang", F.when(F.col("doc_id") % 11 != 0, action(0)).alias("expected"), (F.col("toxic") == 1).alias("ambiguous"),
        (F.col("doc_id") * 13 % 100 / 100.0).cast("double").alias("confidence"), F.sort_array(F.array_compact(F.array(*[match(i) for i in range(3)])), asc=False).alias("matches"),
    )
    return plan_labels.score_cards(rows, 0.3, 0.1, 0.4)


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), (F.col("doc_id") % 6).cast("string")).alias("action")).distinct()  # six actions


def _reported(metrics):
    return metrics.select(*[F.round(c, 6).alias(c) if kind == "double" else F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in metrics.dtypes])


@query(f"""WITH {_CARDS}, g AS (SELECT lang, count(*) AS n, {_SHARE('hit_at_1', 'true')} AS top1_accuracy, {_SHARE('hit_at_k', 'true')} AS topk_recall, avg(rr) AS mrr, avg(margin) AS mean_margin, min(margin) AS least_margin, count(*) FILTER (WHERE below) AS n_below_least,
  {_SHARE('ambiguous AND unsure', 'unsure')} AS ambiguity_precision, {_SHARE('ambiguous AND unsure', 'ambiguous')} AS ambiguity_recall, {_SHARE('ambiguous AND blocked', 'blocked')} AS stt_gate_precision, {_SHARE('ambiguous AND blocked', 'ambiguous')} AS stt_gate_recall FROM cards GROUP BY lang)
SELECT g.lang, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('top1_accuracy', 'topk_recall', 'mrr', 'mean_margin', 'least_margin', 'ambiguity_precision', 'ambiguity_recall', 'stt_gate_precision', 'stt_gate_recall'))}, n_below_least,
  coalesce(n_bases, 0) AS n_bases, coalesce(n_actions, 0) AS n_actions, round(n_covered / n_expected::DOUBLE, 6) AS catalog_coverage,
  {_FAILED([('base_example_count_below_6', 'coalesce(n_bases, 0) < 6'), ('action_count_below_3', 'coalesce(n_actions, 0) < 3'), ('per_action_coverage_below_2', 'least_bases < 2'), ('catalog_action_coverage_incomplete', 'n_covered < n_expected'), *[(name, f'{metric} < {least}') for name, metric, least in plan_labels.GATES_V1]])} AS failures
FROM g LEFT JOIN bases USING (lang) LEFT JOIN least USING (lang) LEFT JOIN met USING (lang)""")
def routing_report(spark, sf_dir):
    """Every metric of the routing report by language, and which gates fail."""
    return _reported(plan_labels.routing_metrics(_cards(spark, sf_dir), "lang", _catalog(spark, sf_dir)))


@query(f"""WITH {_CARDS}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE resolved) AS n_resolved, {_SHARE('NOT ambiguous AND hit_at_1', 'NOT ambiguous')} AS resolved_accuracy, {_SHARE('NOT ambiguous AND hit_at_k', 'NOT ambiguous')} AS topk_recall,
  {_SHARE('ambiguous AND NOT resolved', 'ambiguous', '1.0')} AS safe_abstention_recall, count(*) FILTER (WHERE resolved AND (ambiguous OR NOT hit_at_1)) AS unsafe_count, coalesce(avg(rr) FILTER (WHERE NOT ambiguous AND expected IS NOT NULL), 0.0) AS mrr, coalesce(avg(margin), 0.0) AS mean_margin FROM cards GROUP BY lang),
b AS (SELECT lang, least(floor(s1 * 10), 9) AS bin, count(*) AS m, avg(hit_at_1::INT) AS acc, avg(s1) AS conf FROM cards WHERE s1 IS NOT NULL AND NOT ambiguous GROUP BY 1, 2),
ece AS (SELECT lang, sum(m * abs(acc - conf)) / sum(m) AS ece FROM b GROUP BY 1)
SELECT g.lang, n, n_resolved, {', '.join(f'round({c}, 6) AS {c}' for c in ('resolved_accuracy', 'topk_recall', 'safe_abstention_recall', 'mrr', 'mean_margin', 'ece'))}, unsafe_count,
  {_FAILED([('catalog_action_coverage_incomplete', 'n_covered < n_expected'), ('per_action_coverage_below_2', 'least_expected < 2'), ('unsafe_resolution_detected', 'unsafe_count > 0'), *[(name, f'{metric} < {least}') for name, metric, least in plan_labels.GATES_V2]])} AS failures
FROM g LEFT JOIN ece USING (lang) LEFT JOIN met USING (lang)""")
def routing_report_v2(spark, sf_dir):
    """The second report: safe silence, unsafe resolutions, calibration of the winning score."""
    first = F.get("matches", F.lit(0)).score
    cards = _cards(spark, sf_dir).withColumns({"resolved": ~F.col("predicted_ambiguous"), "abstain": F.col("ambiguous"), "combined": first})
    return _reported(plan_labels.routing_metrics_v2(cards, "lang", catalog=_catalog(spark, sf_dir)))


@query("""
WITH o AS (SELECT doc_id // 4 AS request_id, doc_id % 4 AS subtask_index, sha256(text) AS snapshot_sha256, CASE WHEN doc_id % 11 = 0 THEN 'o' || doc_id END AS own FROM documents),
l AS (SELECT doc_id // 4 AS request_id, doc_id % 4 AS subtask_index, sha256(CASE WHEN doc_id % 10 = 3 THEN 'old' || text ELSE text END) AS snapshot_sha256, CASE WHEN toxic = 1 THEN 'l' || doc_id END AS theirs, quality, toxic FROM labels JOIN documents USING (doc_id))
SELECT request_id, subtask_index, coalesce(theirs, own) AS split_group_override, quality AS label_quality, toxic AS label_toxic FROM o LEFT JOIN l USING (request_id, subtask_index, snapshot_sha256)""")
def observation_labels(spark, sf_dir):
    """Labels by request, subtask and snapshot: stale ones are ignored, the label's group comes first."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    keys = [F.floor(F.col("doc_id") / 4).alias("request_id"), (F.col("doc_id") % 4).alias("subtask_index")]
    seen = docs.select(*keys, F.sha2("text", 256).alias("snapshot_sha256"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("o"), "doc_id")).alias("split_group_override"))
    stale = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("old"), "text")).otherwise(F.col("text"))
    told = labels.join(docs.select("doc_id", "text"), "doc_id").select(*keys, F.sha2(stale, 256).alias("snapshot_sha256"), F.when(F.col("toxic") == 1, F.concat(F.lit("l"), "doc_id")).alias("split_group_override"), "quality", "toxic")
    return plan_labels.labelled(seen, told).drop("snapshot_sha256")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id)),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY doc_id // 8) AS b FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY text) FROM d),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM n UNION SELECT n.b, r.root FROM r JOIN n ON n.a = r.node AND r.root < n.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), s AS (SELECT root, count(*) AS n, bool_or(toxic = 1) AS unsafe FROM c JOIN d ON d.doc_id = c.node GROUP BY root)
SELECT unsafe, count(*) AS n_components, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS largest FROM s GROUP BY unsafe""")
def component_safety(spark, sf_dir):
    """Labelled documents that share a session (eight ids) or a text are one component; it is unsafe if any of its rows is."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = write_table(docs.select("doc_id", "toxic", F.explode(F.array(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 8)), F.concat(F.lit("t"), F.sha2("text", 256)))).alias("token")), "tokens")
    links = rows.join(rows.groupBy("token").agg(F.min("doc_id").alias("b")), "token").select(F.col("doc_id").alias("a"), "b")
    each = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    placed = each.join(graph.components(links), F.col("doc_id") == F.col("node"), "left").groupBy(F.coalesce("root", "doc_id").alias("root")).agg(F.count("*").alias("n"), F.bool_or(F.col("toxic") == 1).alias("unsafe"))
    return placed.groupBy("unsafe").agg(F.count("*").alias("n_components"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"))
