"""Queries on what may stay, run or be trusted, on style, on texts for embedding, and on folded text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import catalog_texts, digests, text
from skein.operators import dataset_checks, eligibility, gates, routing, storage, styles
from skein.plans.registry import dealt, query, table
from skein.plans.routing import _AIM, _FIND, OPERATIONS, TARGETS

# Fixed values of our own: marks of directness and of address, in the languages of the tables.
DIRECT = r"(?i)(^|[^\p{L}])(open|give|show|make|take|abre|toma|nimm|gib|donne|prends|the|la|die)([^\p{L}]|$)"
FORMAL = r"(?i)(^|[^\p{L}])(sir|madam|usted|vous|Ihnen|und|que|les)([^\p{L}]|$)"
INFORMAL = r"(?i)(^|[^\p{L}])(hey|you|tu|dir|du|and|de|to)([^\p{L}]|$)"

_QUARTILE = "list_sort(list(w))[1 + CAST(round_even((count(*) - 1) * {0}, 0) AS INT)]"
_CARDS = f"""
t AS (SELECT role, conv_id % 4 = 0 AS held, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS BIGINT) AS w, contains(text, '?') AS asks,
  regexp_matches(text, '{DIRECT}') AS direct, regexp_matches(text, '{FORMAL}') AS formal, regexp_matches(text, '{INFORMAL}') AS informal FROM conversations WHERE role <> 'system' AND trim(text) <> ''),
s AS (SELECT role, held, count(*) AS n, CAST(sum(w) AS BIGINT) AS n_words, {_QUARTILE.format(0.25)} AS q1, {_QUARTILE.format(0.5)} AS q2, {_QUARTILE.format(0.75)} AS q3, avg(asks::INT) AS asked, avg(direct::INT) AS directness, count(*) FILTER (WHERE formal) AS f, count(*) FILTER (WHERE informal) AS i FROM t GROUP BY 1, 2),
c AS (SELECT role, held, n, n_words, greatest(5, q1) AS low, greatest(5, q1, q3) AS high, directness, CASE WHEN f > 1.5 * i THEN 'formal' WHEN i > 1.5 * f THEN 'informal' ELSE 'mixed' END AS form,
  CASE WHEN q2 <= 15 THEN 'low' WHEN q2 >= 55 THEN 'high' ELSE 'medium' END AS detail, CASE WHEN asked < 0.15 THEN 'few' WHEN asked > 0.45 THEN 'many' ELSE 'clarifying' END AS questions, CASE WHEN q2 <= 15 THEN 'concise' WHEN q2 >= 55 THEN 'thorough' ELSE 'default' END AS manner FROM s)"""


def _cards(spark, sf_dir, held: bool):
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'").where((F.col("conv_id") % 4 == 0) == held)
    return styles.cards(rows, "role", "text", DIRECT, FORMAL, INFORMAL)


@query(f"WITH {_CARDS} SELECT role, n, n_words, low, high, round(directness, 6) AS directness, form, detail, questions, manner FROM c WHERE NOT held")
def style_cards(spark, sf_dir):
    """How each role writes: usual lengths, directness, form of address, questions, and the manner that suits it."""
    return _cards(spark, sf_dir, False).withColumn("directness", F.round("directness", 6))


@query(f"""WITH {_CARDS}, p AS (SELECT a.role, coalesce(b.n, 0) AS n_held, a.low, a.high, a.directness AS d, a.form, coalesce(b.low, 8) AS hl, coalesce(b.high, 40) AS hh, coalesce(b.directness, 0) AS hd, coalesce(b.form, 'mixed') AS hf FROM c a LEFT JOIN (SELECT * FROM c WHERE held) b ON a.role = b.role WHERE NOT a.held),
o AS (SELECT *, coalesce(greatest(0, least(high, hh) - greatest(low, hl)) / nullif(greatest(high, hh) - least(low, hl), 0), 1.0) AS overlap FROM p)
SELECT role, n_held, round(overlap, 6) AS overlap, round(abs(d - hd), 6) AS drift, form = hf AS same_form, n_held >= 20 AND overlap >= 0.4 AND abs(d - hd) <= 0.2 AND form = hf AS passes FROM o""")
def style_card_check(spark, sf_dir):
    """Each role's card beside that of the held-out conversations."""
    found = styles.compare(_cards(spark, sf_dir, False), _cards(spark, sf_dir, True), "role")
    return found.select("role", "n_held", F.round("overlap", 6).alias("overlap"), F.round("drift", 6).alias("drift"), "same_form", "passes")


REQUIRED = {"1-URGENT": 100, "5-LOW": 100_000_000, "R": 10, "missing": 7}


@query("""
WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderstatus END AS digest, CASE WHEN o_orderkey % 4 = 0 THEN 'development' WHEN o_orderkey % 11 <> 0 THEN 'holdout' END AS split, o_custkey AS family, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS tag FROM orders),
a AS (SELECT l_orderkey AS id, l_linestatus AS digest, [l_returnflag, l_linestatus] AS tags FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT -o_orderkey - 1, 'X', ['R'] FROM orders WHERE o_orderkey % 100 = 7),
i AS (SELECT id, count(*) AS n, max(digest) AS digest FROM s GROUP BY id), k AS (SELECT id, count(*) AS n FROM a GROUP BY id),
t AS (SELECT tag, count(*) AS n FROM (SELECT tag FROM s UNION ALL SELECT unnest(tags) FROM a) GROUP BY tag),
d AS (SELECT count(*) AS n FROM s GROUP BY day),
f AS (SELECT 'error' AS level, 'sample_count' AS finding, count(*) AS n, count(*) <> 100 AS holds FROM s
  UNION ALL SELECT 'error', 'duplicate_sample_ids', count(*), count(*) > 0 FROM i WHERE n > 1
  UNION ALL SELECT 'error', 'development_count', count(*), count(*) <> 30 FROM s WHERE split = 'development'
  UNION ALL SELECT 'error', 'holdout_count', count(*), count(*) <> 70 FROM s WHERE split = 'holdout'
  UNION ALL SELECT 'error', 'duplicate_annotation_ids', count(*), count(*) > 0 FROM k WHERE n > 1
  UNION ALL SELECT 'error', 'missing_annotations', count(*), count(*) > 0 FROM i WHERE id NOT IN (SELECT id FROM k)
  UNION ALL SELECT 'error', 'unknown_annotations', count(*), count(*) > 0 FROM k WHERE id NOT IN (SELECT id FROM i)
  UNION ALL SELECT 'error', 'annotation_audio_hash_mismatch', count(*), count(*) > 0 FROM a JOIN i USING (id) WHERE i.digest IS NOT NULL AND a.digest IS DISTINCT FROM i.digest
  UNION ALL SELECT 'error', 'missing_audio', count(*), count(*) > 0 FROM s WHERE digest IS NULL
  UNION ALL SELECT 'error', 'duplicate_group_crosses_splits', count(*), count(*) > 0 FROM (SELECT family FROM s GROUP BY family HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'warning', 'temporal_concentration_over_50_percent', max(n), max(n) > 0.5 * sum(n) FROM d
  UNION ALL SELECT 'warning', 'fewer_than_5_capture_dates', count(*), count(*) < 5 FROM d)
SELECT level, finding, NULL::VARCHAR AS detail, n::BIGINT AS n FROM f WHERE holds
UNION ALL SELECT 'error', 'tag_coverage_incomplete', r.tag, r.least - coalesce(t.n, 0) FROM (VALUES ('1-URGENT', 100), ('5-LOW', 100000000), ('R', 10), ('missing', 7)) r(tag, least) LEFT JOIN t USING (tag) WHERE r.least > coalesce(t.n, 0)""")
def dataset_findings(spark, sf_dir):
    """Orders as recordings, their first lines as annotations: every fault of the set."""
    split = F.when(F.col("o_orderkey") % 4 == 0, "development").when(F.col("o_orderkey") % 11 != 0, "holdout")
    orders = table(spark, sf_dir, "orders")
    samples = orders.select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 10 != 3, F.col("o_orderstatus")).alias("digest"), split.alias("split"), F.col("o_custkey").alias("family"), F.to_date("o_orderdate").alias("day"), F.array("o_orderpriority").alias("tags"))
    notes = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linestatus").alias("digest"), F.array("l_returnflag", "l_linestatus").alias("tags"))
    stray = orders.where("o_orderkey % 100 = 7").select((-F.col("o_orderkey") - 1).alias("sample_id"), F.lit("X").alias("digest"), F.array(F.lit("R")).alias("tags"))
    return dataset_checks.findings(samples, notes.unionAll(stray), 100, 30, REQUIRED)


# One defect for each remainder of the event's id; what is left has none of its own.
_REPORT_SQL = """
WITH e AS (SELECT event_id, event_id % 23 AS m, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS u FROM events)
SELECT event_id, CASE WHEN m = 0 THEN 'missing_report' WHEN m IN (1, 2) THEN 'invalid_report' WHEN m = 3 THEN 'unsupported_report_schema' WHEN m = 4 THEN 'quality_gate_failed' WHEN m = 5 THEN 'catalog_coverage_incomplete' WHEN m = 6 THEN 'catalog_action_count_mismatch'
  WHEN m = 7 THEN 'expected_action_count_mismatch' WHEN m = 8 THEN 'catalog_hash_missing' WHEN m = 9 THEN 'catalog_hash_mismatch' WHEN m = 10 THEN 'runtime_config_invalid' WHEN m = 11 THEN 'runtime_config_catalog_mismatch' WHEN m = 12 THEN 'runtime_fingerprint_invalid'
  WHEN k + 10 < 20 OR u + 10 < k + 10 THEN 'evaluation_sample_incomplete' WHEN k < 15 THEN 'resolved_accuracy_below_0_80' WHEN m = 13 THEN 'topk_below_0_95' WHEN m = 14 THEN 'safe_abstention_below_0_95' WHEN m = 15 THEN 'unsafe_resolution_detected' WHEN m IN (16, 17) THEN 'quality_gate_failures_present' ELSE 'passed' END AS verdict FROM e"""


@query(_REPORT_SQL)
def report_gate(spark, sf_dir):
    """Quality reports made of the events, with a defect by the id and by their values: the first check that each fails."""
    k, m = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 23
    config = F.concat(F.lit('{"catalog_hash":"'), F.when(m == 11, "other").otherwise("abc"), F.lit('","k":'), k.cast("string"), F.lit("}"))
    fields = {
        "schema_version": F.when(m == 3, "1").otherwise("2"), "quality_gate_passed": F.when(m == 4, "false").otherwise("true"), "catalog_coverage": F.when(m == 5, "0.99").otherwise("1.0"), "action_count": F.when(m == 6, "9").otherwise("10"), "expected_action_count": F.when(m == 7, "11").otherwise("10"),
        "catalog_hash": F.when(m == 8, '""').when(m == 9, '"abd"').otherwise('"abc"'), "runtime_config": F.when(m == 10, F.lit("7")).otherwise(config), "runtime_fingerprint": F.concat(F.lit('"'), F.sha2(F.when(m == 12, F.lit("x")).otherwise(config), 256), F.lit('"')),
        "sample_count": (F.col("user_id") + 10).cast("string"), "base_example_count": (k + 10).cast("string"), "resolved_accuracy": F.when(k < 15, "0.79").otherwise("0.8"), "topk_recall": F.when(m == 13, "0.9").otherwise("0.95"), "safe_abstention_recall": F.when(m == 14, "null").otherwise("1"),
        "unsafe_resolution_count": F.when(m == 15, "1").otherwise("0"), "quality_gate_failures": F.when(m == 16, '["x"]').when(m == 17, "null").otherwise("[]"),
    }
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}": '), value) for name, value in fields.items()]), F.lit("}"))
    report = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit("{broken")).when(m == 2, F.lit("[1]")).when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"metrics": '), body, F.lit("}"))).otherwise(body)
    return gates.report_verdicts(table(spark, sf_dir, "events").select("event_id", report.alias("report")), "report", 10, "abc").select("event_id", "verdict")


@query("""
WITH d AS (SELECT p_partkey AS k, p_size <= 40 AS low, p_size % 13 = 0 AS asks FROM part WHERE p_partkey % 50 <> 7),
s AS (SELECT l_orderkey AS o, bool_and(l_partkey % 9 <> 4 AND coalesce(low, false) AND NOT coalesce(asks, true) AND l_quantity < 48) AS fine FROM lineitem LEFT JOIN d ON l_partkey = k GROUP BY 1)
SELECT o_orderkey, coalesce(fine, false) AS allowed FROM orders LEFT JOIN s ON o = o_orderkey""")
def allowed_plans(spark, sf_dir):
    """Orders as plans, their lines as steps, parts as definitions: which may run unseen."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("action_id"), (F.col("l_quantity") >= 48).alias("asks"))
    definitions = table(spark, sf_dir, "part").where("p_partkey % 50 <> 7").select(F.col("p_partkey").alias("action_id"), F.when(F.col("p_size") <= 40, "low").otherwise("high").alias("risk"), (F.col("p_size") % 13 == 0).alias("asks"))
    return gates.allowed_plans(table(spark, sf_dir, "orders"), steps, definitions, "o_orderkey", canary=F.col("action_id") % 9 != 4)


@query("""
WITH d AS (SELECT doc_id, lang, 'audio:' || left(sha256(text), 24) AS id, 'audio:' || left(sha256(CASE WHEN doc_id % 15 = 0 THEN text || '!' ELSE text END), 24) AS now FROM documents),
a AS (SELECT id, bool_and(doc_id % 7 <> 0) AS ok FROM d WHERE doc_id % 3 = 0 GROUP BY id)
SELECT doc_id, now AS source_id, CASE WHEN ok THEN 'self' ELSE 'unknown' END AS speaker FROM d LEFT JOIN a ON a.id = d.now""")
def trusted_sources(spark, sf_dir):
    """Every third document was decided on, refused if its id divides by seven; every fifteenth has been edited since and lost what was decided."""
    docs = table(spark, sf_dir, "documents")
    decided = docs.where("doc_id % 3 = 0").select(eligibility.content_id("audio", F.col("text")).alias("source_id"), (F.col("doc_id") % 7 != 0).alias("approved"))
    edited = F.when(F.col("doc_id") % 15 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return eligibility.decided_speakers(docs.select("doc_id", eligibility.content_id("audio", edited).alias("source_id")), decided, "source_id")


@query("""
WITH f AS (SELECT *, CASE WHEN length(text) > 40 THEN sha256(text) END AS digest, conv_id * 100 + turn AS id, CASE WHEN turn % 7 = 6 THEN 'excluded' ELSE 'new' END AS state FROM conversations),
c AS (SELECT *, min(id) OVER (PARTITION BY sha256(text)) AS oldest, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS said FROM f)
SELECT conv_id, turn FROM c WHERE digest IS NOT NULL AND role = 'user' AND oldest = id AND (said IS NULL OR left(said, 20) <> left(text, 20)) AND state <> 'excluded'""")
def evaluation_candidates(spark, sf_dir):
    """User turns as recordings: long enough, of the user, the first of their text, no second try of the turn before, not excluded."""
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    said = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    rows = rows.withColumn("retry_of", F.when(F.left(said, F.lit(20)) == F.left(F.col("text"), F.lit(20)), said)).withColumn("h", F.sha2("text", 256))
    rows = rows.join(rows.groupBy("h").agg(F.min("id").alias("oldest")), "h")
    may = eligibility.may_be_evaluated(F.when(F.length("text") > 40, F.col("h")), F.when(F.col("role") == "user", "self"), F.when(F.col("oldest") != F.col("id"), F.col("oldest")), F.col("retry_of"), F.when(F.col("turn") % 7 == 6, "excluded").otherwise("new"))
    return rows.where(may).select("conv_id", "turn")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retained_events(spark, sf_dir):
    """The table after all that is older than ten days before the newest event was deleted."""
    rows = table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts").alias("newest"))  # one row
    return storage.keep_days(rows.join(F.broadcast(newest)), "ts", F.col("newest"), 10).select("event_id", "user_id", "event_type")


@query("SELECT doc_id, source, h AS generation FROM (SELECT doc_id, source, left(md5(lang), 6) AS h FROM documents) WHERE h = left(md5('en'), 6)")
def retained_generation(spark, sf_dir):
    """The indexed documents after every other catalog's were deleted."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.left(F.md5("lang"), F.lit(6)).alias("generation"))
    return storage.keep_generation(rows, "generation", F.left(F.md5(F.lit("en")), F.lit(6)))


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_kept FROM r WHERE place <= 50)
SELECT user_id, event_id, place, n_kept FROM k WHERE place <= 10""")
def session_takes(spark, sf_dir):
    """The newest ten takes of each session, of the fifty that it keeps."""
    takes = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return storage.newest_of_session(takes, "user_id", ["ts", "event_id"], 50, 10).select("user_id", "event_id", "place", "n_kept")


@query("""
WITH o AS (SELECT doc_id, CASE quality WHEN 1 THEN 'approved' ELSE 'rejected' END AS s FROM labels), n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'approved' WHEN doc_id % 3 = 0 THEN 'rejected' END AS s FROM documents)
SELECT doc_id, o.s AS before, n.s AS after FROM o JOIN n USING (doc_id) WHERE n.s IS NOT NULL AND o.s <> n.s""")
def status_events(spark, sf_dir):
    """What a patch of states changes: one event for each row of another state than before."""
    old = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("state"))
    patch = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "approved").when(F.col("doc_id") % 3 == 0, "rejected").alias("state"))
    return storage.status_events(old, patch, "doc_id", "state")


_ANSWER = '{"theme": ["odd", {"name": "odd"}, {"title": "even", "time": "%s"}], "goals": "", "objective": {"goal": "know", "text": "%s"}, "decision": {"decision": "wait", "content": ["a", "b"]}, "people": [{"name": "Ann"}, "Ann", 7], "events": [], "confidence": %s, "parts": [{"confidence": 0.5, "deep": {"confidence": 9}}, [{"confidence": true}]]}'


@query("""
WITH e AS (SELECT event_id, user_id AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), c AS (SELECT *, least(1.0, (k / 25.0::DOUBLE + 0.5) / 2) AS confidence FROM e)
SELECT event_id, 'odd; [' || u || '] even; s' || u || ' — know; a; b — wait' AS summary, 'odd' AS topic, 's' || u || ' — know' AS intent, 'a; b — wait' AS decision, '' AS person_context, 'Ann' AS people, '' AS observations, round(confidence, 6) AS confidence FROM c WHERE confidence >= 0.65""")
def confident_digests(spark, sf_dir):
    """Digests out of loosely shaped answers made of the events; those below 0.65 go."""
    k = F.get_json_object("props", "$.k").cast("long")
    answer = F.format_string(_ANSWER, F.col("user_id").cast("string"), F.concat(F.lit("s"), F.col("user_id").cast("string")), (k / 25.0).cast("string"))
    events = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"), "event_id")
    told = events.select("event_id", digests.digest(answer, F.lit("title"), F.col("event_type")).alias("d")).select("event_id", "d.*")
    joined = [F.array_join(c, "|").alias(c) for c in ("people", "observations")]
    return eligibility.confident(told, "confidence").select("event_id", "summary", "topic", "intent", "decision", "person_context", *joined, F.round("confidence", 6).alias("confidence"))


@query("""
WITH p AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN ['try ' || p_name, 'try ' || p_name, lower(p_brand)] ELSE [] END AS x FROM part), q AS (SELECT *, CASE WHEN len(x) > 0 THEN 'For example: try ' || p_name || '; ' || lower(p_brand) END AS shown FROM p)
SELECT p_partkey, p_name || '. ' || p_type || coalesce('. ' || shown, '') AS semantic, 'Allowed operation: ' || CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'unknown' END || '. Action: ' || p_name || '.' AS intent,
  'Target and context: ' || CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_brand || ', argument a, argument z' END || coalesce('; ' || shown, '') || CASE WHEN p_size % 7 = 0 THEN '; also offered elsewhere.' ELSE '; done here.' END AS target_context FROM q""")
def capability_documents(spark, sf_dir):
    """Parts as capabilities: the three texts that are embedded for each."""
    size, none = F.col("p_size"), F.array().cast("array<string>")
    examples = F.when(size % 3 == 0, F.array(F.concat(F.lit("try "), "p_name"), F.concat(F.lit(" try "), "p_name"), F.lower("p_brand")))
    at = lambda x: F.when(size % 5 != 0, x).otherwise(none)
    three = catalog_texts.of_capability(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type"), examples, at(F.array(F.lit("z"), F.lit("a"))), F.when(size % 2 == 0, "open"), at(F.array("p_brand")), size % 7 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", three.alias("d")).select("p_partkey", "d.*")


@query(f"""
WITH r AS (SELECT conv_id, turn, text, unnest(CASE WHEN len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) = 0 THEN [''] ELSE regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') END) AS w FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id, turn, text, lower(w) AS token FROM r), x AS (SELECT conv_id, turn, any_value(text) AS text, string_agg(DISTINCT {_FIND}, ', ' ORDER BY {_FIND}) AS ops, string_agg(DISTINCT {_AIM}, ', ' ORDER BY {_AIM}) AS aims FROM t GROUP BY 1, 2),
c AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM x)
SELECT conv_id, turn, sha256(clean) AS semantic_sha256, sha256('Operation wanted: ' || coalesce(ops, 'Request: ' || clean) || '.') AS intent_sha256, sha256('Target wanted: ' || coalesce(aims, 'Request: ' || clean) || '.') AS context_sha256 FROM c""")
def request_documents(spark, sf_dir):
    """User turns as requests: the three texts that are embedded for each, with the operations and targets that words in them name."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    token = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)
    named = lambda known: F.array_sort(F.array_distinct(F.array_compact(F.transform(token, lambda w: routing._lookup(w, known)))))
    three = catalog_texts.of_request(F.col("text"), named(OPERATIONS), named(TARGETS))
    return turns.select("conv_id", "turn", three.alias("d")).select("conv_id", "turn", F.sha2("d.semantic", 256).alias("semantic_sha256"), F.sha2("d.intent", 256).alias("intent_sha256"), F.sha2("d.target_context", 256).alias("context_sha256"))


@query("SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[ \\t\\r\\n]+', ' ', 'g'))) AS composed_sha256, sha256(strip_accents(text)) AS unaccented_sha256 FROM documents")
def unicode_forms(spark, sf_dir):
    """Whole documents composed, and without marks."""
    docs = table(spark, sf_dir, "documents", spread=True)
    return docs.select("doc_id", F.sha2(text.composed(F.col("text")), 256).alias("composed_sha256"), F.sha2(text.unaccented(F.col("text")), 256).alias("unaccented_sha256"))
