"""Joins with reasons, gates, guarded writes and small measures over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import storage
from skein.plans.registry import query, table


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def events_in_range(spark, sf_dir):
    """A half-open range of time."""
    rows = table(spark, sf_dir, "events").where("ts >= timestamp'2024-01-05 00:00:00' and ts < timestamp'2024-01-12 00:00:00'")
    return rows.select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY event_type")
def kept_after_ten_days(spark, sf_dir):
    """What stays when all that is older than ten days before the newest event is deleted."""
    rows = table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts").alias("newest"))  # one row
    kept = rows.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("interval 10 days"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT *, CAST(ts AS DATE) AS generation FROM events), c AS (SELECT user_id, max(generation) AS generation FROM g GROUP BY user_id) SELECT user_id, count(*) AS n FROM g JOIN c USING (user_id, generation) GROUP BY user_id")
def current_generation(spark, sf_dir):
    """Rows of any generation (day) but the user's current one are stale and go."""
    rows = table(spark, sf_dir, "events").withColumn("generation", F.to_date("ts"))
    current = rows.groupBy("user_id").agg(F.max("generation").alias("generation"))
    return rows.join(current, ["user_id", "generation"], "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'approved' ELSE 'rejected' END"


@query(f"""
WITH old AS (SELECT d.doc_id AS id, d.lang AS kind, md5(d.text) AS content, {_STATUS} AS status, d.n_chars AS payload FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
new AS (SELECT doc_id AS id, lang AS kind, md5(CASE WHEN doc_id % 15 = 0 THEN text || 'x' ELSE text END) AS content, 'pending' AS status, n_chars + 1 AS payload FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id + 1000000000, lang, md5(text), 'pending', n_chars FROM documents WHERE doc_id % 50 = 1)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.status, n.status) AS status,
  CASE WHEN n.id IS NULL OR o.id IS NULL THEN coalesce(o.payload, n.payload) WHEN o.kind = n.kind AND o.content = n.content AND o.status = 'pending' THEN n.payload ELSE o.payload END AS payload,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN o.kind <> n.kind OR o.content <> n.content THEN 'conflict' WHEN o.status = 'pending' THEN 'updated' ELSE 'decided' END AS outcome
FROM old o FULL JOIN new n ON o.id = n.id""")
def guarded_candidate_upsert(spark, sf_dir):
    """Pending rows take the new payload, decided ones stay, another content under a known id is a conflict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "approved").otherwise("rejected")
    as_row = lambda d, text, state, payload: d.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.md5(text).alias("content"), state.alias("status"), payload.alias("payload"))
    old = as_row(docs.join(labels, "doc_id", "left"), F.col("text"), status, F.col("n_chars"))
    changed = F.when(F.col("doc_id") % 15 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = as_row(docs.where("doc_id % 3 = 0"), changed, F.lit("pending"), F.col("n_chars") + 1)
    more = as_row(docs.where("doc_id % 50 = 1").withColumn("doc_id", F.col("doc_id") + 1000000000), F.col("text"), F.lit("pending"), F.col("n_chars"))
    return storage.guarded_upsert(old, new.unionAll(more))


@query("SELECT event_id, sha256(CAST(json_object('event_id', event_id, 'event_type', event_type, 'user_id', user_id) AS VARCHAR)) AS snapshot_sha256 FROM events")
def canonical_json_hash(spark, sf_dir):
    """The hash of a row as JSON with sorted keys and no white space."""
    text = F.to_json(F.struct("event_id", "event_type", "user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.sha2(text, 256).alias("snapshot_sha256"))


@query("SELECT doc_id FROM (SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 200) WHERE contains(lower(text), 'the ') ORDER BY doc_id DESC LIMIT 10")
def lexical_fallback(spark, sf_dir):
    """The first ten of the newest 200 that hold the phrase; both limits are the operator's own."""
    newest = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy(F.desc("doc_id")).limit(200)
    return newest.where(F.contains(F.lower("text"), F.lit("the "))).orderBy(F.desc("doc_id")).limit(10).select("doc_id")


@query("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN l.doc_id IS NULL THEN 'missing_annotation' END, CASE WHEN c.conv_id IS NULL THEN 'missing_transcript' END], lambda x: x IS NOT NULL), ',') AS errors
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON d.doc_id = c.conv_id""")
def samples_with_errors(spark, sf_dir):
    """Samples beside annotations and transcripts; what is missing is named and the row stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    told = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("told", F.lit(True))
    errors = F.array_compact(F.array(F.when(F.col("labelled").isNull(), "missing_annotation"), F.when(F.col("told").isNull(), "missing_transcript")))
    return docs.join(labels, "doc_id", "left").join(told, "doc_id", "left").select("doc_id", F.array_join(errors, ",").alias("errors"))


@query("""
WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS forms FROM events WHERE value >= 50 GROUP BY user_id),
b AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS forms, count(*) AS n FROM events WHERE value < 2 GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.forms, []), coalesce(b.forms, [])))), ',') AS forms, coalesce(b.n, 0) AS evidence FROM a FULL JOIN b ON a.user_id = b.user_id""")
def merged_names(spark, sf_dir):
    """Known forms and new evidence, merged by key from both sides."""
    rows = table(spark, sf_dir, "events")
    known = rows.where("value >= 50").groupBy("user_id").agg(F.collect_set("event_type").alias("known"))
    seen = rows.where("value < 2").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"), F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    forms = F.array_join(F.array_sort(F.array_union(F.coalesce("known", none), F.coalesce("seen", none))), ",")
    return known.join(seen, "user_id", "full_outer").select("user_id", forms.alias("forms"), F.coalesce("n", F.lit(0)).alias("evidence"))


@query("SELECT source, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0) GROUP BY source")
def documents_with_safe_label(spark, sf_dir):
    safe = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(safe, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


# Our own catalog: operation and risk of event types; others are unknown.
CATALOG = {"click": ("open", "low"), "view": ("read", "low"), "purchase": ("pay", "high")}
_CATALOG_ROWS = ", ".join(f"('{k}', '{o}', '{r}')" for k, (o, r) in CATALOG.items())


@query(f"""
WITH c(event_type, operation, risk) AS (VALUES {_CATALOG_ROWS})
SELECT coalesce(c.operation, '') AS operation, CASE WHEN c.event_type IS NULL THEN 'unknown_capability' WHEN c.risk = 'high' AND e.value > 40 THEN 'too_risky' ELSE '' END AS rejection, count(*) AS n
FROM events e LEFT JOIN c ON e.event_type = c.event_type GROUP BY 1, 2""")
def catalog_lookup(spark, sf_dir):
    """Every match beside its definition; what the catalog doesn't know is rejected with a reason."""
    catalog = spark.createDataFrame([(k, *v) for k, v in CATALOG.items()], "event_type string, operation string, risk string")
    both = table(spark, sf_dir, "events").join(F.broadcast(catalog), "event_type", "left")  # the catalog's rows
    reason = F.when(F.col("operation").isNull(), "unknown_capability").when((F.col("risk") == "high") & (F.col("value") > 40), "too_risky").otherwise("")
    return both.groupBy(F.coalesce("operation", F.lit("")).alias("operation"), reason.alias("rejection")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS a, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS s FROM t)
SELECT user_id, count(*) FILTER (WHERE a <= 3 AND s <= 3) AS overlap, bool_or(a = 1 AND s = 1) AS same_first FROM r GROUP BY user_id""")
def active_against_shadow(spark, sf_dir):
    """Two rankings of a user's types, by count and by value: how many of the first three they share, and whether the first is the same."""
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    ranked = per
    for name, by in (("a", "n"), ("s", "v")):  # a user has as many rows as there are types
        ranked = ranked.withColumn(name, F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(by), "event_type")))
    return ranked.groupBy("user_id").agg(F.count_if((F.col("a") <= 3) & (F.col("s") <= 3)).alias("overlap"), F.bool_or((F.col("a") == 1) & (F.col("s") == 1)).alias("same_first"))


_STEPS = """CASE WHEN event_id % 11 = 0 THEN '{"steps": [' ELSE concat('{"steps":[{"ok":', CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END, '},{"ok":', CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"true"' WHEN 2 THEN '1' ELSE 'null' END, '},{}]}') END"""


@query(f"""
WITH j AS (SELECT event_type, {_STEPS} AS body FROM events),
p AS (SELECT event_type, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS body FROM j),
s AS (SELECT event_type, unnest(CAST(json_extract(body, '$.steps') AS JSON[])) AS step FROM p WHERE body IS NOT NULL),
n AS (SELECT event_type, count(*) AS n_steps, count(*) FILTER (WHERE CAST(json_extract(step, '$.ok') AS VARCHAR) = 'true') AS n_ok, count(*) FILTER (WHERE CAST(json_extract(step, '$.ok') AS VARCHAR) = 'false') AS n_failed FROM s GROUP BY 1),
b AS (SELECT event_type, count(*) FILTER (WHERE body IS NULL) AS n_unparsable FROM p GROUP BY 1)
SELECT b.event_type, b.n_unparsable, coalesce(n.n_steps, 0) AS n_steps, coalesce(n.n_ok, 0) AS n_ok, coalesce(n.n_failed, 0) AS n_failed FROM b LEFT JOIN n ON b.event_type = n.event_type""")
def step_outcomes(spark, sf_dir):
    """Arrays of steps out of JSON: only true counts as success and only false as failure; rows that aren't JSON are counted and skipped."""
    rows = table(spark, sf_dir, "events").select("event_type", F.try_parse_json(F.expr(_STEPS)).alias("body"))
    steps = F.coalesce(F.try_variant_get("body", "$.steps", "array<variant>"), F.array().cast("array<variant>"))
    ok = F.expr("transform(steps, s -> if(coalesce(schema_of_variant(try_variant_get(s, '$.ok', 'variant')), '') = 'BOOLEAN', try_variant_get(s, '$.ok', 'boolean'), null))")
    rows = rows.withColumn("steps", steps).withColumn("ok", ok)
    count = lambda x: F.sum(F.size(x).cast("long"))
    return rows.groupBy("event_type").agg(
        F.count_if(F.col("body").isNull()).alias("n_unparsable"), count("steps").alias("n_steps"),
        count(F.filter("ok", lambda x: x)).alias("n_ok"), count(F.filter("ok", lambda x: ~x)).alias("n_failed"),
    )


@query("""
SELECT d.source, count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS n_positive, count(*) FILTER (WHERE l.quality = 0) AS n_negative,
  count(*) >= 200 AND count(*) FILTER (WHERE l.quality = 1) >= 20 AND count(*) FILTER (WHERE l.quality = 0) >= 20 AS sufficient
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def class_sufficiency(spark, sf_dir):
    """Enough rows, and enough of each class, to be calibrated on."""
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    counted = both.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_positive"), F.count_if(F.col("quality") == 0).alias("n_negative"))
    return counted.withColumn("sufficient", F.expr("n >= 200 and n_positive >= 20 and n_negative >= 20"))


@query("""
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type = 'error') AS labels, bool_or(event_type = 'error') AS unsafe FROM events GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n_plans, count(*) FILTER (WHERE labels > 1) AS n_conflicting, count(*) FILTER (WHERE labels = 1 AND unsafe) AS n_unsafe FROM p GROUP BY day""")
def plan_safety_counts(spark, sf_dir):
    """One label a plan (user and day); a plan with several is a conflict and counts as neither."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("error"))
    plans = rows.groupBy("user_id", "day").agg(F.count_distinct("error").alias("labels"), F.bool_or("error").alias("unsafe"))
    return plans.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n_plans"), F.count_if(F.col("labels") > 1).alias("n_conflicting"), F.count_if((F.col("labels") == 1) & F.col("unsafe")).alias("n_unsafe"))


@query("""
WITH c AS (SELECT source, doc_id // 1000 AS part, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, ',' ORDER BY part)) AS fingerprint FROM c GROUP BY source""")
def run_fingerprint(spark, sf_dir):
    """A digest of digests: each covers a thousand ids, so no task holds a source."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 1000).alias("part"), F.sha2("text", 256).alias("h"))
    joined = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ","), 256)
    parts = rows.groupBy("source", "part").agg(joined("doc_id", "h").alias("digest"), F.count("*").alias("n"))
    return parts.groupBy("source").agg(F.sum("n").alias("n"), joined("part", "digest").alias("fingerprint"))


@query("""
WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS share FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY share DESC, event_type) AS rank FROM s WHERE share >= 0.2)
SELECT user_id, rank, event_type, share FROM r WHERE rank <= 3""")
def top_labels_over_minimum(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    shares = per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6)).where("share >= 0.2")
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("share"), "event_type")).cast("long"))
    return ranked.where("rank <= 3").select("user_id", "rank", "event_type", "share")


@query("SELECT user_id, max(struct_pack(ts := ts, event_id := event_id)).event_id AS event_id FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def active_session(spark, sf_dir):
    """The latest row of two statuses, one a user."""
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    return rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).getField("event_id").alias("event_id"))


_TOKENS = ("that", "with", "pour", "nicht", "para")
_MET = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in _TOKENS)


@query(f"SELECT doc_id, met FROM (SELECT doc_id, {_MET} AS met, length(text) AS size FROM documents) WHERE met > 0 ORDER BY met DESC, size, doc_id LIMIT 3")
def keyword_relevance(spark, sf_dir):
    """The three documents that hold most of the query's tokens, shorter ones first."""
    met = sum((F.when(F.contains(F.lower("text"), F.lit(t)), 1).otherwise(0) for t in _TOKENS), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", met.alias("met"), F.length("text").alias("size")).where("met > 0")
    return rows.orderBy(F.desc("met"), "size", "doc_id").limit(3).select("doc_id", "met")


@query("SELECT user_id, list_has_all(['click', 'view', 'purchase'], list(DISTINCT event_type)) AS allowed FROM events GROUP BY user_id")
def allowed_users(spark, sf_dir):
    """Are all of a user's types on the list?"""
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.size(F.array_except(F.collect_set("event_type"), F.array(*map(F.lit, ("click", "view", "purchase"))))) == 0).alias("allowed"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'), ' .,!?;:') AS phrase FROM conversations")
def phrase_normalised(spark, sf_dir):
    phrase = F.btrim(F.regexp_replace(F.lower("text"), r"[ \t\r\n]+", " "), F.lit(" .,!?;:"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", phrase.alias("phrase"))


STOPWORDS = ("a", "an", "and", "in", "is", "it", "of", "on", "that", "the", "to")
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(rf"""SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n, coalesce(list_min(t), '') AS first_token
FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))) AS t FROM conversations)""")
def content_tokens(spark, sf_dir):
    """The set of words of more than one letter that aren't stopwords."""
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\r\n]+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tokens).cast("long").alias("n"), F.coalesce(F.array_min(tokens), F.lit("")).alias("first_token"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 OR event_type = 'error' THEN NULL ELSE round(1 / (1 + exp(-(1.7 * greatest(-3, least(3, value / 10 - 2)) - 0.4))), 6) END AS p FROM events")
def calibrated_probability(spark, sf_dir):
    """The sigmoid of a line over the clipped score; null where the model isn't ready or the row is a challenge."""
    z = 1.7 * F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("value") / 10 - 2)) - 0.4
    p = F.when((F.col("user_id") % 5 == 0) | (F.col("event_type") == "error"), F.lit(None)).otherwise(F.round(1 / (1 + F.exp(-z)), 6))
    return table(spark, sf_dir, "events").select("event_id", p.alias("p"))


@query("""
WITH i AS (SELECT l.doc_id, 10.0 * (l.doc_id % 7) AS a0, 10.0 * (l.doc_id % 7) + l.quality * 30 + 5 AS a1, CAST(d.n_chars % 50 AS DOUBLE) AS b0, CAST(d.n_chars % 50 + d.n_chars % 13 AS DOUBLE) AS b1 FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
o AS (SELECT *, greatest(0.0, least(a1, b1) - greatest(a0, b0)) AS common FROM i)
SELECT doc_id, round(CAST(CASE WHEN greatest(a1, b1) - least(a0, b0) <= 0 THEN 0 ELSE common / ((a1 - a0) + (b1 - b0) - common) END AS DOUBLE), 6) AS iou,
  round(CAST(CASE WHEN least(a1 - a0, b1 - b0) <= 0 THEN 0 ELSE common / least(a1 - a0, b1 - b0) END AS DOUBLE), 6) AS overlap_ratio FROM o""")
def interval_likeness(spark, sf_dir):
    """Intersection over union of two intervals, and the intersection by the shorter one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    start = 10.0 * (F.col("doc_id") % 7)
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", start.alias("a0"), (start + F.col("quality") * 30 + 5).alias("a1"), (F.col("n_chars") % 50).cast("double").alias("b0"), (F.col("n_chars") % 50 + F.col("n_chars") % 13).cast("double").alias("b1"))
    both = F.greatest(F.lit(0.0), F.least("a1", "b1") - F.greatest("a0", "b0"))
    a, b = F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")
    ratio = lambda x, y: F.round(F.when(y <= 0, 0.0).otherwise(F.try_divide(x, y)), 6)
    return rows.select("doc_id", ratio(both, a + b - both).alias("iou"), ratio(both, F.least(a, b)).alias("overlap_ratio"))


@query(r"SELECT page_id, regexp_matches(lower(url), '^https?://(localhost|127(\.[0-9]{1,3}){3}|\[::1\])(:[0-9]+)?(/|$)') AS loopback FROM pages")
def loopback_pages(spark, sf_dir):
    """May a local-only reader fetch this address?"""
    return table(spark, sf_dir, "pages").select("page_id", F.lower("url").rlike(r"^https?://(localhost|127(\.[0-9]{1,3}){3}|\[::1\])(:[0-9]+)?(/|$)").alias("loopback"))


_GATE = "CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN n_chars < 40 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' WHEN contains(text, '!!') THEN 'shouting' WHEN lang IS NULL THEN 'no_language' ELSE 'pass' END"


@query(f"SELECT source, {_GATE} AS reason, count(*) AS n FROM documents GROUP BY 1, 2")
def gate_ladder(spark, sf_dir):
    """The first check that fails is the reason."""
    return table(spark, sf_dir, "documents").groupBy("source", F.expr(_GATE).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, NOT regexp_matches(t, 'my |this screen') AND regexp_matches(t, 'search|look up|today|latest|news') AS web FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')")
def web_search_gate(spark, sf_dir):
    """Personal and screen contexts block; explicit wishes and current matters open."""
    t = F.lower("text")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", (~t.rlike("my |this screen") & t.rlike("search|look up|today|latest|news")).alias("web"))


@query("""
WITH h AS (SELECT doc_id % 5 = 0 AS held, avg(n_chars) AS m, stddev_pop(n_chars) AS s, count(*) AS n FROM documents GROUP BY 1),
b AS (SELECT a.m - a.s AS a0, a.m + a.s AS a1, o.m - o.s AS b0, o.m + o.s AS b1, a.n AS n_held, o.n AS n_rest FROM h a, h o WHERE a.held AND NOT o.held)
SELECT n_held, n_rest, round(greatest(0.0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)), 6) AS iou, n_held >= 20 AND greatest(0.0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) >= 0.4 AS alike FROM b""")
def style_holdout(spark, sf_dir):
    """The usual range of lengths in the holdout beside that of the rest."""
    held = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 5 == 0).alias("held")).agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"), F.count("*").alias("n"))
    of = lambda flag, x: held.where(F.col("held") == flag).select((F.col("m") - F.col("s")).alias(f"{x}0"), (F.col("m") + F.col("s")).alias(f"{x}1"), F.col("n").alias(f"n_{x}"))
    both = of(True, "a").crossJoin(of(False, "b"))  # one row each
    iou = F.greatest(F.lit(0.0), F.least("a1", "b1") - F.greatest("a0", "b0")) / (F.greatest("a1", "b1") - F.least("a0", "b0"))
    return both.select(F.col("n_a").alias("n_held"), F.col("n_b").alias("n_rest"), F.round(iou, 6).alias("iou"), ((F.col("n_a") >= 20) & (iou >= 0.4)).alias("alike"))
