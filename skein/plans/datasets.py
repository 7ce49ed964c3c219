"""Queries over datasets as a whole: validation, states, histories, evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import validation
from skein.plans.registry import query, table

_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\r\\n]+'), lambda w: w <> '')"


@query("""
WITH c AS (SELECT source, text, lang, count(*) OVER (PARTITION BY sha256(text)) AS copies, l.doc_id AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), m AS (SELECT source, max(n) AS top FROM g GROUP BY 1)
SELECT source, count(*) AS n_rows, CAST(sum(CASE WHEN copies > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_copied, CAST(sum(CASE WHEN labelled IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unlabelled, round(max(top) / count(*)::DOUBLE, 6) AS concentration, max(top) / count(*)::DOUBLE > 0.5 AS concentrated
FROM c JOIN m USING (source) GROUP BY source""")
def dataset_validation(spark, sf_dir):
    """Each source's rows, copies, missing labels, and how much of it one language holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))
    copied = docs.groupBy("h").agg(F.count("*").alias("copies"))
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled")).distinct()
    top = docs.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("top"))
    rows = docs.join(copied, "h").join(labelled, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("copies") > 1).alias("n_copied"), F.count_if(F.col("labelled").isNull()).alias("n_unlabelled"))
    share = F.col("top") / F.col("n_rows")
    return rows.join(top, "source").select("source", "n_rows", "n_copied", "n_unlabelled", F.round(share, 6).alias("concentration"), (share > 0.5).alias("concentrated"))


@query("""
WITH f AS (SELECT user_id, event_type, min(epoch_us(ts)) AS first_us FROM events GROUP BY 1, 2)
SELECT user_id, array_to_string(list(event_type ORDER BY first_us, event_type), ',') AS kinds FROM f GROUP BY user_id""")
def ordered_distinct(spark, sf_dir):
    """The kinds of event of each user in the order of their first time."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.unix_micros("ts")).alias("us"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_type"))), lambda x: x.event_type)
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query("""
WITH r AS (SELECT user_id, value, epoch_us(ts) / 3.6e9 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
t AS (SELECT user_id, value, h - min(h) OVER (PARTITION BY user_id) AS x FROM r WHERE back <= 10)
SELECT user_id, round(regr_slope(value, x), 4) AS slope, count(*) AS n FROM t GROUP BY user_id""")
def tail_slope(spark, sf_dir):
    """The trend of each user's last ten values, by the hour."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    tail = table(spark, sf_dir, "events").select("user_id", "value", (F.unix_micros("ts") / 3.6e9).alias("h"), back.alias("back")).where("back <= 10")
    tail = tail.withColumn("x", F.col("h") - F.min("h").over(Window.partitionBy("user_id")))
    return tail.groupBy("user_id").agg(F.round(F.regr_slope("value", "x"), 4).alias("slope"), F.count("*").alias("n"))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000 THEN 1 ELSE 0 END AS gap, event_id, ts FROM events),
i AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM i GROUP BY 1, 2""")
def silence_islands(spark, sf_dir):
    """Runs of events without twelve silent hours in between."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.unix_micros("ts").alias("us"))
    rows = rows.withColumn("gap", F.coalesce((F.col("us") - F.lag("us").over(w) > 43_200_000_000).cast("long"), F.lit(0).cast("long"))).withColumn("island", F.sum("gap").over(w))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query("""
SELECT CAST(doc_id AS BIGINT) AS candidate_id, CASE WHEN l.doc_id IS NULL OR l.doc_id % 5 = 0 THEN 'pending' WHEN l.quality = 1 AND d.lang <> 'en' THEN 'blocked' WHEN l.quality = 1 THEN 'approved' ELSE 'rejected' END AS state
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def candidate_states(spark, sf_dir):
    """Documents as candidates, labels as decisions; every fifth decision was made for other content."""
    candidates = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id"), F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("scope"))
    decisions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("candidate_id"), F.when(F.col("quality") == 1, F.lit("approve")).otherwise(F.lit("reject")).alias("verdict"), F.lit("en").alias("scope"), F.lit(1).alias("at"))
    hashes = candidates.select("candidate_id", "content_hash")
    decisions = decisions.join(hashes, "candidate_id").withColumn("content_hash", F.when(F.col("candidate_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    return validation.decide_candidates(candidates, decisions)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE back <= 2), '')) AS recent_sha256, right(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE back > 2), ''), 200) AS summary FROM r GROUP BY conv_id""")
def rolling_summary(spark, sf_dir):
    """The last two turns in full, and the last 200 characters of what came before."""
    out = validation.recent_and_summary(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2, 200)
    return out.select("conv_id", F.sha2("recent", 256).alias("recent_sha256"), "summary")


@query("""
WITH f AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, min(epoch_us(ts)) AS us FROM events GROUP BY 1, 2, 3), s AS (SELECT *, min(us) OVER (PARTITION BY user_id, day) AS began FROM f)
SELECT user_id, day, count(*) AS n_marks, string_agg(event_type || '=' || ((us - began) // 1000), ',' ORDER BY event_type) AS phases_ms FROM s GROUP BY 1, 2""")
def trace_assembly(spark, sf_dir):
    """One trace for each user and day: every mark's first time, in milliseconds from the beginning."""
    marks = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.min(F.unix_micros("ts")).alias("us"))
    began = F.min("us").over(Window.partitionBy("user_id", "day"))
    marks = marks.withColumn("ms", F.floor((F.col("us") - began) / 1000).cast("long"))
    phases = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "ms"))), lambda x: F.concat(x.event_type, F.lit("="), x.ms.cast("string")))
    return marks.groupBy("user_id", "day").agg(F.count("*").alias("n_marks"), F.array_join(phases, ",").alias("phases_ms"))


@query("SELECT event_id, CASE WHEN k > 50 THEN 'k:maximum' WHEN k < 5 THEN 'k:minimum' ELSE '' END AS errors FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def schema_validation(spark, sf_dir):
    rules = {"k": {"required": True, "type": "integer", "minimum": 5, "maximum": 50}}
    return table(spark, sf_dir, "events").select("event_id", F.array_join(validation.schema_errors(F.col("props"), rules), ",").alias("errors"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents), n AS (SELECT doc_id, w, lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS k FROM w WHERE regexp_matches(w, '^[A-Z][a-z]+')),
d AS (SELECT DISTINCT doc_id, w, k FROM n)
SELECT k AS name, count(DISTINCT doc_id) AS n_docs, count(DISTINCT w) AS n_forms, min(doc_id) AS first_doc FROM d GROUP BY k HAVING count(DISTINCT doc_id) >= 3""")
def lexicon_evidence(spark, sf_dir):
    """Capitalised words in three or more documents: how many, in how many written forms."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("w")).where(F.col("w").rlike("^[A-Z][a-z]+"))
    named = words.withColumn("name", F.lower(F.regexp_replace("w", "[^A-Za-z]", "")))
    return named.groupBy("name").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("w").alias("n_forms"), F.min("doc_id").alias("first_doc")).where("n_docs >= 3")


@query("""
WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, url FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS nth, count(*) OVER (PARTITION BY host) AS n FROM h)
SELECT host, max(n) AS n_pages, string_agg(url, ' ' ORDER BY url) AS first_urls FROM r WHERE nth <= 5 GROUP BY host""")
def host_presence(spark, sf_dir):
    """How many pages each host has, and its first five addresses."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), "url")
    counts = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    first = pages.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("url"))).where("nth <= 5")
    urls = first.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("first_urls"))
    return counts.join(urls, "host")


@query("""
WITH r AS (SELECT sha256(text) AS h, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM documents)
SELECT count(*) AS n_requests, CAST(sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_hits, count(DISTINCT h) AS n_computed FROM r""")
def content_cache(spark, sf_dir):
    """What a cache by content hash would have saved: one computation for each text."""
    by_hash = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return by_hash.agg(F.sum("n").alias("n_requests"), F.sum(F.col("n") - 1).alias("n_hits"), F.count("*").alias("n_computed"))


@query("""
WITH w AS (SELECT event_id AS window_id, user_id, ts AS a, ts + INTERVAL 12 HOUR AS b FROM events WHERE event_type = 'signup')
SELECT window_id, count(e.event_id) AS n_inside, coalesce(bool_or(e.event_type = 'purchase'), false) AS bought, min(e.event_id) FILTER (WHERE e.ts = (SELECT min(x.ts) FROM events x WHERE x.user_id = w.user_id AND x.ts > w.a AND x.ts <= w.b)) AS first_event
FROM w LEFT JOIN events e ON e.user_id = w.user_id AND e.ts > w.a AND e.ts <= w.b GROUP BY window_id""")
def context_decision(spark, sf_dir):
    """What happened within twelve hours of a signup: how much, whether a purchase, what first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("us"))
    cell = 43_200_000_000
    w = e.where("event_type = 'signup'").select(F.col("event_id").alias("window_id"), "user_id", F.col("us").alias("a"))
    w = w.withColumn("cell", F.explode(F.array(F.floor(F.col("a") / cell), F.floor(F.col("a") / cell) + 1)))
    inside = w.join(e.withColumn("cell", F.floor(F.col("us") / cell)), ["user_id", "cell"]).where((F.col("us") > F.col("a")) & (F.col("us") <= F.col("a") + cell))
    found = inside.groupBy("window_id").agg(F.count("*").alias("n_inside"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.min(F.struct("us", "event_id")).getField("event_id").alias("first_event"))
    every = w.select("window_id").distinct()
    return every.join(found, "window_id", "left").select("window_id", F.coalesce("n_inside", F.lit(0).cast("long")).alias("n_inside"), F.coalesce("bought", F.lit(False)).alias("bought"), "first_event")


@query()
def exact_holdout(spark, sf_dir):
    """Whole sources of together a fifth of the labelled documents, if that can be met exactly."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    groups = labelled.groupBy(F.col("source").alias("group")).agg(F.count("*").alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return validation.exact_holdout(groups, total // 5)
