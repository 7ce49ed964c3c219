"""Streaming queries, run over what is there; SQL says what the batch result is."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text
from skein.plans.registry import query, table
from skein.streaming import incremental, stateful, traces


@query("""
WITH b AS (SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT * FROM b WHERE start_us + 600000000 <= (SELECT epoch_us(max(ts)) FROM events)""")
def stream_bucket_counts(spark, sf_dir):
    """Ten-minute counts of a stream; windows that are still open at its end are not given out."""
    counted = stateful.run_available(stateful.bucket_counts(stateful.file_stream(spark, sf_dir, "events"), "10 minutes", "0 seconds"))
    return counted.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def stream_duplicate_requests(spark, sf_dir):
    """Requests of the same user within an hour of the first remembered one."""
    return stateful.run_available(traces.mark_duplicate_requests(stateful.file_stream(spark, sf_dir, "events"), "user_id", 3600), keyed=True)


@query("""
SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_day FROM events GROUP BY user_id
HAVING max(ts) + INTERVAL 90 SECOND <= (SELECT max(ts) FROM events)""")
def ready_after_grace(spark, sf_dir):
    """Sessions that ended at least 90 seconds before the newest event."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("now"))
    ended = events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return ended.join(newest, F.col("last") + F.expr("INTERVAL 90 SECOND") <= F.col("now")).select("user_id", "n", F.to_date("last").cast("string").alias("last_day"))


_IDLE_HOURS = 6
_PAIRS = ", ".join(f"('{name}', '{first}', '{then}')" for name, (first, then) in traces.METRICS.items())
_TRACES = f"""
marks AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, min(epoch_us(ts)) AS us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2, 3),
spans AS (SELECT user_id, day, min(us) AS began_us, max(last_us) AS last_us FROM marks GROUP BY 1, 2),
told AS (SELECT * FROM spans WHERE last_us // 1000 + {_IDLE_HOURS * 3_600_000} + 1 <= (SELECT max(epoch_us(ts)) // 1000 FROM events)),
phases AS (SELECT user_id, day, event_type, (us - began_us) // 1000 AS ms, began_us, t.last_us FROM told t JOIN marks USING (user_id, day))"""


def _live_traces(spark, sf_dir):
    days = stateful.file_stream(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return stateful.run_available(traces.assemble(days, ["user_id", "day"], "event_type", "ts", f"{_IDLE_HOURS} hours"), keyed=True)


@query(f"""WITH {_TRACES}
SELECT user_id, day, began_us, max(last_us) AS last_us, count(*) AS n_marks, string_agg(event_type || '=' || ms, ',' ORDER BY event_type) AS phases_ms FROM phases GROUP BY 1, 2, 3""")
def live_traces(spark, sf_dir):
    """Traces of a user's day from a stream, each told once, six hours after its last event; those still open at the end are not told."""
    listed = F.transform(F.array_sort(F.map_entries("phases_ms")), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string")))
    return _live_traces(spark, sf_dir).select("user_id", "day", "began_us", "last_us", F.size("phases_ms").cast("long").alias("n_marks"), F.array_join(listed, ",").alias("phases_ms"))


@query(f"""WITH {_TRACES}, m AS (SELECT p.user_id, p.day, metric, y.ms - p.ms AS ms FROM (VALUES {_PAIRS}) AS t(metric, a, b) JOIN phases p ON p.event_type = a JOIN phases y ON y.event_type = b AND y.user_id = p.user_id AND y.day = p.day WHERE y.ms >= p.ms)
SELECT user_id, day, metric, ms FROM m""")
def live_trace_metrics(spark, sf_dir):
    """The seven named metrics of every told trace."""
    return _live_traces(spark, sf_dir).select("user_id", "day", F.inline(traces.metrics(F.col("phases_ms"))))


@query("""
WITH RECURSIVE r AS (SELECT user_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS asked, epoch_us(ts) AS us, event_id FROM events),
c AS (SELECT user_id, asked, min(us) AS us, arg_min(event_id, (us, event_id)) AS event_id FROM r GROUP BY 1, 2
  UNION ALL SELECT x.user_id, x.asked, x.us, x.event_id FROM (SELECT r.*, row_number() OVER (PARTITION BY r.user_id, r.asked ORDER BY r.us, r.event_id) AS nth FROM c JOIN r ON r.user_id = c.user_id AND r.asked = c.asked AND r.us > c.us + 86400000000) x WHERE x.nth = 1)
SELECT r.user_id, r.event_id AS request, c.event_id <> r.event_id AS hit, c.event_id AS computed_by
FROM r JOIN c ON c.user_id = r.user_id AND c.asked = r.asked AND r.us BETWEEN c.us AND c.us + 86400000000""")
def cached_results(spark, sf_dir):
    """Each user's cache of at most a hundred answers that serve for a day: hits, and which request computed the answer."""
    asked = stateful.file_stream(spark, sf_dir, "events").withColumn("asked", F.get_json_object("props", "$.k"))
    return stateful.run_available(traces.cached(asked, "user_id", "asked", "event_id", "ts", "1 day"), keyed=True)


@query()
def incremental_index(spark, sf_dir):
    """Documents that an index takes up as they come, and those it skips as copies at 0.92 of what it holds."""
    docs = stateful.file_stream(spark, sf_dir, "documents").select("doc_id", "text")
    told = incremental.index_stream(docs, "doc_id", "text", text.shingle_hashes(F.coalesce("text", F.lit(""))), 0.92)
    return told.select(F.col("id").alias("doc_id"), "duplicate_of")
