"""Intervals, islands, orders and roll-ups over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import intervals
from skein.plans.registry import query, table

_SPAN = "iv AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS a, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS b FROM events)"
_HOUR = 3_600_000_000


def _intervals(spark, sf_dir, open_ends=False):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros("ts").alias("a"), F.unix_micros(F.lead("ts").over(w)).alias("b"))
    return spans if open_ends else spans.where("b is not null")


@query(f"""WITH {_SPAN}, w AS (SELECT event_id AS window_id, user_id, a AS wa, a + {6 * _HOUR} AS wb FROM iv WHERE event_type = 'purchase' AND b IS NOT NULL)
SELECT w.window_id, count(*) AS n, CAST(sum(least(iv.b, w.wb) - greatest(iv.a, w.wa)) AS BIGINT) AS overlap_us FROM w JOIN iv ON iv.user_id = w.user_id AND iv.b IS NOT NULL AND iv.a <= w.wb AND iv.b >= w.wa GROUP BY 1""")
def interval_overlap_join(spark, sf_dir):
    """Spans between events that overlap the six hours from a purchase; closed bounds."""
    iv = _intervals(spark, sf_dir)
    windows = iv.where("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), "user_id", F.col("a").alias("wa"), (F.col("a") + 6 * _HOUR).alias("wb"))
    met = intervals.overlap_join(windows, iv, "user_id", 24 * _HOUR)
    return met.groupBy("window_id").agg(F.count("*").alias("n"), F.sum("overlap").alias("overlap_us"))


@query(f"""WITH {_SPAN}, w AS (SELECT event_id AS window_id, user_id, a AS wa, a + {12 * _HOUR} AS wb FROM iv WHERE event_type = 'purchase' AND b IS NOT NULL)
SELECT w.window_id, round(sum(iv.value * (least(iv.b, w.wb) - greatest(iv.a, w.wa))) / sum(least(iv.b, w.wb) - greatest(iv.a, w.wa)), 6) AS mean_value
FROM w JOIN iv ON iv.user_id = w.user_id AND iv.b IS NOT NULL AND iv.a < w.wb AND iv.b > w.wa GROUP BY 1""")
def overlap_weighted_mean(spark, sf_dir):
    """The mean value over a window, weighted by the time of overlap."""
    iv = _intervals(spark, sf_dir)
    windows = iv.where("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), "user_id", F.col("a").alias("wa"), (F.col("a") + 12 * _HOUR).alias("wb"))
    met = intervals.overlap_join(windows, iv, "user_id", 24 * _HOUR).where("overlap > 0")
    return met.groupBy("window_id").agg(F.round(F.sum(F.col("value") * F.col("overlap")) / F.sum("overlap"), 6).alias("mean_value"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS change FROM conversations),
i AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, CAST(island AS BIGINT) AS island, role, min(turn) AS first_turn, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM i GROUP BY 1, 2, 3""")
def speaker_turn_islands(spark, sf_dir):
    """Runs of turns by one speaker."""
    islands = intervals.islands(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return islands.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY sha256(event_id::VARCHAR)) AS lap FROM events")
def round_robin_order(spark, sf_dir):
    """Laps that take one row of each day in turn: order by (lap, sha256(day))."""
    day = F.to_date("ts")
    lap = F.row_number().over(Window.partitionBy(day).orderBy(F.sha2(F.col("event_id").cast("string"), 256)))
    return table(spark, sf_dir, "events").select("event_id", day.cast("string").alias("day"), lap.cast("long").alias("lap"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE nth IN (SELECT i * n // 5 FROM range(0, 5) t(i))")
def even_sample(spark, sf_dir):
    """Five rows of each user, evenly spaced in time."""
    return intervals.evenly_spaced(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


@query("""
SELECT user_id, CAST(epoch_us(ts) // 600000000 AS BIGINT) AS bucket, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(event_type))), 1, 30), ',') AS kinds, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def bucket_rollup_10min(spark, sf_dir):
    """Ten-minute buckets of each user, with the sorted distinct kinds of event."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 30), ",").alias("kinds"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.floor(F.unix_micros("w.start") / 600_000_000).cast("long").alias("bucket"), "n", "kinds", "total")


@query(f"""SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, {text.set_fingerprint_sql("(turn || ':' || role || ': ' || text)")} AS transcript_sha256 FROM conversations GROUP BY conv_id""")
def meeting_rollup(spark, sf_dir):
    """One row for each conversation: span, speakers, and a fingerprint of the numbered turns; a long conversation is in no one task."""
    said = F.concat(F.col("turn").cast("string"), F.lit(":"), "role", F.lit(": "), "text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), text.set_fingerprint(said).alias("transcript_sha256"))


@query("""
WITH w AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents)
SELECT doc_id, u.start, least(350, n - u.start) AS length FROM w, LATERAL (SELECT unnest(range(0, n, 350)) AS start) u""")
def paragraph_chunks(spark, sf_dir):
    """Cuts of 350 words."""
    from skein.functions.text import word_count

    rows = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n")).where("n > 0")
    return rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(350).cast("long"))).alias("start")).select("doc_id", "start", F.least(F.lit(350).cast("long"), F.col("n") - F.col("start")).alias("length"))
