"""Reliability and latency reports over the event log.

Local stand-ins: event_type is a status, user_id a source, value a duration or score, props a JSON payload.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import percentiles
from skein.plans.registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _nonempty(column: str):
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("unknown"))


@query("SELECT coalesce(nullif(trim(event_type), ''), 'unknown') AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(_nonempty("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type AS status, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY 1, 2")
def status_by_source(spark, sf_dir):
    counts = _events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6))


@query("""
SELECT event_type, CAST(sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_success, CAST(sum(CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_failure,
  round(coalesce(sum(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN k % 3 < 2 THEN 1 ELSE 0 END), 0), 0.0), 6) AS success_rate
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)) GROUP BY event_type""")
def json_step_outcomes(spark, sf_dir):
    """Outcomes inside a JSON payload; other values than the two outcomes don't count."""
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    rows = _events(spark, sf_dir).withColumn("k", k)
    good, bad = F.count_if(F.col("k") % 3 == 0), F.count_if(F.col("k") % 3 == 1)
    return rows.groupBy("event_type").agg(good.alias("n_success"), bad.alias("n_failure"), F.round(F.coalesce(F.try_divide(good, good + bad), F.lit(0.0)), 6).alias("success_rate"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN json_valid(props) THEN 0 ELSE 1 END) AS BIGINT) AS n_malformed FROM (SELECT CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS props FROM events)")
def malformed_json_count(spark, sf_dir):
    """Every seventh payload is broken on purpose; broken ones are counted, not raised."""
    broken = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return _events(spark, sf_dir).select(F.try_parse_json(broken).alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_malformed"))


@query("""
WITH p AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type, us - before AS gap_us FROM p WHERE us - before BETWEEN 0 AND 600000000""")
def retry_candidates(spark, sf_dir):
    """The same source and status again within ten minutes."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _events(spark, sf_dir).withColumn("us", F.unix_micros("ts")).withColumn("before", F.last("us", ignorenulls=True).over(w))
    return rows.where((F.col("us") - F.col("before")).between(0, 600_000_000)).select("event_id", "user_id", "event_type", (F.col("us") - F.col("before")).alias("gap_us"))


_PHASE = "WITH p AS (SELECT event_type AS status, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS seconds FROM events)"


def _phases(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).select(F.col("event_type").alias("status"), ((F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")) / 1e6).alias("seconds")).where("seconds >= 0")


@query(_PHASE + " SELECT status, count(*) AS n, round(quantile_cont(seconds, 0.5), 3) AS p50, round(quantile_cont(seconds, 0.95), 3) AS p95 FROM p WHERE seconds >= 0 GROUP BY status")
def phase_latency(spark, sf_dir):
    """How long each status lasts: until the next event of the same source."""
    return percentiles.linear(_phases(spark, sf_dir), "status", "seconds", {"p50": 0.5, "p95": 0.95}).select("status", "n", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    """Linear interpolation."""
    found = percentiles.linear(_events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank_percentiles(spark, sf_dir):
    return percentiles.nearest(_events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p95": 0.95}).drop("n")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN nth = CAST(round_even((n - 1) * 0.25, 0) AS BIGINT) + 1 THEN value END) AS q25, max(CASE WHEN nth = CAST(round_even((n - 1) * 0.75, 0) AS BIGINT) + 1 THEN value END) AS q75
FROM r GROUP BY event_type""")
def rounded_index_percentiles(spark, sf_dir):
    """The value at the half-even rounded index (n - 1) * q."""
    return percentiles.rounded(_events(spark, sf_dir), "event_type", "value", {"q25": 0.25, "q75": 0.75}).drop("n")


@query("SELECT CASE WHEN contains(p_type, 'STEEL') THEN 'steel' ELSE coalesce(nullif(lower(split_part(p_type, ' ', 1)), ''), 'unknown') END AS program, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY 1")
def program_bucket(spark, sf_dir):
    """A bucket from the first rule that applies, then counts: the catalog stands in for programs."""
    program = F.when(F.contains("p_type", F.lit("STEEL")), F.lit("steel")).otherwise(F.coalesce(F.nullif(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("")), F.lit("unknown")))
    return table(spark, sf_dir, "part").groupBy(program.alias("program")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


@query("""
WITH p AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, event_type AS status, count(*) AS n FROM p
WHERE before IS NOT NULL AND NOT list_contains(['signup>view', 'view>click', 'click>purchase', 'view>view', 'click>view', 'purchase>view', 'error>view', 'view>error', 'click>error'], before || '>' || event_type) GROUP BY 1, 2""")
def state_transition_violations(spark, sf_dir):
    """Steps from one status to the next that the table of legal ones doesn't have."""
    legal = ["signup>view", "view>click", "click>purchase", "view>view", "click>view", "purchase>view", "error>view", "view>error", "click>error"]
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).withColumn("before", F.lag("event_type").over(w)).where("before is not null")
    return rows.where(~F.concat("before", F.lit(">"), "event_type").isin(legal)).groupBy("before", F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, min(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) AS viewed, min(CASE WHEN event_type = 'click' THEN epoch_us(ts) END) AS clicked, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT day, CASE WHEN clicked >= viewed THEN (clicked - viewed) / 1000000.0 END AS seconds FROM t)
SELECT CAST(day AS VARCHAR) AS day, count(seconds) AS n, round(quantile_disc(seconds, 0.5)::DOUBLE, 3) AS p50, round(quantile_disc(seconds, 0.95)::DOUBLE, 3) AS p95, count(seconds) >= 20 AS ready FROM m GROUP BY day""")
def turn_trace_quality(spark, sf_dir):
    """Traces of a source and day: the time from one named mark to another, then nearest-rank percentiles and readiness."""
    mark = lambda kind: F.min(F.when(F.col("event_type") == kind, F.unix_micros("ts")))
    traces = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(mark("view").alias("viewed"), mark("click").alias("clicked"))
    rows = traces.select(F.col("day").cast("string").alias("day"), F.when(F.col("clicked") >= F.col("viewed"), (F.col("clicked") - F.col("viewed")) / 1e6).alias("seconds"))
    counts = rows.groupBy("day").agg(F.count("seconds").alias("n"), (F.count("seconds") >= 20).alias("ready"))
    found = percentiles.nearest(rows, "day", "seconds", {"p50": 0.5, "p95": 0.95}).select("day", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))
    return counts.join(found, "day", "left")


@query("SELECT (SELECT count(*) FROM events) = (SELECT sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) AS reconciled, (SELECT count(*) FROM events) AS n_rows, (SELECT count(DISTINCT user_id) FROM events) AS n_sources")
def reconciliation(spark, sf_dir):
    """Two independent aggregates agree: all rows, and the sum of the counts by status."""
    events = _events(spark, sf_dir)
    whole = events.agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_sources"))
    parts = events.groupBy("event_type").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"))
    return whole.join(parts, F.lit(True)).select((F.col("n_rows") == F.col("total")).alias("reconciled"), "n_rows", "n_sources")
