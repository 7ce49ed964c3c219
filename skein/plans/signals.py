"""Overlapping recordings, choice by coverage, weighted scores, nested score windows, stretches of speech."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import speech
from skein.operators import coverage, intervals, lookback, trees
from skein.plans.intervals import _HOUR, _SPAN, _intervals
from skein.plans.registry import dealt, query, table

#: Frames a second of the recordings that stand for documents: a frame of 30 samples for each character.
_RATE = 1000


@query()
def overlap_duplicates(spark, sf_dir):
    """Spans of a room that mostly overlap one of the thirty last kept of the other direction."""
    spans = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("room"), F.col("event_type").isin("view", "click").alias("inward"), F.unix_micros("ts").alias("a"), "value")
    spans = spans.withColumn("b", F.col("a") + F.round(F.col("value") * 120e6).cast("long"))
    marked = lookback.mark_overlaps(spans, "room", "event_id", "inward", "a", "b", 24 * _HOUR)
    return marked.select(F.col("id").alias("event_id"), "duplicate_of")


QUOTAS = {"asks": 30, "long": 40, "short": 15, "mail": 10, "de": 20, "en": 20, "es": 20, "fr": 20, "quoted": 15, "number": 25}


def tags_of_documents() -> Column:
    text = F.coalesce("text", F.lit(""))
    found = [(F.contains(text, F.lit("?")), "asks"), (F.length(text) > 3000, "long"), (F.length(text) < 120, "short"), (F.contains(text, F.lit("@")), "mail"), (F.contains(text, F.lit('"')), "quoted"), (text.rlike("[0-9]"), "number")]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in found], F.col("lang")))


@query()
def coverage_ranking(spark, sf_dir):
    """The first 120 documents of a choice that fills the quotas of ten tags; those with addresses last once there are enough."""
    tagged = table(spark, sf_dir, "documents").select("doc_id", tags_of_documents().alias("tags"))
    return coverage.rank_by_coverage(tagged, "doc_id", "tags", QUOTAS, 120, "mail").withColumnRenamed("id", "doc_id")


@query(f"""
WITH {_SPAN}, t AS (SELECT event_id AS target_id, user_id, a AS ta, a + {12 * _HOUR} AS tb FROM iv WHERE event_type = 'purchase'),
w AS (SELECT user_id, a AS wa, b AS wb, event_id, unnest([['kind ' || event_type, '0.5'], ['odd', CASE WHEN event_id % 2 = 1 THEN '0.25' ELSE '0.75' END]]) AS s FROM iv WHERE event_type IN ('view', 'error')),
m AS (SELECT target_id, event_id, s[1] AS name, CAST(s[2] AS DOUBLE) AS score, CASE WHEN wb IS NULL THEN 1.0 ELSE CAST(least(wb, tb) - greatest(wa, ta) AS DOUBLE) END AS weight
  FROM t JOIN w USING (user_id) WHERE wb IS NULL OR (wa < tb AND wb > ta)),
total AS (SELECT target_id, sum(weight) / 2 AS total FROM m GROUP BY 1),
x AS (SELECT target_id, name, sum(score * weight) / any_value(total) AS score FROM m JOIN total USING (target_id) GROUP BY 1, 2),
f AS (SELECT user_id, arg_min(event_id, wa) AS event_id FROM w WHERE wb IS NOT NULL GROUP BY 1),
y AS (SELECT target_id, s[1] AS name, CAST(s[2] AS DOUBLE) AS score FROM t JOIN f USING (user_id) JOIN w ON w.event_id = f.event_id WHERE target_id NOT IN (SELECT target_id FROM total)),
z AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, name) AS place FROM (SELECT * FROM x UNION ALL SELECT * FROM y))
SELECT target_id, name, round(score, 6) AS score, CAST(place AS BIGINT) AS place FROM z WHERE place <= 2 AND score >= 0.2""")
def weighted_window_scores(spark, sf_dir):
    """For twelve hours from each purchase the two highest mean scores of the spans in them, by time; without any, the user's first span's."""
    scored = F.array(F.struct(F.concat(F.lit("kind "), "event_type").alias("name"), F.lit(0.5).alias("score")), F.struct(F.lit("odd").alias("name"), F.when(F.col("event_id") % 2 == 1, 0.25).otherwise(0.75).alias("score")))
    iv = _intervals(spark, sf_dir, open_ends=True)
    windows = iv.where("event_type in ('view', 'error')").select("user_id", F.col("a").alias("wa"), F.col("b").alias("wb"), scored.alias("scores"))
    targets = iv.where("event_type = 'purchase'").select(F.col("event_id").alias("target_id"), "user_id", "a", (F.col("a") + 12 * _HOUR).alias("b"))
    found = intervals.weighted_scores(targets, windows, "user_id", "target_id", 24 * _HOUR, 2, 0.2)
    return found.select("target_id", "name", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


_NESTED = """{"user": %d, "told": [{"time": {"begin": %d, "end": "%d"}, "models": {"prosody": {"scores": {"calm": %s, "bold": "1.5", "": 1, "bad": "x"}}}}, {"deep": [[{"start": %d, "emotions": [{"label": "odd", "score": %s}, {"name": "bare"}, {"score": 1}, 7]}], "text"]}]}"""


@query("""
WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS u FROM events)
SELECT event_id, path, 'scores' AS kind, CASE WHEN path = 'told.0' THEN u END::DOUBLE AS begin_s, CASE WHEN path = 'told.0' THEN u + k END::DOUBLE AS end_s, unnest(['bold', 'calm']) AS name, unnest([1.0, k / 100.0::DOUBLE])::DOUBLE AS score, unnest([1, 2])::BIGINT AS place
FROM k, (VALUES ('told.0'), ('told.0.models')) AS places(path)
UNION ALL SELECT event_id, 'told.1.deep.0.0', 'emotions', k::DOUBLE, NULL, unnest(CASE WHEN k > 0 THEN ['odd', 'bare'] ELSE ['bare', 'odd'] END), unnest([k / 200.0::DOUBLE, 0.0])::DOUBLE, unnest([1, 2])::BIGINT FROM k""")
def nested_score_windows(spark, sf_dir):
    """Named scores out of nested answers made of the events' properties, wherever they stand; an inner object that has them counts too."""
    k, u = F.get_json_object("props", "$.k").cast("long"), F.col("user_id")
    events = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "event_id")
    made = events.select("event_id", F.format_string(_NESTED, u, u, u + k, (k / 100.0).cast("string"), k, (k / 200.0).cast("string")).alias("told"))
    found = trees.score_windows(trees.walk(made.select("event_id", F.parse_json("told").alias("told")), "event_id", "told"), "event_id")
    return found.select("event_id", "path", "kind", F.col("begin").alias("begin_s"), F.col("end").alias("end_s"), "name", "score", F.col("place").cast("long").alias("place"))


_LOUD = np.zeros(128, bool)
_LOUD[[*b"bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ"]] = True


def recording_of(text: str) -> bytes:
    """A document as a WAV of 16-bit samples: a frame of a loud tone for each consonant, quiet for anything else, and long quiet at line ends."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    loud = _LOUD[np.where(points < 128, points, 0)]
    frames = np.repeat(loud, np.where(points == 10, 25, 1))
    data = np.repeat(np.where(frames, 0x7878, 0).astype("<i2"), 30).tobytes()
    form = b"WAVEfmt " + b"".join(n.to_bytes(size, "little") for n, size in ((16, 4), (1, 2), (1, 2), (_RATE, 4), (2 * _RATE, 4), (2, 2), (16, 2))) + b"data"
    return b"RIFF" + (len(data) + 36).to_bytes(4, "little") + form + len(data).to_bytes(4, "little") + data


def _speech(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, *x) for i, text in enumerate(batch.column("text")) for x in speech.parts_of(recording_of(text.as_py() or ""))]
        row, part, start, end = (np.array(x) for x in zip(*found)) if found else [np.zeros(0)] * 4
        columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(part, pa.int32()), pa.array(start, pa.float64()), pa.array(end, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start_s", "end_s"])


@query()
def speech_segments(spark, sf_dir):
    """Stretches of speech in recordings made of whole documents; a recording is sixty times its text, so it is made where it is heard."""
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    found = docs.mapInArrow(_speech, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, start_s double, end_s double")
    return found.select("doc_id", "part", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))
