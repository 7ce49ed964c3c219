"""Readers over small files."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from skein.sources import readers


def test_strict_json_lines(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": null}\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(good), "id long, t string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    for bad in ('{"id": 1, "extra": 2}', "{broken"):
        path = tmp_path / "b.jsonl"
        path.write_text(bad + "\n")
        with pytest.raises(Exception, match="unknown fields|not a JSON object"):
            readers.read_jsonl(spark, str(path), "id long, t string").collect()


def test_inventory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "skip").mkdir()
    for name, text in (("in/a.jsonl", "two words 2024-01-05 then 2024-02-01"), ("in/b.jsonl", "two words 2024-01-05 then 2024-02-01"), ("skip/c.jsonl", "x")):
        (tmp_path / name).write_text(text)
    found = readers.included_once(readers.file_inventory(spark, str(tmp_path), exclude_parts=["skip"])).orderBy("path").collect()
    assert [r.exclude_reason for r in found] == [None, "duplicate_content", "excluded_path"]
    assert found[0].word_count == 5 and found[0].date_start == datetime.date(2024, 1, 5) and found[0].date_end == datetime.date(2024, 2, 1)
    manifest = spark.createDataFrame([tuple(r) for r in readers.file_inventory(spark, str(tmp_path)).select("path", "sha256").collect()], "path string, sha256 string")
    assert readers.unchanged(manifest, readers.file_inventory(spark, str(tmp_path))).count() == 3
    (tmp_path / "in/a.jsonl").write_text("changed")
    with pytest.raises(Exception, match="source changed"):
        readers.unchanged(manifest, readers.file_inventory(spark, str(tmp_path))).collect()


def test_chat_log(spark):
    rows = [json.dumps({"role": "user", "text": "<context>auto</context> hello there"}), json.dumps({"role": "user", "text": "pre <query> the question </query> post"}), json.dumps({"role": "assistant", "text": "no"}), "{broken", json.dumps({"role": "user", "text": "Summary of all"})]
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "path string, at int, value string")
    got = readers.chat_log(df).orderBy("at").collect()
    assert [(r.text, r.malformed) for r in got] == [("hello there", False), ("the question", False), (None, True)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# 2024-03-01\none two\nthree\n\nfour\n# 2024-03-02\n" + " ".join(str(i) for i in range(8)))
    got = readers.transcript_paragraphs(readers.numbered_lines(spark, str(tmp_path)), 5).orderBy("paragraph", "part").collect()
    assert [(str(r.day), r.text) for r in got] == [("2024-03-01", "one two three"), ("2024-03-01", "four"), ("2024-03-02", "0 1 2 3 4"), ("2024-03-02", "5 6 7")]


def test_envelopes_and_recordings(spark, tmp_path):
    payload = {"channels": [{"alternatives": [{"transcript": "a b", "words": [{"word": "a", "start": 0.0, "end": 0.5, "confidence": 0.5, "speaker": 1}, {"word": "b", "start": 0.5, "end": 1.0, "confidence": 1.0, "speaker": 0}]}]}]}
    df = spark.createDataFrame([(json.dumps(payload),), ('{"channels": []}',)], "p string").select(readers.transcript_envelope(F.col("p")).alias("e"))
    first, second = [r.e for r in df.collect()]
    assert first.text == "a b" and first.confidence_mean == 0.75 and first.confidence_min == 0.5 and first.speaker_ids == [0, 1] and second is None
    (tmp_path / "mic_input_20240105T101112.wav").write_bytes(b"RIFF")
    (tmp_path / "other.wav").write_bytes(b"RIFF")
    found = readers.named_recordings(spark, str(tmp_path)).collect()
    assert [(r.device, r.direction, str(r.started_at)) for r in found] == [("mic", "input", "2024-01-05 10:11:12")]
    assert [r.id for r in readers.recent(spark.range(50), ["id"], 3).collect()] == [47, 48, 49]


def test_writers(spark, tmp_path):
    from skein.sources import writers

    base = str(tmp_path)
    writers.publish(spark.range(3), base, "t")
    writers.publish(spark.range(5), base, "t")
    assert writers.read_published(spark, base, "t").count() == 5 and writers.published(spark, base, "t").count() == 2
    traces = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c")], "session int, turn int, v string")
    writers.append_traces(traces, f"{base}/traces", ["session", "turn"])
    writers.append_traces(traces, f"{base}/traces", ["session", "turn"])
    assert spark.read.parquet(f"{base}/traces").count() == 2
    writers.write_jsonl(spark.createDataFrame([(1, None)], "id int, t string"), f"{base}/j")
    assert readers.read_jsonl(spark, f"{base}/j", "id int, t string").first().id == 1


def test_paged_search(spark):
    from skein.sources.paged import paged_search

    def fetch(query, offset, limit):
        rows = [(i, f"{query} {i}") for i in range(120 if query == "a" else 50)]
        return rows[offset : offset + limit]

    got = paged_search(spark, ["a", "b"], fetch, "id long, text string", "id", 1000)
    assert got.count() == 120
