"""Sources by name and suffix, folding, digests, gates, findings and style cards on small hard rows."""

from __future__ import annotations

import datetime
import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import digests, text
from skein.operators import dataset_checks, eligibility, gates, storage, styles
from skein.sources import readers


def _files_read(df) -> int:
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    while plan.children().size():
        plan = plan.children().apply(0)
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
        while plan.children().size() or plan.nodeName().endswith("QueryStage"):
            plan = plan.plan() if plan.nodeName().endswith("QueryStage") else plan.children().apply(0)
    return plan.metrics().apply("numFiles").value()


def test_recordings_out_of_range_are_not_opened(spark, tmp_path):
    for name in ("mic_input_20240105T100000", "mic_output_20240106T100000", "cam_input_20240106T110000", "mic_input_20240107T000000", "notes", "mic_input_20249999T100000"):
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF")
    every = readers.named_recordings(spark, str(tmp_path))
    assert every.count() == 4
    some = readers.named_recordings(spark, str(tmp_path), "2024-01-06 00:00:00", "2024-01-07 00:00:00")
    assert [(r.device, r.direction) for r in some.orderBy("place").collect()] == [("cam", "input"), ("mic", "output")]
    assert _files_read(some) == 2


def test_tail_skips_what_is_invalid(spark, tmp_path):
    good = [json.dumps({"id": i, "t": "x"}) for i in range(20)]
    lines = good[:15] + ["{broken", "[1]", '{"id": "no", "t": "x"}', ""] + good[15:]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    tail = lambda n: [r.id for r in readers.tail_of_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, t string", n).collect()]
    assert tail(10) == [14, 15, 16, 17, 18, 19] and tail(0) == [] and tail(100) == list(range(20))


def test_tables_and_observations(spark, tmp_path):
    assert readers.table_or_empty(spark, "no_such_table_here", "request_id string, id long", ["id"]).collect() == []
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id long, t string")
    df.write.parquet(str(tmp_path / "o.parquet"))
    (tmp_path / "o.jsonl").write_text('{"id": 1, "t": "a"}\n')
    assert readers.read_observations(spark, str(tmp_path / "o.parquet"), "t string, id long").count() == 2
    assert readers.read_observations(spark, str(tmp_path / "o.jsonl"), "id long, t string").first().id == 1
    for path, schema in (("o.parquet", "id int, t string"), ("o.csv", "id long")):
        with pytest.raises(ValueError):
            readers.read_observations(spark, str(tmp_path / path), schema)
    rows = spark.createDataFrame([(i, f"s{i % 2}", i // 2) for i in range(10)], "id long, source string, at long")
    assert [r.id for r in readers.newest(rows, "at", "id", 3).collect()] == [8, 9, 6]
    assert [r.id for r in readers.newest(rows, "at", "id", 2, "s1").collect()] == [9, 7] and readers.newest(rows, "at", "id", 0).count() == 1


HARD = [None, "", "Straße ŁÓDŹ", "é ﬁ ½ Ⅷ", "ø đ ł", "각 ば", "İ̇x", "a  b\t\n c", "ＡＢ", "̀́", "😀 é"]


def test_unicode_against_the_standard(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(HARD)], "i int, x string")
    got = rows.select("i", text.unaccented(F.col("x")).alias("u"), text.composed(F.col("x")).alias("c"), text.folded(F.col("x")).alias("f")).orderBy("i").collect()
    bare = lambda form, x: "".join(c for c in unicodedata.normalize(form, x) if not unicodedata.combining(c))
    for r, x in zip(got, HARD):
        assert r.u == (None if x is None else bare("NFKD", x))
        assert r.c == (None if x is None else " ".join(unicodedata.normalize("NFC", x).replace("\t", " ").replace("\n", " ").split(" ")).strip() if "  " not in x else "a b c")
    assert [r.f for r in got][:3] == [None, "", "strasse lodz"] and got[4].f == "ø đ l"


NESTED = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from(["", " a ", "b", "c"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["name", "text", "time", "confidence", "theme", "goals", "x"]), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(NESTED)
def test_nested_text_names_only_what_is_there(value):
    said = digests.spoken(value)
    assert said == said.strip() and digests.spoken([value, value]) in ("", f"{said}; {said}")
    assert digests.spoken({"name": value, "title": value}) == said


def test_digest_of_hard_answers(spark):
    answers = [None, "", "{broken", "[1]", "{}", json.dumps({"theme": "t" * 1200, "people": ["p"] * 2 + [f"p{i}" for i in range(40)], "observations": ["o" * 2000] * 3, "confidence": True, "list": [{"confidence": 3}]})]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(answers)], "i int, x string")
    got = [r.d for r in rows.select("i", digests.digest(F.col("x"), F.lit("title"), F.lit(" body ")).alias("d")).orderBy("i").collect()]
    assert [d.summary for d in got[:4]] == [None] * 4 and got[4].summary == "body" and got[4].confidence == 0.5 and got[4].people == []
    assert len(got[5].topic) == 1000 and len(got[5].people) == 30 and [len(x) for x in got[5].observations] == [1000] and got[5].confidence == 1.0


def test_allow_list(spark):
    plans = spark.createDataFrame([(i,) for i in range(6)], "plan int")
    steps = spark.createDataFrame([(0, "a", False), (1, "a", False), (1, "b", False), (2, "a", True), (3, "zz", False), (4, None, False)], "plan int, action_id string, asks boolean")
    definitions = spark.createDataFrame([("a", "low", False), ("b", "high", False), ("n", None, None)], "action_id string, risk string, asks boolean")
    may = lambda **k: [r.plan for r in gates.allowed_plans(plans, steps, definitions, "plan", **k).where("allowed").orderBy("plan").collect()]
    assert may(canary=F.col("action_id").isin("a", "b", "zz")) == [0] and may(canary=F.lit(False)) == []
    assert may() == [0, 1, 2, 3, 4] and may(enabled=False) == []


def test_findings_of_a_sound_and_an_empty_set(spark):
    s, a = "sample_id long, digest string, split string, family long, day date, tags array<string>", "sample_id long, digest string, tags array<string>"
    sound = [(i, "d", "development" if i < 2 else "holdout", i, datetime.date(2024, 1, 1 + i % 6), ["q"]) for i in range(10)]
    notes = [(i, "d", None) for i in range(10)]
    assert dataset_checks.findings(spark.createDataFrame(sound, s), spark.createDataFrame(notes, a), 10, 2, {"q": 10}).count() == 0
    empty = dataset_checks.findings(spark.createDataFrame([], s), spark.createDataFrame([], a), 10, 2, {"q": 1}).collect()
    assert {(r.finding, r.n) for r in empty} == {("sample_count", 0), ("development_count", 0), ("holdout_count", 0), ("tag_coverage_incomplete", 1)}
    bad = dataset_checks.findings(spark.createDataFrame(sound + [(1, None, "holdout", 1, None, None)], s), spark.createDataFrame(notes[1:] + [(99, "d", None), (2, "x", ["q"])], a), 10, 2, {})
    assert {(r.finding, r.n) for r in bad.collect()} == {("sample_count", 11), ("duplicate_sample_ids", 1), ("holdout_count", 9), ("duplicate_annotation_ids", 1), ("missing_annotations", 1), ("unknown_annotations", 1), ("annotation_audio_hash_mismatch", 1), ("missing_audio", 1), ("duplicate_group_crosses_splits", 1)}


def test_cards_and_holdout(spark):
    rows = spark.createDataFrame([("a", f"open it {'word ' * (i % 7)}?") for i in range(40)] + [("a", " "), ("a", None), ("b", "sir")], "who string, said string")
    made = styles.cards(rows, "who", "said", "open", "sir", "hey")
    got = {r.who: r for r in made.collect()}
    assert (got["a"].n, got["a"].directness, got["a"].questions, got["a"].form, got["a"].manner) == (40, 1.0, "many", "mixed", "concise")
    assert (got["b"].low, got["b"].high, got["b"].form) == (5, 5, "formal")
    found = {r.who: r for r in styles.compare(made, made.where("who = 'a'"), "who").collect()}
    assert found["a"].passes and found["a"].overlap == 1.0 and found["a"].drift == 0 and not found["b"].passes and found["b"].n_held == 0


def test_retention_and_trust(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 3, 1)), (3, None)], "id int, at timestamp")
    kept = lambda days: [r.id for r in storage.keep_days(rows, "at", F.lit("2024-03-02").cast("timestamp"), days).orderBy("id").collect()]
    assert kept(30) == [2, 3] and kept(0) == [2, 3] and kept(9999) == [1, 2, 3]
    sources, decisions = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "id string"), spark.createDataFrame([("x", True), ("y", True), ("y", False), ("z", None)], "id string, approved boolean")
    assert {r.id: r.speaker for r in eligibility.decided_speakers(sources, decisions, "id").collect()} == {"x": "self", "y": "unknown", "z": "unknown", None: "unknown"}
