"""Small cases with known results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import privacy, text
from skein.operators import calibration, dedup, graph, intervals, splits, storage


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_text_metrics(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, text.character_error_rate(a, b), a="café", b="cafe") == 0.25
    assert one(spark, text.word_error_rate(a, b), a="a b c d", b="a x c") == 0.5
    assert one(spark, text.word_error_rate(a, b), a="", b="") == 0.0
    assert one(spark, text.word_error_rate(a, b), a="", b="x") == 1.0
    assert one(spark, text.punctuation_f1(a, b), a="Well, is it?", b="Well, is it") < 1.0
    assert one(spark, text.punctuation_f1(a, b), a="x", b="y") == 1.0
    assert one(spark, text.shingles(a, 5), a="1 2 3 4 5 6") == ["1 2 3 4 5", "2 3 4 5 6"]
    assert one(spark, text.shingles(a, 5), a="1 2") == []
    assert one(spark, text.normalize(a), a="Ça, c'est  Été!") == "ca  c est  ete"
    assert one(spark, text.uuid5("6ba7b8109dad11d180b400c04fd430c8", a), a="python.org") == "886313e1-3b8a-5372-9b90-0c9aee199e5d"


def test_redaction(spark):
    digits = [1, 2, 3, 4, 5, 6, 7, 8, 9, 0]
    check = (10 - sum(d * w for d, w in zip(digits, privacy.CHECK_WEIGHTS)) % 10) % 10
    good, bad = "1234567890" + str(check), "1234567890" + str((check + 1) % 10)
    rows = spark.createDataFrame([(1, "mail me at a.b@example.org now"), (2, f"number {good}"), (3, f"number {bad}"), (4, None)], "id int, text string")
    got = {r.id: r for r in privacy.redacted(rows).collect()}
    assert got[1].clean == "mail me at [EMAIL] now" and got[1].flags == ["email"]
    assert got[2].clean == "number [ID]" and got[2].flags == ["checksum_id"]
    assert got[3].flags == [] and got[4].clean == ""
    kept, out = privacy.gate(rows.withColumn("who", F.lit("self")), "who")
    assert {r.id for r in kept.collect()} == {1, 3}
    assert "text" not in out.columns and {r.reason for r in out.collect()} == {"high_risk_id", "empty"}
    twice = privacy.redacted(kept.drop("flags"))
    assert all(r.clean == r.text for r in twice.collect())


def test_exact_and_near_duplicates(spark):
    rows = spark.createDataFrame([(3, "b"), (2, "a"), (1, "a")], "id long, t string")
    assert {(r.id, r.t) for r in dedup.first_of_each(rows, F.col("t"), "id").collect()} == {(1, "a"), (3, "b")}
    base = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(base)), (2, " ".join([*base[:-1], "z"])), (3, " ".join([*base[:-2], "z", "y"])), (4, "other words entirely here now"), (5, " ".join(base))]
    sets = spark.createDataFrame(texts, "id long, t string").select("id", text.shingles(F.col("t")).alias("tokens"))
    pairs = dedup.similar_pairs(sets, 0.88)
    want = {}
    shingled = {r.id: set(r.tokens) for r in sets.collect() if r.id != 5}
    for a in shingled:
        for b in shingled:
            if a < b and (j := len(shingled[a] & shingled[b]) / len(shingled[a] | shingled[b])) >= 0.88:
                want[a, b] = j
    assert {(r.a, r.b): r.jaccard for r in pairs.collect()} == pytest.approx(want)
    chain = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95)], "a long, b long, jaccard double")
    kept = dedup.greedy_keepers(spark.range(1, 5), chain)
    assert {r.id: r.duplicate_of for r in kept.collect()} == {1: None, 2: 1, 3: None, 4: None}
    short = spark.createDataFrame([(1, "open the big door now"), (2, "open the big door"), (3, "sing")], "id long, text string")
    assert [(r.a, r.b) for r in dedup.similar_short_texts(short, 0.6, 0.82).collect()] == [(1, 2)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 11: 10, 12: 10} | {101 + i: 100 for i in range(40)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_calibration(spark):
    rows = [(i / 99, float(i > 40)) for i in range(100)] + [(0.5, 1.0), (0.5, 0.0)] * 10
    df = spark.createDataFrame(rows, "p double, y double")
    back = spark.createDataFrame(rows[::-1], "p double, y double")
    assert calibration.ece_equal_mass(df).first() == calibration.ece_equal_mass(back).first()
    fit = calibration.platt_fit(df).first()
    assert fit.slope > 0 and fit.steps < 50
    falling = df.select("p", (1 - F.col("y")).alias("y"))
    assert calibration.platt_fit(falling).first().slope == 0
    free = calibration.platt_fit(falling, least_slope=float("-inf")).first()
    assert abs(free.slope + fit.slope) < 1e-6 and abs(free.intercept + fit.intercept) < 1e-6
    few = df.withColumn("group", F.lit(1))
    assert calibration.bootstrap_interval(few, 100).first().low is None
    many = df.withColumn("group", F.monotonically_increasing_id())
    ci = calibration.bootstrap_interval(many, 300).first()
    mean = sum(y for _, y in rows) / len(rows)
    assert ci.low < mean < ci.high


def test_splits(spark):
    rows = spark.createDataFrame([(g, t) for g in range(10) for t in (g, g + 1)] + [(99, 0), (99, 100)], "g long, t long")
    got = {r.g: r.split for r in splits.temporal_group_split(rows, "g", "t").collect()}
    assert got[99] == "excluded" and got[0] == "train" and got[9] == "holdout"


def test_intervals(spark):
    w = spark.createDataFrame([(1, 0, 10)], "k int, wa long, wb long")
    s = spark.createDataFrame([(1, -5, 0), (1, 3, 25), (1, 11, 12), (2, 0, 10)], "k int, a long, b long")
    got = {(r.a, r.overlap) for r in intervals.overlap_join(w, s, "k", 4).collect()}
    assert got == {(-5, 0), (3, 7)}


def test_storage(spark):
    old = spark.createDataFrame([(1, "a", 1, 1)], "id long, v string, seq long, created long")
    new = spark.createDataFrame([(1, "b", 2, 2), (2, "c", 3, 3), (2, "d", 4, 4)], "id long, v string, seq long, created long")
    assert {(r.id, r.v, r.created) for r in storage.upsert(old, new, "id", "seq", "created").collect()} == {(1, "b", 1), (2, "d", 3)}
    assert {(r.id, r.v) for r in storage.insert_or_ignore(old, new, "id", "seq").collect()} == {(1, "a"), (2, "c")}
    again = storage.insert_or_ignore(storage.insert_or_ignore(old, new, "id", "seq"), new, "id", "seq")
    assert again.count() == 2
    with pytest.raises(ValueError):
        storage.append_immutable(old, new, "id", "v")
    expiry = spark.createDataFrame([("2020-01-01 00:00:00",), ("2030-01-01 00:00:00",), ("soon",), (None,)], "e string")
    assert expiry.where(storage.alive(F.col("e"), F.lit("2024-01-01").cast("timestamp"))).count() == 3


def test_fuzzy(spark):
    from skein.functions import fuzzy

    a, b = F.col("a"), F.col("b")
    assert one(spark, fuzzy.echo_score(a, b), a="open the door", b="please OPEN the door now") == 1.0
    assert one(spark, fuzzy.echo_score(a, b), a="", b="x") == 0.0
    assert one(spark, fuzzy.closest_phrase(a, b), a="call misses smith tomorrow", b="mrs smith").phrase in ("misses smith", "smith")
    assert one(spark, fuzzy.closest_phrase(a, b), a="abc", b="zzz zzz").phrase is None
    assert one(spark, fuzzy.lexicon_replace(a, {"bar": "X", "foo bar": "Y$"}), a="Foo Bar, bar; barn été") == "Y$, X; barn été"


def test_routing(spark):
    from skein.operators import routing

    rows = spark.createDataFrame([(1, "Open the door and close window"), (2, "hello"), (3, ""), (4, "open this or close that"), (5, "open open open")], "id int, text string")
    got = {r.id: r for r in routing.segment(rows, "id", "text", {"open": "open", "close": "close"}, {"and"}, {"or"}).collect()}
    assert got[1].decision == "compound" and [(s.operation, s.words) for s in got[1].subtasks] == [("open", "open the door"), ("close", "close window")]
    assert got[2].reason == "no_command_operation" and got[3].reason == "empty_text" and got[4].reason == "ambiguous_connector:or" and got[5].decision == "simple"
    starts = {(r.token, r.start) for r in routing.tokens(rows.where("id = 1"), "id", "text").collect()}
    assert ("door", 9) in starts and ("open", 0) in starts
    candidates = spark.createDataFrame([(1, 10, 0.9, False, 0.9), (1, 11, 0.5, False, 0.9), (2, 10, 0.9, False, 0.2), (3, 10, 0.9, True, 0.9), (4, 10, 0.3, False, 0.9), (5, 10, 0.9, False, 0.9), (6, 10, 0.9, False, 0.9), (6, 11, 0.88, False, 0.9)], "id int, candidate_id int, score double, rejected boolean, confidence double")
    assert {r.id: r.decision for r in routing.resolve(candidates, "id").collect()} == {1: "resolved", 2: "low_transcript_confidence", 3: "ineligible", 4: "low_score", 5: "resolved_single", 6: "low_margin"}
    answer = spark.createDataFrame([('text ```json\n{"a": 1}\n``` more',), ('so {"a": 2} then',), ("none",)], "t string").select(F.try_variant_get(routing.plan_from_answer(F.col("t")), "$.a", "int").alias("a"))
    assert [r.a for r in answer.collect()] == [1, 2, None]


def test_only_first_tokens_leave_a_task(spark):
    """Two texts of a thousand tokens share all but ten; the rest share one common token each with many: few rows are joined on, and none is missed."""
    rows = [(1, list(range(1000))), (2, list(range(10, 1010))), (3, list(range(1000))), (3, list(range(5000, 5010)))]
    rows += [(i, [7, *range(i * 10_000, i * 10_000 + 9)]) for i in range(10, 200)] + [(900, []), (901, None)]
    sets = dedup.token_sets(spark.createDataFrame(rows, "id long, tokens array<long>").repartition(5))
    weights = spark.sparkContext.broadcast(np.where(np.arange(256) == dedup._bucket(np.array([7]), 8)[0], 9, 1).astype(np.uint8))
    first = sets.where("id between 10 and 199").selectExpr("id", "n", "0L AS k", "s").mapInArrow(dedup._first_tokens(weights, 8, 0.88), "id long, n int, k long, g long")
    assert first.where("g = 7").count() == 0 and first.count() == 190 * 2
    assert [tuple(r) for r in dedup.similar_pairs(sets, 0.88).collect()] == [(1, 2, 990 / 1010)]
