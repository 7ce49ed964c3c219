"""Prosody of synthetic tones, durations, nested values."""

from __future__ import annotations

import io
import json
import wave

import numpy as np
from pyspark.sql import functions as F

from skein.functions import durations, nested, prosody


def tone(hz: np.ndarray, rate: int = 16_000) -> bytes:
    x = np.round(0.5 * np.sin(2 * np.pi * np.cumsum(hz) / rate) * 32767 * (hz > 0)).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    return out.getvalue()


def test_prosody(spark):
    rising = tone(np.linspace(150, 260, 16_000))
    falling = tone(np.linspace(260, 150, 16_000))
    gap = tone(np.concatenate([np.full(8000, 200.0), np.zeros(16_000), np.full(8000, 200.0)]))
    df = spark.createDataFrame([("rising", bytearray(rising)), ("falling", bytearray(falling)), ("gap", bytearray(gap)), ("none", None)], "name string, data binary")
    rows = {r.name: r for r in df.withColumn("f", prosody.prosody("data")).withColumn("q", prosody.question_score(F.col("f"), F.lit(1.0))).collect()}
    assert rows["rising"].f.rise_semitones > 3 and rows["rising"].q > 0.8 > 0.1 > rows["falling"].q
    assert abs(rows["gap"].f.median_hz - 200) < 5 and 0.9 < rows["gap"].f.longest_silence_s < 1.1
    assert rows["none"].f.seconds is None and rows["none"].q is None


def test_durations(spark):
    cases = {"wait five minutes please": 300, "in 2 hours": 7200, "10 Sekunden": 10, "zehn Minuten": 600, "900 hours": 86_400, "soon": None, "zillion minutes": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", durations.seconds(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases


def test_nested(spark):
    value = {"a": ["mail x@y.org", {"b": "see https://e.org/1"}], "n": 3}
    df = spark.createDataFrame([(json.dumps(value),), ("{bad",)], "v string")
    first, second = [r.r for r in df.select(nested.redact_json("v").alias("r")).collect()]
    assert json.loads(first.value) == {"a": ["mail [EMAIL]", {"b": "see [URL]"}], "n": 3} and first.flags == ["email", "url"]
    assert second.value is None
    deep = json.dumps({"confidence": 0.5, "x": [{"confidence": 1}, {"y": {"confidence": 0.0, "z": True}}]})
    got = spark.createDataFrame([(deep,), ("{}",), (None,)], "v string").select(nested.mean_confidence("v").alias("m")).collect()
    assert [r.m for r in got] == [0.5, None, None]


def test_nested_redaction_as_the_plain_one(spark):
    from skein.functions import privacy

    texts = ["id 44051401359 here", "id 44051401358 here", "my salary, mail a@b.cd", "token=abc https://x.y/z", "44051401359 44051401359"]
    df = spark.createDataFrame([(t, '{"a": [' + f'"{t}"' + "]}") for t in texts], "text string, v string")
    for r in privacy.redacted(df).withColumn("r", nested.redact_json("v")).collect():
        assert r.r.value == '{"a": ["' + r.clean + '"]}' and set(r.r.flags) == set(r.flags)


def test_letters_of_other_scripts_stay(spark):
    from skein.functions import text

    df = spark.createDataFrame([("Ελλάδα — Ёлка 日本",), ("été ÉTÉ!",)], "t string")
    for fold in (text.normalize, text.canonical):
        scripts, french = [r[0] for r in df.select(fold(df.t)).collect()]
        assert [len(w) for w in scripts.split()] == [6, 4, 2] and french == "ete ete"


def test_error_rates_of_whole_texts(spark):
    import random

    from skein.functions import text

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    make = lambda n: " ".join(rng.choice(["été", "naïve", "one", "two", "три", "日本"]) + str(rng.randrange(40)) for _ in range(n))
    rows = [(make(n), make(m)) for n, m in ((3, 4), (60, 50), (300, 280), (1, 1))]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.character_error_rate(F.col("a"), F.col("b")).alias("c"), text.word_error_rate(F.col("a"), F.col("b")).alias("w"))
    for r in df.collect():
        assert abs(r.c - distance(r.a, r.b) / len(r.a)) < 1e-9
        assert abs(r.w - distance(r.a.split(), r.b.split()) / len(r.a.split())) < 1e-9


def test_error_rates_of_very_many_distinct_words(spark):
    import random

    from skein.functions import text

    a = [f"w{i}" for i in range(70_000)]
    b = a[:1000] + ["x"] + a[1000:30_000] + a[30_007:] + ["y", "z"]
    df = spark.createDataFrame([(" ".join(a), " ".join(b), "a b", None)], "a string, b string, c string, d string")
    row = df.select(text.word_error_rate(F.col("a"), F.col("b")).alias("many"), text.word_error_rate(F.col("c"), F.col("d")).alias("none")).collect()[0]
    assert row.many == (1 + 7 + 2) / 70_000 and row.none is None
    rng = random.Random(2)
    for _ in range(300):
        p, q = ([rng.choice("abc") for _ in range(rng.randrange(70))] for _ in "pq")
        table = list(range(len(q) + 1))
        for i, x in enumerate(p, 1):
            last, table[0] = table[0], i
            for j, y in enumerate(q, 1):
                last, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, last + (x != y))
        assert text.edit_distance(p, q) == table[-1]


def test_queries_beyond_a_broadcast_meet_in_blocks(spark, monkeypatch):
    from skein.operators import retrieval

    points = spark.range(60).withColumnRenamed("id", "vec_id").withColumn("space", F.col("vec_id") % 2)
    queries = points.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = lambda: sorted((r.query_id, r.vec_id) for r in retrieval.beside(points, queries, ("space",)).collect())
    want = pairs()
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 5)
    assert pairs() == want and len(want) == 12 * 29
