"""Schema rules, guards, states, exact holdouts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.operators import validation

RULES = {"n": {"required": True, "type": "integer", "minimum": 0}, "s": {"type": "string", "pattern": "[a-z]+", "max_length": 3}, "c": {"enum": ["x", "y"]}}


@pytest.mark.parametrize(
    ("value", "errors"),
    [('{"n": 1, "s": "ab", "c": "x"}', []), ('{"s": "ab"}', ["n:missing"]), ('{"n": "1"}', ["n:type"]), ('{"n": -1, "s": "ABCD", "c": "z", "q": 0}', ["unknown_key", "n:minimum", "s:pattern", "s:max_length", "c:enum"]), ("nonsense", ["not_an_object", "n:missing"])],
)
def test_schema_errors(spark, value, errors):
    got = spark.createDataFrame([(value,)], "v string").select(validation.schema_errors(F.col("v"), RULES).alias("e")).first().e
    assert [e for e in got if e != "n:missing" or "n:missing" in errors] == [e for e in errors if e in got] and set(errors) - {"n:missing"} <= set(got)


def test_guards(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "id int, ctx string")
    assert validation.require_none(rows, F.col("id") > 5, "banned").count() == 2
    with pytest.raises(Exception, match="banned"):
        validation.require_none(rows, F.col("id") > 1, "banned").collect()
    assert validation.require_one_context(rows, ["ctx"]).first().ctx == "a"
    with pytest.raises(ValueError):
        validation.require_one_context(rows, ["id"])


def test_states(spark):
    c = spark.createDataFrame([(1, "h", "me"), (2, "h", "me"), (3, "h", "me"), (4, "h", "me"), (5, "h", "me")], "candidate_id int, content_hash string, scope string")
    d = spark.createDataFrame([(1, "approve", "h", "me", 1), (2, "approve", "old", "me", 1), (3, "approve", "h", "all", 1), (4, "approve", "h", "me", 1), (4, "reject", "h", "me", 2)], "candidate_id int, verdict string, content_hash string, scope string, at int")
    assert {r.candidate_id: r.state for r in validation.decide_candidates(c, d).collect()} == {1: "approved", 2: "pending", 3: "blocked", 4: "rejected", 5: "pending"}


def test_exact_holdout(spark):
    groups = spark.createDataFrame([("a", 7), ("b", 5), ("c", 11), ("d", 3)], "group string, n long")
    sizes = {"a": 7, "b": 5, "c": 11, "d": 3}
    held = [r.group for r in validation.exact_holdout(groups, 10).collect() if r.held_out]
    assert sum(sizes[g] for g in held) == 10
    assert not [r for r in validation.exact_holdout(groups, 4).collect() if r.held_out]


def test_recent_and_summary(spark):
    turns = spark.createDataFrame([(1, i, f"t{i}") for i in range(5)], "c int, n int, t string")
    assert tuple(validation.recent_and_summary(turns, "c", "n", "t", 2, 5).first()) == (1, "t3\nt4", "t1\nt2")
    many = spark.createDataFrame([(c, i, None if c == 3 or i % 7 == 0 else "x" * (i % 4)) for c in (1, 2, 3, None) for i in range(400)], "c int, n int, t string")
    texts = ["x" * (i % 4) for i in range(400) if i % 7]
    got = {r.c: (r.recent, r.summary) for r in validation.recent_and_summary(many, "c", "n", "t", 2, 50).collect()}
    assert got == {c: ("\n".join(texts[-2:]), "\n".join(texts[:-2])[-50:]) for c in (1, 2, None)} | {3: ("", "")}
