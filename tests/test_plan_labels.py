"""Three-valued plan labels, stale labels, score cards of few matches, rules for arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import arguments, plan_labels


def test_every_case_of_a_plan(spark):
    rows = [
        (["a"], ["1"], ["a"], ["1"], False, True), (["a"], ["1"], ["a"], ["2"], False, True), (["a"], ["1"], ["a"], ["2"], False, False), (["a"], ["1"], ["b"], ["1"], False, False),
        ([], [], ["a"], ["1"], False, True), ([], [], [], [], True, True), (["a"], ["1"], [], [], True, True), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<string>, pa array<string>, e array<string>, ea array<string>, abstain boolean, complete boolean")
    told = df.select("i", plan_labels.plan_labels(*[F.col(c) for c in ("p", "pa", "e", "ea", "abstain", "complete")]).alias("x")).select("i", "x.*").orderBy("i").collect()
    assert [tuple(r)[1:] for r in told] == [
        (True, True, "safe_execute_correct"), (True, False, "unsafe_resolution"), (True, None, None), (False, None, "unsafe_resolution"),
        (False, False, "missed_action"), (True, True, "safe_abstain"), (False, False, "unsafe_resolution"), (True, None, "missed_action"),
    ]


def test_stale_labels_and_groups(spark):
    seen = spark.createDataFrame([(1, 0, "s", "own"), (1, 1, "s", None), (2, 0, "s", "own"), (None, 0, "s", "own")], "request_id int, subtask_index int, snapshot_sha256 string, split_group_override string")
    told = spark.createDataFrame([(1, 0, "s", "theirs", 7), (1, 1, "old", "x", 8), (2, 0, "s", None, 9), (None, 0, "s", "x", 10)], "request_id int, subtask_index int, snapshot_sha256 string, split_group_override string, quality int")
    got = {(r.request_id, r.subtask_index): (r.split_group_override, r.label_quality) for r in plan_labels.labelled(seen, told).collect()}
    assert got == {(1, 0): ("theirs", 7), (1, 1): (None, None), (2, 0): ("own", 9), (None, 0): ("own", None)}


def test_cards_of_few_matches(spark):
    rows = [(1, [], "a"), (2, [(0.9, "a")], "a"), (3, [(0.9, "b"), (0.5, "a")], "a"), (4, [(0.9, "b"), (0.85, "c")], None), (5, None, "a")]
    df = spark.createDataFrame([(*r, False, None) for r in rows], "example_id int, matches array<struct<score: double, action: string>>, expected string, ambiguous boolean, confidence double")
    got = {r.example_id: (r.top1, r.hit_at_1, r.hit_at_k, r.reciprocal_rank, r.below_least, r.predicted_ambiguous, r.gate_blocked) for r in plan_labels.score_cards(df, 0.3, 0.1, 0.4).collect()}
    assert got == {1: (None, False, False, 0.0, True, True, False), 2: ("a", True, True, 1.0, False, True, False), 3: ("b", False, True, 0.5, False, False, False), 4: ("b", False, False, 0.0, False, True, False), 5: (None, False, False, 0.0, True, True, False)}


def test_arguments_convert_or_say_why(spark):
    rules = (arguments.Rule("go", "n", r"n=(\S*)", kind="integer"), arguments.Rule("go", "x", r"x=(\S+)", kind="double", required=False), arguments.Rule("go", "on", r"on=(\w+)", kind="boolean", default="true"), arguments.Rule("rest", "", ""))
    df = spark.createDataFrame([(1, "go", "n=5 x=1.5 on=false"), (2, "go", "n=many"), (3, "go", None), (4, "rest", "n=5"), (5, "fly", "n=5"), (6, None, "n=5")], "i int, action string, t string")
    got = {r.i: (r.a, list(r.errors)) for r in arguments.extract(df, "action", "t", rules).select("i", F.to_json("arguments").alias("a"), "errors").collect()}
    assert got == {1: ('{"n":5,"on":false,"x":1.5}', []), 2: ('{"on":true}', ["invalid:n"]), 3: ('{"on":true}', ["missing:n"]), 4: ("{}", []), 5: (None, ["unknown_action"]), 6: (None, ["unknown_action"])}
