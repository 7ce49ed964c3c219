"""What must not grow with the tables: rows of a task, runs of costly functions."""

from __future__ import annotations

import os

from skein.plans import catalog, registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_tables(spark, sf_dir, monkeypatch):
    held = sum(os.path.getsize(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    assert registry.tasks_for(spark, sf_dir, "orders", "lineitem", size=1000) == -(-held // 1000)
    assert registry.tasks_for(spark, sf_dir, "orders") == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("skein.plans.storage.tasks_for", lambda *a: 77)
    assert _plan(catalog.QUERIES["dependency_order"](spark, sf_dir)).count(", 77), REPARTITION_BY_NUM") == 2


def test_a_digest_is_made_once_and_by_all_cores(spark, sf_dir):
    plan = _plan(catalog.QUERIES["confident_digests"](spark, sf_dir))
    assert plan.count("EvalPython") == 1 and "REPARTITION_BY_NUM" in plan


def test_requests_of_many_keys_share_a_group_of_state(spark, sf_dir):
    from skein.plans import streams

    made = streams.traces.mark_duplicate_requests(streams.stateful.file_stream(spark, sf_dir, "events"), "user_id", 3600)
    assert "bucket_" in made._jdf.queryExecution().analyzed().toString()


def test_texts_without_a_mark_are_not_searched_by_pattern(spark):
    from pyspark.sql import functions as F

    from skein.functions import privacy

    said = ["", "a b", "x@y.z and %q@a-b.c%r@d.e", "see http://a.b/c https://", "password: no token=yes", "AKIA" + "A" * 16, "call +1 (555) 123-4567 ok", "rapid@", "[PHONE] 12 34"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*said, " ".join(said)])], "i int, text string")
    marked = privacy.redacted(rows)
    assert marked._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") > 12
    t = F.regexp_replace("text", privacy.SECRET, "[SECRET]")
    for pattern, mark in ((privacy.EMAIL, "[EMAIL]"), (privacy.PHONE, "[PHONE]"), (privacy.URL, "[URL]")):
        t = F.regexp_replace(t, pattern, mark)
    want = rows.select(F.trim(F.regexp_replace(t, r"[ \t]+", " ")).alias("x"), F.col("text").rlike(privacy.SECRET).alias("s")).collect()
    got = marked.orderBy("i").collect()
    assert [r.clean for r in got] == [r.x for r in want] and ["secret" in r["flags"] for r in got] == [r.s for r in want]
    assert [r["flags"] for r in got][2:8] == [["email"], ["url"], ["secret"], ["secret"], ["phone"], []]
