"""Streams over tables of several files that are not in the order of time."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.plans import catalog


@pytest.fixture(scope="module")
def shuffled(sf_dir, tmp_path_factory):
    """The events, the newest in the first file."""
    base = tmp_path_factory.mktemp("shuffled")
    folder = base / "events.parquet"
    folder.mkdir()
    events = pq.read_table(f"{sf_dir}/events.parquet").sort_by([("ts", "descending")])
    step = -(-events.num_rows // 5)
    for n in range(5):
        part = events.slice(n * step, step)
        order = pa.array(sorted(range(part.num_rows), key=lambda i: i * 7919 % 1009))
        pq.write_table(part.take(order), folder / f"part-{n}.parquet")
        os.utime(folder / f"part-{n}.parquet", (1_700_000_000 + n * 60,) * 2)
    return str(base)


def test_bucket_counts_of_shuffled_files(spark, shuffled, duck, same_rows):
    same_rows(catalog.QUERIES["stream_bucket_counts"](spark, shuffled).toPandas(), duck.sql(catalog.SQL["stream_bucket_counts"]).df())


def test_duplicate_requests_of_shuffled_files(spark, sf_dir, shuffled):
    events = pq.read_table(f"{sf_dir}/events.parquet", columns=["user_id", "event_id", "ts"]).to_pylist()
    want, first = set(), {}
    for r in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        known = first.get(r["user_id"])
        if known is None or (r["ts"] - known[1]).total_seconds() > 3600:
            known = first[r["user_id"]] = (r["event_id"], r["ts"])
        want.add((r["user_id"], r["event_id"], known[0]))
    got = [tuple(r) for r in catalog.QUERIES["stream_duplicate_requests"](spark, shuffled).select("user_id", "event_id", "first_id").collect()]
    assert len(got) == len(events) and set(got) == want


@pytest.mark.parametrize("name", ["live_traces", "live_trace_metrics", "cached_results"])
def test_keyed_state_over_shuffled_files(name, spark, shuffled, duck, same_rows):
    same_rows(catalog.QUERIES[name](spark, shuffled).toPandas(), duck.sql(catalog.SQL[name]).df())


def test_a_trace_is_told_once_and_a_small_cache_drops_the_oldest(spark, tmp_path):
    from datetime import UTC, datetime, timedelta

    from pyspark.sql import functions as F

    from skein.streaming import stateful, traces

    start = datetime(2024, 5, 1, tzinfo=UTC)
    files = [
        [("s", 1, "end", 50), ("s", 1, "begin", 10), ("t", 2, "begin", 20)],
        [("u", 1, "begin", 4000)],  # the watermark passes the first two
        [("s", 1, "begin", 4001), ("u", 1, "end", 4002), (None, None, "begin", 4003), ("u", 1, None, 4004)],
        [("v", 9, "begin", 90_000)],
    ]
    folder = tmp_path / "marks.parquet"
    folder.mkdir()
    for n, rows in enumerate(files):
        at = pa.array([start + timedelta(seconds=x[3]) for x in rows], pa.timestamp("us", "UTC"))
        pq.write_table(pa.table({"session": pa.array([x[0] for x in rows], pa.string()), "turn": pa.array([x[1] for x in rows], pa.int64()), "mark": pa.array([x[2] for x in rows], pa.string()), "ts": at, "id": pa.array(range(n * 10, n * 10 + len(rows)), pa.int64())}), folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n * 60,) * 2)
    stream = lambda: stateful.file_stream(spark, str(tmp_path), "marks", 1)
    told = stateful.run_available(traces.assemble(stream(), ["session", "turn"], "mark", "ts", "10 minutes"), keyed=True).collect()
    assert sorted((str(r.session), str(r.turn), dict(r.phases_ms)) for r in told) == [("None", "None", {"begin": 0}), ("s", "1", {"begin": 0, "end": 40_000}), ("t", "2", {"begin": 0}), ("u", "1", {"begin": 0, "end": 2000})]
    asked = stream().withColumn("who", F.lit("x")).withColumn("asked", F.concat_ws("/", "session", "turn"))
    got = {r.request: (r.hit, r.computed_by) for r in stateful.run_available(traces.cached(asked, "who", "asked", "id", "ts", "2 hours", 2), keyed=True).collect()}
    # s/1 at 10 s is asked again at 50 s; t/2 and u/1 follow, so s/1 is the oldest of three and goes.
    assert got == {1: (False, 1), 2: (False, 2), 0: (True, 1), 10: (False, 10), 20: (False, 20), 21: (True, 10), 22: (False, 22), 23: (False, 23), 30: (False, 30)}


def test_an_index_is_the_same_however_the_stream_is_cut(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from skein.functions import text
    from skein.streaming import incremental, stateful

    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").slice(0, 120).to_pylist()
    long = next(r["text"] for r in rows if len(r["text"].split()) > 300)
    near = lambda n: " ".join(w if i != n else "EDIT" for i, w in enumerate(long.split()))
    rows += [{"doc_id": 10_000 + i, "text": t} for i, t in enumerate([near(3), near(150), long, near(3), None, "", "one two", "one two", near(150) + " tail", near(40)] * 3)]
    shingled = lambda t: {" ".join(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)} or {t or ""}
    sets = {r["doc_id"]: shingled(r["text"]) for r in rows}
    likeness = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    kept, want = [], {}
    for r in rows:
        i = r["doc_id"]
        found = [(-likeness(sets[i], sets[k]), k) for k in kept]
        best = min((x for x in found if -x[0] >= 0.92), default=(0, None))[1]
        want[i] = best
        if best is None:
            kept.append(i)
    assert sum(v is not None for v in want.values()) > 15
    for files in (1, 4):
        folder = tmp_path / f"{files}" / "docs.parquet"
        folder.mkdir(parents=True)
        step = -(-len(rows) // files)
        for n in range(files):
            part = rows[n * step : (n + 1) * step]
            pq.write_table(pa.table({"doc_id": pa.array([r["doc_id"] for r in part], pa.int64()), "text": pa.array([r["text"] for r in part], pa.string())}), folder / f"{n}.parquet")
            os.utime(folder / f"{n}.parquet", (1_700_000_000 + n * 60,) * 2)
        stream = stateful.file_stream(spark, str(folder.parent), "docs", 1)
        got = {r.id: r.duplicate_of for r in incremental.index_stream(stream, "doc_id", "text", text.shingles(F.coalesce("text", F.lit("")))).collect()}
        assert got == want


def test_keys_share_a_bounded_number_of_groups(spark, shuffled):
    from skein.streaming import stateful, traces

    events = stateful.file_stream(spark, shuffled, "events")
    for made in (traces.assemble(events, ["user_id"], "event_type", "ts"), traces.cached(events, "user_id", "props", "event_id", "ts")):
        assert "bucket_" in made._jdf.queryExecution().analyzed().toString()
