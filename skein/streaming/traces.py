"""Live traces, a result cache and duplicate requests: keyed state with timers.

All need the RocksDB state store, which :func:`stateful.run_available` asks for with ``keyed=True``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What is asked of every trace: the time from one mark to another.
METRICS = {
    "seen_to_click_ms": ("view", "click"),
    "click_to_purchase_ms": ("click", "purchase"),
    "seen_to_purchase_ms": ("view", "purchase"),
    "signup_to_view_ms": ("signup", "view"),
    "signup_to_purchase_ms": ("signup", "purchase"),
    "error_to_view_ms": ("error", "view"),
    "click_to_error_ms": ("click", "error"),
}
#: Keys that share a hash are one group of the stateful operator: a call and a state for each key would cost more than all else.
BUCKETS = 1024
#: Keys travel as one JSON text: pandas would turn whole numbers beside nulls into floats, and so into other keys.
_KEY = T.StructField("key_", T.StringType())


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _as_key(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys)).alias("key_")


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket_", F.pmod(F.xxhash64("key_"), F.lit(BUCKETS))).groupBy("bucket_")


def _with_keys(made: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return made.select(F.from_json("key_", T.StructType([rows.schema[k] for k in keys])).alias("key_"), *made.columns[1:]).select("key_.*", *made.columns[1:])


class _Bucket(StatefulProcessor):
    """Many keys whose rows are one Arrow table in the state, read and written at once, with one timer for what is due first."""

    kept: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", T.StructType([T.StructField("table", T.BinaryType())]))
        self.timer = handle.getValueState("timer", T.StructType([_long("ms")]))

    def _held(self) -> pa.Table:
        if not self.rows.exists():
            return self.kept.empty_table()
        return pa.ipc.open_stream(bytes(self.rows.get()[0])).read_all()

    def _keep(self, rows: pa.Table, first_due_ms: int | None, now_ms: int) -> None:
        if len(rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.kept) as out:
                out.write_table(rows)
            self.rows.update((sink.getvalue().to_pybytes(),))
        else:
            self.rows.clear()
        old = self.timer.get()[0] if self.timer.exists() else None
        due = max(first_due_ms, now_ms + 1) if len(rows) else None
        if due == old:
            return
        if old is not None and old > now_ms:  # one that has gone off is no more
            self.handle.deleteTimer(old)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))


class _Traces(_Bucket):
    """Of each key: the first time of every mark, and the last time of any. Told once, when nothing came for a while."""

    kept = pa.schema([("key_", pa.string()), ("mark_", pa.string()), ("us_", pa.int64()), ("last_us", pa.int64()), ("told", pa.bool_())])

    def __init__(self, idle_ms: int, keep_ms: int):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def _frame(self) -> pd.DataFrame:
        return self._held().to_pandas()

    def _due(self, held: pd.DataFrame) -> pd.Series:
        last = held.groupby("key_")["last_us"].transform("max")
        return last // 1000 + np.where(held["told"], self.keep_ms, self.idle_ms) + 1

    def _store(self, held: pd.DataFrame, now_ms: int) -> None:
        self._keep(pa.Table.from_pandas(held, self.kept, preserve_index=False), int(self._due(held).min()) if len(held) else None, now_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([frame[["key_", "mark_", "us_"]] for frame in rows])
        new = new.assign(us_=new["us_"].astype("int64"), last_us=new["us_"].astype("int64"), told=False)
        held = self._frame()
        # What comes for a told trace is nobody's, and only keeps its flag.
        flags = set(held.loc[held["told"], "key_"])
        gone = new["key_"].isin(flags)
        new.loc[gone, ["mark_", "told"]] = ["", True]
        held = pd.concat([held, new]).groupby(["key_", "mark_", "told"], sort=False, as_index=False).agg({"us_": "min", "last_us": "max"})
        self._store(held[self.kept.names], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms, held = timerValues.getCurrentWatermarkInMs(), self._frame()
        due = self._due(held) <= now_ms
        ready = held[due & ~held["told"]].sort_values(["key_", "mark_"])
        found: dict[str, dict[str, int]] = {}
        for name, mark, us in zip(ready["key_"], ready["mark_"], ready["us_"]):
            found.setdefault(name, {})[mark] = us
        last = ready.groupby("key_", sort=False)["last_us"].max()
        began = [min(marks.values()) for marks in found.values()]
        told = pd.DataFrame({"key_": list(found), "mark_": "", "us_": 0, "last_us": last.to_numpy(), "told": True}).astype(held.dtypes.to_dict())
        # A flag whose time is up already needs no keeping.
        told = told[told["last_us"] // 1000 + self.keep_ms + 1 > now_ms]
        self._store(pd.concat([held[~due], told]), now_ms)
        if found:
            phases = [{mark: (us - first) // 1000 for mark, us in marks.items()} for first, marks in zip(began, found.values())]
            yield pd.DataFrame({"key_": list(found), "began_us": began, "last_us": last.to_numpy(), "phases_ms": phases})


def assemble(events: DataFrame, keys: list[str], mark: str, ts: str, idle: str = "6 hours", late: str = "0 seconds", keep: str = "7 days") -> DataFrame:
    """keys, began_us, last_us, phases_ms (mark to milliseconds since the first): one trace for each key of a stream.

    A mark counts from its first time, in whatever order rows come. A trace is told once, when the
    watermark is ``idle`` past its last row, also if it was abandoned; rows that come for it in the ``keep``
    after that are nobody's. State is a row for each open mark, and one flag for each told trace
    until it is forgotten, in BUCKETS tables; a micro-batch reads and writes the tables its keys fall into. Rows without a mark or a time don't count; a null key is a key.
    """
    ms = lambda span: int(pd.Timedelta(span).total_seconds() * 1000)
    rows = events.where(F.col(mark).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(_as_key(keys), F.col(ts), F.unix_micros(ts).alias("us_"), F.col(mark).cast("string").alias("mark_"))
    out = T.StructType([_KEY, _long("began_us"), _long("last_us"), T.StructField("phases_ms", T.MapType(T.StringType(), T.LongType()))])
    made = _by_bucket(rows).transformWithStateInPandas(_Traces(ms(idle), ms(keep)), out, "append", "eventTime")
    return _with_keys(made, events, keys)


def metrics(phases_ms: Column, table: dict[str, tuple[str, str]] = METRICS) -> Column:
    """An array of (metric, ms) for those whose two marks are there in order."""
    at = lambda mark: F.try_element_at(phases_ms, F.lit(mark))
    each = [F.when(at(then) >= at(first), F.struct(F.lit(name).alias("metric"), (at(then) - at(first)).alias("ms"))) for name, (first, then) in table.items()]
    return F.array_compact(F.array(*each))


class _Cache(_Bucket):
    """Answers of each key's cache: what was asked, when it was computed and by which request."""

    kept = pa.schema([("key_", pa.string()), ("asked", pa.string()), ("us", pa.int64()), ("by", pa.int64())])

    def __init__(self, ttl_us: int, most: int):
        self.ttl_us, self.most = ttl_us, most

    def _known(self) -> dict[str, dict[str, tuple[int, int]]]:
        caches: dict[str, dict[str, tuple[int, int]]] = {}
        for name, asked, us, by in zip(*(c.to_pylist() for c in self._held().columns)):
            caches.setdefault(name, {})[asked] = (us, by)
        return caches

    def _due(self, known: dict[str, tuple[int, int]]) -> int:
        return (max(v[0] for v in known.values()) + self.ttl_us) // 1000 + 1

    def _store(self, caches: dict[str, dict[str, tuple[int, int]]], now_ms: int) -> None:
        rows = [(name, asked, *value) for name, known in caches.items() for asked, value in known.items()]
        self._keep(pa.table([list(c) for c in zip(*rows)] if rows else [[]] * 4, schema=self.kept), min(map(self._due, caches.values()), default=None), now_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        caches = self._known()
        frame = pd.concat(list(rows)).sort_values(["us_", "id_"], kind="stable")
        hits, by = [], []
        for name, us, asked, request in zip(frame["key_"].tolist(), frame["us_"].tolist(), frame["asked_"].tolist(), frame["id_"].tolist()):
            known = caches.setdefault(name, {})
            at = known.get(asked)
            hit = at is not None and 0 <= us - at[0] <= self.ttl_us
            if not hit:
                known[asked] = at = (us, request)
                if len(known) > self.most:
                    known = caches[name] = {k: v for k, v in known.items() if us - v[0] <= self.ttl_us}
                while len(known) > self.most:
                    del known[min(known, key=known.get)]
            hits.append(hit)
            by.append(at[1])
        self._store(caches, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key_": frame["key_"].to_numpy(), "request": frame["id_"].to_numpy(), "hit": hits, "computed_by": by})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        self._store({name: known for name, known in self._known().items() if self._due(known) > now_ms}, now_ms)
        return iter(())


def cached(requests: DataFrame, key: str, asked: str, request: str, ts: str, ttl: str = "300 seconds", most: int = 100, late: str = "0 seconds") -> DataFrame:
    """key, request, hit, computed_by: which requests a cache would have answered, and the one that computed the answer.

    Each key has a cache of its own. An answer serves for ``ttl`` from when it was computed, hits don't extend
    that; over ``most`` answers expired ones go, then the oldest. A micro-batch's rows of a key are taken in
    the order of time and request. State is at most ``most`` rows a key, and goes when all have expired; it lies in BUCKETS tables, as that of :func:`assemble`.
    """
    rows = requests.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(_as_key([key]), F.col(ts), F.unix_micros(ts).alias("us_"), F.coalesce(F.col(asked).cast("string"), F.lit("")).alias("asked_"), F.col(request).cast("long").alias("id_"))
    out = T.StructType([_KEY, _long("request"), T.StructField("hit", T.BooleanType()), _long("computed_by")])
    made = _by_bucket(rows).transformWithStateInPandas(_Cache(int(pd.Timedelta(ttl).total_seconds() * 1e6), most), out, "append", "eventTime")
    return _with_keys(made, requests, [key])


#: Stands for a missing time: behind all others, and no other's neighbour.
_NEVER = 1 << 62


class _Firsts(_Bucket):
    """Of each key: the first remembered request and its time."""

    kept = pa.schema([("key_", pa.string()), ("first_id", pa.int64()), ("us", pa.int64())])

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def _known(self) -> dict[str, tuple[int, int]]:
        return {name: (first, us) for name, first, us in zip(*(c.to_pylist() for c in self._held().columns))}

    def _due(self, at: tuple[int, int]) -> int:
        return 0 if at[1] == _NEVER else (at[1] + self.gap_us) // 1000 + 1

    def _store(self, known: dict[str, tuple[int, int]], now_ms: int) -> None:
        rows = [(name, *at) for name, at in known.items()]
        self._keep(pa.table([list(c) for c in zip(*rows)] if rows else [[]] * 3, schema=self.kept), min(map(self._due, known.values()), default=None), now_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, firsts = self._known(), []
        frame = pd.concat(list(rows)).sort_values(["us_", "id_"], kind="stable")
        for name, us, request in zip(frame["key_"].tolist(), frame["us_"].tolist(), frame["id_"].tolist()):
            at = known.get(name)
            if at is None or not 0 <= us - at[1] <= self.gap_us:
                known[name] = at = (request, us)
            firsts.append(at[0])
        self._store(known, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key_": frame["key_"].to_numpy(), "event_id": frame["id_"].to_numpy(), "first_id": firsts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        self._store({name: at for name, at in self._known().items() if self._due(at) > now_ms}, now_ms)
        return iter(())


def mark_duplicate_requests(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, event_id, first_id): a request within ``seconds`` of the first remembered one of its key is that one again.

    Duplicates don't extend the time. State is one row for each key, in BUCKETS tables, and is dropped when the
    watermark has left it behind.
    """
    rows = events.withWatermark("ts", "10 minutes")
    rows = rows.select(_as_key([key]), "ts", F.coalesce(F.unix_micros("ts"), F.lit(_NEVER)).alias("us_"), F.col("event_id").cast("long").alias("id_"))
    made = _by_bucket(rows).transformWithStateInPandas(_Firsts(seconds * 1_000_000), T.StructType([_KEY, _long("event_id"), _long("first_id")]), "append", "eventTime")
    return _with_keys(made, events, [key])
