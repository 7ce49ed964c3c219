"""Duplicates by overlap with what was kept a short while before."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_islands(rows: DataFrame, key: str, start: str, end: str, id: str, cell: int) -> DataFrame:
    """Adds island: the start of the run of overlapping intervals that the row is in.

    Intervals that only touch don't overlap. Time is cut into cells; what earlier cells reach, and
    where their last run began, is carried from one row a cell, so a key of very many rows is spread
    over as many tasks as it has cells.
    """
    slotted = rows.withColumn("_slot", F.floor(F.col(start) / cell))
    inside = Window.partitionBy(key, "_slot").orderBy(start, id)
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    reach = slotted.groupBy(key, "_slot").agg(F.max(end).alias("_end")).select(key, "_slot", F.max("_end").over(before).alias("_reached"))
    met = slotted.join(reach, [key, "_slot"])
    reached = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reached"))
    met = met.withColumn("_fresh", F.when(reached.isNull() | (F.col(start) >= reached), F.col(start)))
    last = met.groupBy(key, "_slot").agg(F.max("_fresh").alias("_last")).select(key, "_slot", F.max("_last").over(before).alias("_carried"))
    own = F.max("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return met.join(last, [key, "_slot"]).withColumn("island", F.coalesce(own, F.col("_carried"))).drop("_slot", "_reached", "_fresh", "_carried")


def _scan(share: float, most: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, kept = None, deque(maxlen=most)
        for batch in batches:
            ids, of = [], []
            for key, island, id, side, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "island", "id", "side", "a", "b"))):
                if run != (key, island):
                    run = key, island
                    kept.clear()
                found = None
                for other, other_side, other_a, other_b in reversed(kept):
                    shorter = min(b - a, other_b - other_a)
                    if side != other_side and shorter > 0 and min(b, other_b) - max(a, other_a) >= share * shorter:
                        found = other
                        break
                if found is None:
                    kept.append((id, side, a, b))
                ids.append(id)
                of.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(of, pa.int64())], names=["id", "duplicate_of"])

    return emit


def mark_overlaps(rows: DataFrame, key: str, id: str, side: str, start: str, end: str, cell: int, share: float = 0.8, most: int = 30) -> DataFrame:
    """(id, duplicate_of): an interval that overlaps one of the last ``most`` kept ones of another side by ``share`` of the shorter is its duplicate.

    In the order of start and id; the latest that matches holds; duplicates aren't kept, so nothing is a
    duplicate of them. Only intervals of one run of overlapping ones can match, and whatever is kept
    between two that overlap is in their run too, so runs are decided apart: rows are dealt by run, sorted, and
    read once with the last ``most`` kept ones in hand. Null keys are one key; a null side is a side; rows without a
    start or end are kept.
    """
    named = rows.select(F.col(id).cast("long").alias("id"), F.col(key).alias("key"), F.col(side).alias("side"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b"))
    whole = named.where("a is not null and b is not null").withColumn("key", F.coalesce(F.col("key").cast("string"), F.lit("\0")))
    runs = overlap_islands(whole, "key", "a", "b", "id", cell).select("key", "island", "id", "side", "a", "b")
    dealt = runs.repartition("key", "island").sortWithinPartitions("key", "island", "a", "id")
    return dealt.mapInArrow(_scan(share, most), "id long, duplicate_of long").unionAll(named.where("a is null or b is null").select("id", F.lit(None).cast("long").alias("duplicate_of")))
