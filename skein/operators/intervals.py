"""Interval joins and gaps-and-islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(windows: DataFrame, spans: DataFrame, key: str, cell: int) -> DataFrame:
    """Pairs of a window [wa, wb] and a span [a, b] of the same key that touch, and their overlap.

    Time is cut into cells; each side is put into every cell it touches, so the join is on
    equality, and long histories of one key spread over many cells. A pair is kept in the
    one cell where it begins to overlap.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    both = windows.withColumn("_cell", cells("wa", "wb")).join(spans.withColumn("_cell", cells("a", "b")), [key, "_cell"]).where("a <= wb and b >= wa")
    once = both.where(F.floor(F.greatest("a", "wa") / cell) == F.col("_cell")).drop("_cell")
    return once.withColumn("overlap", F.least("b", "wb") - F.greatest("a", "wa"))


def islands(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds island: the number of the run of equal values that the row is in, from 1."""
    w = Window.partitionBy(key).orderBy(order)
    change = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("long")
    return rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")


def evenly_spaced(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """The rows at i * n // size, for i from 0, of each key."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor(i * F.col("_n") / size))
    return placed.where(F.array_contains(wanted, F.col("_at").cast("long"))).drop("_at", "_n")


def weighted_scores(targets: DataFrame, windows: DataFrame, key: str, id: str, cell: int, top: int = 5, least: float = 0.0) -> DataFrame:
    """(id, name, score, place): of each target [a, b] the first ``top`` scores, those under ``least`` left out.

    windows: key, wa, wb, scores (an array of name and score). A score is the mean over the windows that
    overlap the target, weighted by the overlap; a window with a bound missing weighs one, in every target of its key;
    a window that doesn't name the score counts as zero. Where nothing has weight the key's first window stands in
    (by wa, then wb, nulls last). Ties go by name.

    Windows with a bound missing are summed up once for each key, so they don't meet its targets one by one.
    """
    open_end = F.col("wa").isNull() | F.col("wb").isNull()
    bounded = overlap_join(windows.where(~open_end), targets.select(F.col(id).alias("_id"), key, "a", "b"), key, cell).where("overlap > 0")
    met = bounded.select("_id", F.col("overlap").cast("double").alias("w"), "scores")
    loose = windows.where(open_end)
    loose_names = loose.select(key, F.inline("scores")).groupBy(key, "name").agg(F.sum("score").alias("s"))
    loose_n = loose.groupBy(key).agg(F.count("*").cast("double").alias("w"))
    of_key = targets.select(F.col(id).alias("_id"), key)
    total = met.groupBy("_id").agg(F.sum("w").alias("w")).unionAll(of_key.join(loose_n, key).select("_id", "w")).groupBy("_id").agg(F.sum("w").alias("total"))
    sums = met.select("_id", "w", F.inline("scores")).groupBy("_id", "name").agg(F.sum(F.col("score") * F.col("w")).alias("s"))
    sums = sums.unionAll(of_key.join(loose_names, key).select("_id", "name", "s")).groupBy("_id", "name").agg(F.sum("s").alias("s"))
    weighed = sums.join(total, "_id").select("_id", "name", (F.col("s") / F.col("total")).alias("score"))
    order = F.struct(F.col("wa").isNull(), "wa", F.col("wb").isNull(), "wb", F.to_json("scores"))
    first = windows.groupBy(key).agg(F.min_by("scores", order).alias("scores"))
    alone = of_key.join(total, "_id", "left_anti").join(first, key).select("_id", F.inline("scores")).groupBy("_id", "name").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("score"), "name"))
    found = weighed.unionAll(alone).withColumn("place", place).where((F.col("place") <= top) & (F.col("score") >= least))
    return found.select(F.col("_id").alias(id), "name", "score", "place")
