"""Calibration statistics over (p, y[, group]) rows; p in [0, 1], y 0 or 1."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import sigmoid

SLOTS = 4096


def ece_equal_width(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width; the last holds 1.0 too."""
    b = rows.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"))
    return b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def ece_equal_mass(rows: DataFrame, most_bins: int = 10) -> DataFrame:
    """The same over bins of equal mass whose edges move to the end of a run of ties.

    Ties of p are reduced to one row first; permuting tied rows changes nothing. The running
    sum is taken in slots of p, on top of the sums of the slots before, so no task sees all values.
    """
    values = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("y")).withColumn("slot", F.floor(F.col("p") * SLOTS))
    slots = values.groupBy("slot").agg(F.sum("n").alias("slot_n"))  # at most SLOTS + 1 rows
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("slot", F.coalesce(F.sum("slot_n").over(earlier), F.lit(0)).alias("before"), F.sum("slot_n").over(Window.partitionBy()).alias("total"))
    values = values.join(slots, "slot").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("slot").orderBy("p")))
    values = values.withColumn("bins", F.least(F.lit(most_bins), F.greatest(F.lit(1), F.floor(F.col("total") / 20))))
    # An edge falls into the first run of ties that reaches round(b * total / bins).
    edges_before = F.expr("size(filter(sequence(1, int(bins)), b -> greatest(1L, cast(rint(b * total / bins) as long)) <= upto - n))")
    b = values.groupBy(edges_before.alias("bin")).agg(F.sum("n").alias("n"), (F.sum("y") / F.sum("n")).alias("acc"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("conf"))
    return b.agg(F.sum("n").alias("n"), F.count("*").alias("n_bins"), F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def brier_logloss(rows: DataFrame) -> DataFrame:
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    return rows.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"), F.round(F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))), 6).alias("log_loss"))


def selective_risk(rows: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """For each threshold what is answered, and how often that is wrong; one pass over the rows."""
    hit = rows.select("y", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("p") >= t).alias("taken")) for t in thresholds])).alias("x"))
    taken = F.count_if("x.taken")
    return hit.groupBy(F.col("x.threshold").alias("threshold")).agg(taken.alias("support"), F.round(taken / F.count("*"), 6).alias("coverage"), F.round(1 - F.avg(F.when(F.col("x.taken"), F.col("y"))), 6).alias("risk"))


def platt_fit(rows: DataFrame, penalty: float = 1e-3, rounds: int = 200, tolerance: float = 1e-9, least_slope: float = 0.0) -> DataFrame:
    """Slope (least_slope at least; -inf: any) and intercept of a logistic fit, by Newton steps.

    Each step is one aggregate of six sums over the distributed rows; only those reach the driver.
    """
    a, b = 1.0, 0.0
    steps = 0
    for steps in range(1, rounds + 1):
        q = sigmoid(F.lit(a) * F.col("p") + F.lit(b))
        w = q * (1 - q)
        s = rows.agg(F.sum((q - F.col("y")) * F.col("p")), F.sum(q - F.col("y")), F.sum(w * F.col("p") * F.col("p")), F.sum(w * F.col("p")), F.sum(w), F.count("*")).first()
        if not s[5]:
            break
        ga, gb, haa, hab, hbb = s[0] + penalty * a, s[1], s[2] + penalty, s[3], s[4] + 1e-12
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(least_slope, a - da), b - db
        if math.hypot(da, db) < tolerance:
            break
    return rows.sparkSession.createDataFrame([(a, b, steps)], "slope double, intercept double, steps int")


def bootstrap_interval(rows: DataFrame, repetitions: int = 1000, seed: int = 17) -> DataFrame:
    """The 95 % interval of mean(y) when whole groups are drawn with replacement; null under 20 groups.

    A group's weight in a repetition is Poisson(1), from a hash of group and repetition, so no
    group table is multiplied out on one machine and reruns agree.
    """
    groups = rows.groupBy("group").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    u = (F.pmod(F.xxhash64("group", "rep", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    cumulative, times, p = 0.0, F.lit(0), math.exp(-1)
    for i in range(1, 9):
        cumulative += p
        times = times + (u >= cumulative).cast("int")
        p /= i
    drawn = groups.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(max(100, min(10_000, repetitions)))))).withColumn("times", times)
    means = drawn.groupBy("rep").agg(F.try_divide(F.sum(F.col("y") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("mean"), F.count("*").alias("groups"))
    enough = F.max("groups") >= 20
    return means.agg(F.max("groups").alias("n_groups"), F.when(enough, F.percentile("mean", 0.025)).alias("low"), F.when(enough, F.percentile("mean", 0.975)).alias("high"))
