"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.scratch import write_table

#: The sketch is wrong by at most one in so many ranks.
ACCURACY = 10_000


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """group, n and a column for each name: the value at a rank of the group's non-null values in rising order.

    ranks: name to (share, function of n giving the rank, from 0); the rank must lie within one of share * n. n is the number of values.

    A mergeable sketch brackets every rank between two values; the values below a bracket are only counted, and those in it are summed up by
    value before they are ordered. So what one task orders is about one in 2,500 of a group's values, or the distinct ones of them. Where a
    bracket misses its rank, which the counts would show, the whole range is taken instead.
    """
    named = write_table(rows.where(F.col(value).isNotNull()).select(F.struct(F.col(group).alias("key")).alias("g"), F.col(value).alias("v")), "values")
    names = list(ranks)
    near = 2.0 / ACCURACY
    shares = [s for s, _ in ranks.values()]
    low = F.percentile_approx("v", [max(0.0, s - near) for s in shares], ACCURACY)
    high = F.percentile_approx("v", [min(1.0, s + near) for s in shares], ACCURACY)
    ends = named.groupBy("g").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"), F.min("v").alias("least"), F.max("v").alias("most"))
    wanted = F.array(*[F.greatest(F.lit(0), F.least(F.col("n") - 1, rank(F.col("n")).cast("long"))) for _, rank in ranks.values()])
    ends = ends.withColumn("rank", wanted)
    # A small group is one bracket: its smallest and largest values.
    edge = lambda c, end, i: F.when((F.col("n") < ACCURACY) | (F.lit(shares[i] - near) <= 0 if end == "least" else F.lit(shares[i] + near) >= 1), F.col(end)).otherwise(F.get(c, F.lit(i)))
    bracket = write_table(ends.select("g", "n", "least", "most", F.posexplode(F.arrays_zip("rank", F.array(*[edge("low", "least", i) for i in range(len(names))]).alias("low"), F.array(*[edge("high", "most", i) for i in range(len(names))]).alias("high"))).alias("i", "x")).select("g", "n", "least", "most", "i", "x.*"), "brackets")
    per_group = bracket.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("b"))  # one entry a rank
    counted = named.join(per_group, "g").select("g", *[F.when(F.col("v") < F.get("b", F.lit(i)).low, 1).otherwise(0).alias(f"b{i}") for i in range(len(names))], *[F.when(F.col("v") <= F.get("b", F.lit(i)).high, 1).otherwise(0).alias(f"u{i}") for i in range(len(names))])
    sums = counted.groupBy("g").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]])
    sums = sums.select("g", F.posexplode(F.array(*[F.struct(F.col(f"b{i}").alias("below"), F.col(f"u{i}").alias("upto")) for i in range(len(names))])).alias("i", "y")).select("g", "i", "y.*")
    hit = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("upto"))
    checked = bracket.join(sums, ["g", "i"]).select("g", "i", "n", "rank", F.when(hit, F.col("low")).otherwise(F.col("least")).alias("low"), F.when(hit, F.col("high")).otherwise(F.col("most")).alias("high"), F.when(hit, F.col("below")).otherwise(0).alias("below"))
    brackets = write_table(checked, "brackets")
    inside = named.join(brackets.groupBy("g").agg(F.collect_list(F.struct("i", "low", "high")).alias("b")), "g").select("g", "v", F.explode(F.filter("b", lambda b: (b.low <= F.col("v")) & (F.col("v") <= b.high))).alias("b")).groupBy("g", F.col("b.i").alias("i"), "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("g", "i").orderBy("v"))
    placed = inside.withColumn("upto", upto).join(brackets.select("g", "i", "n", "rank", "below"), ["g", "i"])
    found = placed.where((F.col("below") + F.col("upto") > F.col("rank")) & (F.col("below") + F.col("upto") - F.col("m") <= F.col("rank")))
    return found.groupBy(F.col("g.key").alias(group), "n").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(names)])


def linear(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group, n and for each name the percentile between the two nearest ranks."""
    both = {}
    for name, q in shares.items():
        both[f"{name}_lo"] = (q, lambda n, q=q: F.floor((n - 1) * q))
        both[f"{name}_hi"] = (q, lambda n, q=q: F.ceil((n - 1) * q))
    at = at_ranks(rows, group, value, both)
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return at.select(group, "n", *[(F.col(f"{name}_lo") + part(q) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))).alias(name) for name, q in shares.items()])


def nearest(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group, n and for each name the value at the nearest rank from above."""
    return at_ranks(rows, group, value, {name: (q, lambda n, q=q: F.greatest(F.lit(1), F.ceil(n * q - 1e-9)) - 1) for name, q in shares.items()})


def rounded(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group, n and for each name the value at the half-even rounded index (n - 1) * share."""
    return at_ranks(rows, group, value, {name: (q, lambda n, q=q: F.rint((n - 1) * q)) for name, q in shares.items()})
