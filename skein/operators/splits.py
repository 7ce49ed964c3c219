"""Splits into training and holdout rows that keep groups together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 4096


def hash_split(session: Column, holdout_percent: int = 20) -> Column:
    """By a hash of the session: all its rows fall on one side. The share is kept within 1 to 49 %."""
    share = max(1, min(49, holdout_percent))
    slot = F.conv(F.substring(F.sha2(session, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(slot < share, F.lit("holdout")).otherwise(F.lit("train"))


def temporal_group_split(rows: DataFrame, group: str, time: str, share: float = 0.8) -> DataFrame:
    """(group, first_at, last_at, split): the earliest groups by last time train, those that begin after the cutoff are held out.

    A group that crosses the cutoff is excluded. time is a whole number. The cutoff, the
    last time of the group at the share, is found in one of SLOTS equal ranges of time,
    and only that range's groups are ranked.
    """
    spans = rows.groupBy(group).agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"))
    ends = spans.agg(F.min("last_at").alias("low"), F.max("last_at").alias("high"), F.floor(F.count("*") * share).alias("wanted"))
    slotted = spans.join(F.broadcast(ends), F.lit(True)).withColumn("slot", F.floor((F.col("last_at") - F.col("low")) * SLOTS / (F.col("high") - F.col("low") + 1)))
    counts = slotted.groupBy("slot", "wanted").agg(F.count("*").alias("n"))  # at most SLOTS rows
    upto = F.sum("n").over(Window.orderBy("slot"))
    hit = counts.withColumn("upto", upto).where("upto >= wanted and upto - n < wanted").select("slot", (F.col("wanted") - F.col("upto") + F.col("n")).alias("nth"))
    inside = slotted.join(F.broadcast(hit), "slot").withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy("last_at", group)))
    cutoff = inside.where("rank = nth").agg(F.max("last_at").alias("cutoff"))  # one row, null without groups to train on
    split = F.when(F.col("last_at") <= F.col("cutoff"), F.lit("train")).when(F.col("first_at") > F.col("cutoff"), F.lit("holdout")).otherwise(F.lit("excluded"))
    return spans.join(F.broadcast(cutoff), F.lit(True)).select(group, "first_at", "last_at", split.alias("split"))


def leaking_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows on more than one side."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")
