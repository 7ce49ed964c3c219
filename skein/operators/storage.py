"""Writes as batch transforms: old rows and new rows give the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """First wins: new rows whose key is not there yet; of several of a key the first by order."""
    fresh = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("_row")).select("_row.*")
    return old.unionByName(fresh.join(old.select(key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str, sequence: str, created: str) -> DataFrame:
    """Last wins by sequence, but created stays that of the first."""
    rows = old.unionByName(new)
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), sequence).alias("_row"), F.min(created).alias("_created"))
    return latest.select("_row.*", "_created").withColumn(created, F.col("_created")).drop("_created")


def immutable_conflicts(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that both sides have with another digest: an append must not go through while there are any."""
    return old.select(key, F.col(digest).alias("old_digest")).join(new.select(key, F.col(digest).alias("new_digest")), key).where("old_digest <> new_digest")


def append_immutable(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """old and the keys that are new; an error, and nothing written, if a known key has another digest."""
    conflicts = immutable_conflicts(old, new, key, digest)
    if not conflicts.isEmpty():
        raise ValueError(f"{conflicts.count()} keys are already stored with another {digest}")
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def partial_update(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Only the columns that the patch gives a value for change."""
    given = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in given])
    return old.join(renamed, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in old.columns])


def status_events(old: DataFrame, patch: DataFrame, key: str, status: str) -> DataFrame:
    """(key, before, after): one event for each known row whose status a patch gives another value."""
    both = old.select(key, F.col(status).alias("before")).join(patch.where(F.col(status).isNotNull()).select(key, F.col(status).alias("after")), key)
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def keep_days(rows: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """The table without what is older than ``days`` (held between 1 and 365) before now; rows without a time stay."""
    old = F.col(time) < now - F.make_interval(days=F.lit(max(1, min(days, 365))))
    return rows.where(~F.coalesce(old, F.lit(False)))


def keep_generation(rows: DataFrame, generation: str, current: Column) -> DataFrame:
    """The table without rows of any generation but the current one; rows without a generation go too."""
    return rows.where(F.col(generation) == current)


def newest_of_session(takes: DataFrame, session: str, order: list[str], kept: int = 500, shown: int = 100) -> DataFrame:
    """What a session's state shows: its newest ``shown`` takes of the ``kept`` it holds, place 1 the newest, and how many it holds.

    Takes beyond ``kept`` are forgotten, the oldest first. order must tell a session's takes apart.
    """
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    last = takes.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= kept)
    held = last.groupBy(session).agg(F.count("*").alias("n_kept"))
    return last.where(F.col("place") <= shown).join(held, session)


def alive(expires_at: Column, now: Column) -> Column:
    """Rows without an expiry, or with one that can't be read, stay."""
    return ~F.coalesce(F.try_to_timestamp(expires_at) <= now, F.lit(False))


def changed_or_new(indexed: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows to index again: unknown keys, and known ones whose content has another hash."""
    same = indexed.select(key, digest)
    return current.join(same, [key, digest], "left_anti")


def guarded_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, status, payload, outcome from two tables (id, kind, content, status, payload), ids unique in each.

    Another kind or content under a known id is a conflict and changes nothing; only
    pending rows take the new payload; unknown ids are inserted.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    other = (F.col("o.kind") != F.col("n.kind")) | (F.col("o.content") != F.col("n.content"))
    outcome = F.when(F.col("o.id").isNull(), "inserted").when(F.col("n.id").isNull(), "kept").when(other, "conflict").when(F.col("o.status") == "pending", "updated").otherwise("decided")
    payload = F.when(outcome.isin("inserted", "updated"), F.col("n.payload")).otherwise(F.col("o.payload"))
    return both.select(F.coalesce("o.id", "n.id").alias("id"), F.coalesce("o.status", "n.status").alias("status"), payload.alias("payload"), outcome.alias("outcome"))
