"""Who and what may enter a corpus: recordings by their speaker, digests by their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(prefix: str, content: Column) -> Column:
    """An id that holds the content's hash: another content, another id."""
    return F.concat(F.lit(prefix + ":"), F.left(F.sha2(content, 256), F.lit(24)))


def decided_speakers(sources: DataFrame, decisions: DataFrame, id: str) -> DataFrame:
    """sources with speaker: self if the id was approved, else unknown, which is why such a source is kept apart.

    decisions: id, approved. Where ids hold a content hash, an edited source has lost its approval. Of several
    decisions on one id any refusal counts.
    """
    by_id = decisions.groupBy(id).agg(F.bool_and(F.coalesce("approved", F.lit(False))).alias("_approved"))
    speaker = F.when(F.col("_approved"), F.lit("self")).otherwise(F.lit("unknown"))
    return sources.join(by_id, id, "left").withColumn("speaker", speaker).drop("_approved")


def may_be_evaluated(digest: Column, speaker: Column, duplicate_of: Column, retry_of: Column, state: Column) -> Column:
    """A recording of the user's own, neither a copy nor a second try, and not excluded; a null state is no exclusion."""
    return digest.isNotNull() & speaker.eqNullSafe(F.lit("self")) & duplicate_of.isNull() & retry_of.isNull() & ~state.eqNullSafe(F.lit("excluded"))


def confident(rows: DataFrame, confidence: str, least: float = 0.65) -> DataFrame:
    """Digests of at least that confidence; without one they go."""
    return rows.where(F.col(confidence) >= least)
