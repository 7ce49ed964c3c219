"""Is a labelled dataset fit for evaluation: counts, keys, digests, splits, coverage of tags, spread over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(samples: DataFrame, annotations: DataFrame, target: int, development: int, required: dict[str, int]) -> DataFrame:
    """(level, finding, detail, n): what is wrong (error) or doubtful (warning); no rows for a dataset without fault.

    samples: sample_id, digest (null: no recording), split (development, holdout or null), family, day, tags.
    annotations: sample_id, digest, tags. n is the count that gives offence: of rows, keys or families, or what a tag (detail)
    lacks of its ``required`` number. A family must lie in one split. Tags of both sides count, a repeated one each time.
    Rows with null keys count as rows of one key. Everything is counted by partial sums; no key's rows are gathered.
    """
    of_sample = samples.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "development").alias("dev"), F.count_if(F.col("split") == "holdout").alias("held"), F.count_if(F.col("digest").isNull()).alias("bare"), F.max("digest").alias("digest"))
    of_note = annotations.groupBy("sample_id").agg(F.count("*").alias("n_notes"))
    both = of_sample.join(of_note, F.equal_null(of_sample.sample_id, of_note.sample_id), "full").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "dev", "held", "bare")], F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n_notes") > 1).alias("notes_repeated"),
        F.count_if(F.col("n_notes").isNull()).alias("without_note"), F.count_if(F.col("n").isNull()).alias("unknown"))
    other = annotations.select("sample_id", F.col("digest").alias("noted")).join(of_sample.select("sample_id", "digest"), "sample_id")
    other = other.agg(F.count_if(F.col("digest").isNotNull() & ~F.col("noted").eqNullSafe(F.col("digest"))).alias("other_digest"))
    crossing = samples.where("split is not null").groupBy("family").agg((F.min("split") < F.max("split")).alias("crosses")).agg(F.count_if("crosses").alias("crossing"))
    days = samples.groupBy("day").agg(F.count("*").alias("n_day")).agg(F.coalesce(F.max("n_day"), F.lit(0)).alias("most"), F.count("*").alias("days"))
    facts = both.crossJoin(other).crossJoin(crossing).crossJoin(days)  # one row each
    n = F.col("n")

    def found(level: str, finding: str, count: Column | str, holds: Column | None = None) -> Column:
        count = F.col(count) if isinstance(count, str) else count
        return F.when(count > 0 if holds is None else holds, F.struct(F.lit(level).alias("level"), F.lit(finding).alias("finding"), F.lit(None).cast("string").alias("detail"), count.cast("long").alias("n")))

    rules = [
        found("error", "sample_count", n, n != target),
        found("error", "duplicate_sample_ids", "repeated"),
        found("error", "development_count", "dev", F.col("dev") != development),
        found("error", "holdout_count", "held", F.col("held") != target - development),
        found("error", "duplicate_annotation_ids", "notes_repeated"),
        found("error", "missing_annotations", "without_note"),
        found("error", "unknown_annotations", "unknown"),
        found("error", "annotation_audio_hash_mismatch", "other_digest"),
        found("error", "missing_audio", "bare"),
        found("error", "duplicate_group_crosses_splits", "crossing"),
        found("warning", "temporal_concentration_over_50_percent", "most", F.col("most") > 0.5 * n),
        found("warning", "fewer_than_5_capture_dates", "days", (n > 0) & (F.col("days") < 5)),
    ]
    general = facts.select(F.explode(F.array_compact(F.array(*rules))).alias("x")).select("x.*")
    tagged = samples.select(F.explode("tags").alias("tag")).unionAll(annotations.select(F.explode("tags").alias("tag"))).groupBy("tag").agg(F.count("*").alias("has"))
    wanted = samples.sparkSession.createDataFrame(sorted(required.items()), "tag string, least long")
    lacking = F.col("least") - F.coalesce("has", F.lit(0))
    lacks = wanted.join(tagged, "tag", "left").where(lacking > 0).select(F.lit("error").alias("level"), F.lit("tag_coverage_incomplete").alias("finding"), F.col("tag").alias("detail"), lacking.alias("n"))
    return general.unionAll(lacks)
