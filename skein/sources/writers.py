"""Sinks: JSON lines, versioned publication, append-only traces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON record a line; Spark's commit protocol shows all files or none."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def publish(rows: DataFrame, base: str, name: str) -> str:
    """Writes a new version beside the old ones, then its pointer; readers see one or the other. Returns the version."""
    version = uuid.uuid4().hex
    rows.write.parquet(f"{base}/{name}/version={version}")
    spark = rows.sparkSession
    order = published(spark, base, name).count() + 1 if _exists(spark, f"{base}/{name}/_pointers") else 1
    spark.createDataFrame([(order, version)], "at long, version string").coalesce(1).write.mode("append").json(f"{base}/{name}/_pointers")
    return version


def published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Every pointer ever written, newest last."""
    return spark.read.schema("at long, version string").json(f"{base}/{name}/_pointers").orderBy("at")


def read_published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The newest published version; the older ones remain as backups."""
    newest = published(spark, base, name).agg(F.max_by("version", "at").alias("v")).first().v
    return spark.read.parquet(f"{base}/{name}/version={newest}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_traces(batch: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key isn't stored yet: for foreachBatch, so that a retried batch writes once."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(key)
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
