"""Streams over a file source: windows, late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.scratch import shared_folder


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's Parquet files as a stream; timestamps without zone are taken as UTC.

    All files are one batch unless files_per_batch is given: then rows that lie behind the
    watermark of earlier batches are late, so files must be in the order of time.
    """
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    # A table is one file or a folder of files; the source lists folders.
    status = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = status.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(status).isFile()
    df = stream.option("pathGlobFilter", f"{name}.parquet").load(sf_dir) if is_file else stream.load(path)
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_available(out: DataFrame, mode: str = "append", keyed: bool = False) -> DataFrame:
    """Runs the stream over all that is there, into a table of the shared folder. keyed: its state has several parts or timers."""
    spark = out.sparkSession
    base = f"{shared_folder(spark)}/skein-stream-{uuid.uuid4().hex}"
    if keyed:
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    started = out.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    if keyed:
        spark.conf.unset(_STORE)  # the query has its own copy
    started.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def bucket_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts in tumbling windows; a window is given out once the watermark has passed it."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
