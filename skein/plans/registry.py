"""How the plan modules register queries: a function of (spark, sf_dir), and SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Bytes a core, below which a table of few files is dealt over all cores.
SMALL = 16 << 20


def _held(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder)


def tasks_for(spark: SparkSession, sf_dir: str, *names: str, size: int = 8 << 20) -> int:
    """Tasks for work that holds its rows in memory: one for each ``size`` bytes of the tables' files, and one a core at least."""
    held = sum(_held(spark, f"{sf_dir}/{name}.parquet").getLength() for name in names)
    return max(spark.sparkContext.defaultParallelism, -(-held // size))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; timestamps without zone are taken as UTC.

    spread: for work that costs much more than the reading. A table that is small for the cores, and has
    fewer files than there are cores, is dealt over all of them; any other is read as it lies.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if spread:
        cores, held = spark.sparkContext.defaultParallelism, _held(spark, path)
        if held.getFileCount() < cores and held.getLength() < SMALL * cores:
            df = df.repartition(cores)
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Short rows dealt over all cores, for work that costs much more than the dealing: a file of few row groups is read by as few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)
