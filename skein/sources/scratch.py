"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session may lack it; it then gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-skein-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def write_table(df: DataFrame, tag: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again.

    The table lives as long as the folder, as Spark's own checkpoint files do. A loop names
    its last round's table in ``instead_of``, which is deleted once the new one is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skein-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.skein_path = path
    if instead_of is not None and (old := getattr(instead_of, "skein_path", None)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return made
