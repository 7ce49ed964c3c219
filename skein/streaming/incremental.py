"""An index that grows batch by batch and takes no near-copies of what it holds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import dedup
from skein.sources.scratch import shared_folder, write_table

_SETS, _PREFIXES, _TOLD = "id long, s array<long>", "g long, id long, n int", "id long, duplicate_of long"


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(g, id, n): the elements that two sets at the threshold must share one of, in the order of their hashes."""
    n = F.size("s")
    return sets.where(n > 0).select(F.explode(F.slice("s", 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("g"), "id", n.alias("n"))


def _pairs_with(sets: DataFrame, held: DataFrame, prefixes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of a held set and a new one."""
    new = _prefixes(sets, threshold).select("g", F.col("id").alias("b"), F.col("n").alias("nb"))
    met = new.join(prefixes.select("g", F.col("id").alias("a"), F.col("n").alias("na")), "g").where((F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)).select("a", "b").distinct()
    both = met.join(held.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def index_stream(stream: DataFrame, id: str, text: str, tokens: Column, threshold: float = 0.92, base: str | None = None) -> DataFrame:
    """(id, duplicate_of): a row is taken up unless a similar one was taken up before it; then it is a duplicate of the most similar (ties: the smallest id).

    Similar: the Jaccard similarity of their token sets is at least ``threshold``. Rows without tokens are similar to those
    of the same text (null as empty). Ids must rise from batch to batch; then any cut of the stream into batches gives one result. ``base`` keeps the
    index, so that a later stream goes on from there.

    The index holds the sets that were taken up, and apart from them the few elements of each that a similar set must share: a
    batch is joined on those. Each batch writes folders of its own number, over what an interrupted try left there, and reads those of smaller
    numbers only. Copies within a batch are represented by their first.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/skein-index-{uuid.uuid4().hex}"

    def before(kind: str, schema: str, batch: int) -> DataFrame | None:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}")
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            return None
        return spark.read.schema(f"{schema}, batch long").parquet(f"{base}/{kind}").where(F.col("batch") < batch).drop("batch")

    def take(rows: DataFrame, batch: int) -> None:
        put = lambda df, kind: df.write.mode("overwrite").parquet(f"{base}/{kind}/batch={batch}")
        own = tokens if rows.select(tokens).schema[0].dataType == T.ArrayType(T.LongType()) else F.transform(tokens, lambda t: F.xxhash64(t))
        some = F.when(F.size(own) > 0, own).otherwise(F.array(F.xxhash64(F.concat(F.lit("\0"), F.coalesce(F.col(text), F.lit(""))))))
        sets = dedup.token_sets(rows.select(F.col(id).cast("long").alias("id"), some.alias("tokens")))
        firsts = write_table(dedup.representatives(sets), "firsts")
        pairs = dedup.similar_pairs(sets, threshold)
        if (held := before("sets", _SETS, batch)) is not None:
            new = sets.join(firsts.where("id > first").select("id"), "id", "left_anti")
            pairs = pairs.unionByName(_pairs_with(new, held, before("prefixes", _PREFIXES, batch), threshold))
        told = write_table(dedup.greedy_keepers(sets.select("id"), write_table(pairs, "pairs"), firsts), "told")
        # Few are left out, so that their ids go to where the sets are.
        gone = write_table(told.where("duplicate_of is not null").select("id"), "gone")
        put(sets.where("id is not null").join(gone, "id", "left_anti").select("id", "s"), "sets")
        put(_prefixes(spark.read.schema(_SETS).parquet(f"{base}/sets/batch={batch}"), threshold), "prefixes")
        put(told, "told")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/state-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    told = before("told", _TOLD, 2**62)
    return spark.createDataFrame([], _TOLD) if told is None else told
