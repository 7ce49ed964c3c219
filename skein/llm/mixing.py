"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, body, prefix_sums, slot_count, slot_of, slot_offsets, write_table

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
_OWN = ("doc_id", "source", "size", "source_size", "target", "taken")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds each source's target to (skey, source, source_size).

    The sources weigh ``weights`` in turn, by code point, null last. Together they get
    what they all hold; none gets over ``most`` times its own size, and what it leaves is
    shared again by weight. The fixed point is a water level L: target = min(weight * L,
    most * size), found from prefix sums over the sources ordered by most * size / weight.
    One row for each source: small whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    s = s.withColumn("turn", F.row_number().over(order))
    # Before the first source that isn't full the levels only serve to find it.
    s = s.withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("turn", "level"))).over(Window.partitionBy()).getField("level"))
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap")).otherwise(F.col("w") * F.col("water"))
    return s.select("skey", "source_size", target.alias("target"))


def _sized(docs: DataFrame, payload: list[str]) -> DataFrame:
    """doc_id, source, the payload as _p0, _p1 ..., and what orders and weighs the documents."""
    return docs.select(
        "doc_id", "source", *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(payload)],
        F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit(""))).alias("skey"),
        F.regexp_count(body(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(body().cast("binary"))).cast("binary")).alias("key"),
    )


def _placed(docs: DataFrame, payload: list[str], weights: tuple[int, ...], most: int) -> DataFrame:
    """doc_id, source, _p0, _p1 ..., size, source_size, target, taken."""
    sized = write_table(_sized(docs, []), "sizes")
    slots = slot_count(sized.count())
    slotted = sized.withColumn("slot", slot_of(F.col("key"), slots))
    sources = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    offsets = slot_offsets(slotted, "skey", "size").join(source_targets(sources, weights, most), "skey")
    if payload:
        slotted = _sized(docs, payload).withColumn("slot", slot_of(F.col("key"), slots))
    placed = prefix_sums(slotted, "skey", "key", "size", ["doc_id", "size"], offsets)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    taken = (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    return placed.select("doc_id", "source", *[f"_p{i}" for i in range(len(payload))], "size", "source_size", "target", taken)


def mix_sources(docs: DataFrame, payload: list[str] | tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, payload, size, source_size, target, taken.

    Each source's documents stand in the order of a hash of doc_id and text; prefix sums of their
    sizes are built from sums over equal ranges of that key, so no source is ordered in one task.
    The source's budget is its target, rounded: whole epochs of all its documents, then
    documents from the start of the order, and of the one at the cut the words that are left.

    Null or empty texts have size 0 and take 0. A null source is a source of its own,
    the last; "" is another. Rows that repeat a doc_id are documents of their own; those that
    repeat its text too are alike, so whichever is cut, the words are the same. No rows: no
    rows. Of other columns only payload is carried, and of that not what has the name of
    a column that is given anyway.
    """
    own = [c for c in dict.fromkeys(payload) if c not in _OWN]
    return _placed(docs, own, weights, most).toDF("doc_id", "source", *own, *_OWN[2:])


def repeat_taken(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: each document once for every epoch it is in, the last cut after the words taken.

    Documents of which nothing is taken go. n_chars, if it is there, follows the text.
    """
    carried = [c for c in columns if c not in ("doc_id", "source", "text")]
    mixed = _placed(docs, ["text", *carried], WEIGHTS, MOST_EPOCHS)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    left = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("long")
    text = F.when(left >= F.col("size"), F.col("_p0")).otherwise(first_words(F.col("_p0"), left))
    named = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("_text")} | {c: F.col(f"_p{i + 1}") for i, c in enumerate(carried)}
    if "n_chars" in columns:
        named["n_chars"] = F.length("_text").cast("long")
    return rows.withColumn("_text", text).select(*[named[c].alias(c) for c in columns])


def first_words(text, n):
    """The first n words, one space between them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), " ")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, '')))) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         CAST(3 * source_size AS DOUBLE) AS cap
  FROM sources),
levels AS (
  SELECT *, cap / w AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
turns AS (SELECT *, row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS turn FROM levels),
water AS (SELECT *, (SELECT level FROM turns WHERE ratio > level ORDER BY turn LIMIT 1) AS water FROM turns),
targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE w * water END AS target FROM water),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
            + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken
FROM placed
"""
