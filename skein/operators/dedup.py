"""Exact and near-duplicate operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import words
from skein.sources.scratch import write_table


def first_of_each(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of every key. An aggregate, so copies of a hot key are reduced before the shuffle."""
    whole = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_row"))
    return whole.select("_row.*")


def with_first_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds first_id: the smallest order value of the row's key."""
    return rows.join(rows.groupBy(key).agg(F.min(order).alias("first_id")), key)


#: Buckets of tokens by a hash, as bits, at most; and those in a part that is sent.
_MOST_BITS, _PART_BITS = 25, 16
#: Sets that a task puts in order at a time.
_SETS = 500


def token_sets(rows: DataFrame) -> DataFrame:
    """(id, n, key, s): each row's token set as sorted hashes, written; rows: id, tokens, and maybe text.

    key is alike for equal sets (by 128 bits), and for rows without tokens for equal texts.
    """
    tokens = F.col("tokens") if rows.schema["tokens"].dataType == T.ArrayType(T.LongType()) else F.transform("tokens", lambda t: F.xxhash64(t))
    text = F.coalesce("text", F.lit("")) if "text" in rows.columns else F.lit("")
    of_set = F.concat(F.lit("s"), F.hex(F.xxhash64("s")), F.lit(","), F.hex(F.xxhash64(F.lit(1), "s")))
    key = F.when(F.size("s") > 0, of_set).otherwise(F.concat(F.lit("t"), F.sha2(text, 256)))
    return write_table(rows.withColumn("s", F.array_sort(tokens)).select("id", F.greatest(F.size("s"), F.lit(0)).alias("n"), key.alias("key"), "s"), "sets")


def _bucket(tokens: np.ndarray, bits: int) -> np.ndarray:
    return ((tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _bucket_counts(bits: int):
    """A task's counts of tokens by a hash of theirs, held at 65535, in parts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            at, n = np.unique(_bucket(_flat(batch.column("s")), bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 65535)
        for part in range(1 << max(0, bits - _PART_BITS)):
            some = counts[part << _PART_BITS : (part + 1) << _PART_BITS]
            if some.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())})

    return emit


def _weights(bits: int):
    """The tasks' counts summed as they stream by, a part after another, as a byte each that rises with them: 0 up to one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(1 << min(bits, _PART_BITS), np.int64)
        done = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "weights": pa.array([np.ceil(6 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()], pa.binary())})
        for batch in batches:
            for now, counts in zip(batch.column("part"), batch.column("counts")):
                if now.as_py() != part:
                    if part is not None:
                        yield done()
                    part, total = now.as_py(), np.zeros_like(total)
                total += np.frombuffer(zlib.decompress(counts.as_py()), np.uint16)
        if part is not None:
            yield done()

    return emit


def _first_tokens(weights, bits: int, threshold: float):
    """Of each set the tokens that a similar one must share one of, lightest first, without those that no other set holds."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = weights.value
        for batch in (b.slice(at, _SETS) for b in batches for at in range(0, b.num_rows, _SETS)):
            n, g = batch.column("n").to_numpy(), _flat(batch.column("s"))
            row, weight = np.repeat(np.arange(len(n)), n), of_bucket[_bucket(g, bits)]
            order = np.lexsort((g, weight, row))
            place = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
            there = (place <= (n - np.ceil(n * threshold - 1e-9))[row]) & (weight[order] > 0)
            at = pa.array(row[there])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("n").take(at), batch.column("k").take(at), pa.array(g[order][there])], names=["id", "n", "k", "g"])

    return emit


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) for all pairs of different token sets at or over the threshold; rows: id, tokens, or what :func:`token_sets` gives.

    An exact join. Rows with the same set are represented by the smallest id. Tokens are
    put in an order, rarest first; two sets that meet the threshold share a token among the first
    n - ceil(t * n) + 1 of each, so only those leave the task and are joined on, and common tokens
    hardly ever are. Any order that all tasks share is right: this one is by counts of hashed
    tokens in a table of fixed size, then by the token. Empty sets have no pairs.
    """
    sets = rows if "key" in rows.columns else token_sets(rows)
    spark = sets.sparkSession
    sets = sets.where("n > 0")
    total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    bits = max(8, min(_MOST_BITS, (4 * total).bit_length()))
    parts = sets.select("s").mapInArrow(_bucket_counts(bits), "part int, counts binary").repartition("part").sortWithinPartitions("part").mapInArrow(_weights(bits), "part int, weights binary")
    weights = np.zeros(1 << bits, np.uint8)
    for r in parts.collect():  # 32 MB at most
        weights[r.part << _PART_BITS : (r.part << _PART_BITS) + len(r.weights)] = np.frombuffer(r.weights, np.uint8)
    firsts = sets.groupBy("key").agg(F.min("id").alias("first"))
    copies = write_table(sets.select("id", "key").join(firsts, "key").where("id > first").select("id", F.xxhash64("key").alias("k")), "copies")
    kind = sets.schema["id"].dataType.simpleString()
    prefix = sets.select("id", "n", F.xxhash64("key").alias("k"), "s").mapInArrow(_first_tokens(spark.sparkContext.broadcast(weights), bits, threshold), f"id {kind}, n int, k long, g long")
    prefix = write_table(prefix.join(copies, ["id", "k"], "left_anti").drop("k"), "prefixes")
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g")
    pairs = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "g").join(other, "g").where("a < b").where((F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)).select("a", "b").distinct()
    pairs = write_table(pairs, "met")
    met = write_table(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "met")
    some = sets.join(met, "id", "left_semi").withColumn("k", F.xxhash64("key")).join(copies, ["id", "k"], "left_anti").dropDuplicates(["id", "k"])
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(some.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


#: Runs of the smaller side that are broadcast, at 24 bytes each, and no more.
MOST_RUNS = 2_000_000


def shared_runs(many: DataFrame, many_id: str, few: DataFrame, few_id: str, text: str, width: int) -> DataFrame:
    """(many_id, few_id, n_shared): the distinct runs of ``width`` words that two texts share.

    A run is told by two hashes of 64 bits. If those of ``few`` are not too many they are broadcast, so
    nearly all runs of ``many`` go where they are made; else both sides are dealt by them.
    """

    def runs(rows: DataFrame, id: str) -> DataFrame:
        # Arrays around the words and their hashes bind them, so that they are made once and not for every run.
        hashed = F.transform(F.array(words(F.col(text))), lambda ws: F.struct(F.transform(ws, lambda w: F.xxhash64(w)).alias("h"), F.transform(ws, lambda w: F.xxhash64(w, F.lit(1))).alias("g")))
        one = lambda x, i: F.struct(F.xxhash64(F.slice(x.h, i, width)).alias("h"), F.xxhash64(F.slice(x.g, i, width)).alias("g"))
        each = F.transform(hashed, lambda x: F.when(F.size(x.h) >= width, F.transform(F.sequence(F.lit(1), F.size(x.h) - (width - 1)), lambda i: one(x, i))))
        return rows.select(F.col(id), F.inline(F.flatten(each)))

    small = write_table(runs(few, few_id).distinct(), "runs")
    side = F.broadcast(small) if small.count() <= MOST_RUNS else small
    return runs(many, many_id).join(side, ["h", "g"]).distinct().groupBy(many_id, few_id).agg(F.count("*").alias("n_shared"))


def representatives(rows: DataFrame) -> DataFrame:
    """(id, first): the smallest id with the row's token set, or without tokens with its text; rows: id, text, tokens, or what :func:`token_sets` gives.

    ``first`` is the id that :func:`similar_pairs` has for the set.
    """
    keyed = (rows if "key" in rows.columns else token_sets(rows)).select("id", "key")
    return with_first_id(keyed, "key", "id").select("id", F.col("first_id").alias("first"))


def greedy_keepers(ids: DataFrame, pairs: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """(id, duplicate_of): in the order of ids a row is kept unless a kept earlier one is similar.

    Rounds over the links: a row whose earlier neighbours are all decided is decided too,
    as a duplicate of its most similar kept one (ties: the smallest id) or as kept.

    firsts: what :func:`representatives` gives, where pairs has representatives only. A copy
    is then a duplicate of its representative, or if that is one itself, of the most similar
    kept row before the copy.
    """
    links = write_table(pairs.select(F.col("b").alias("id"), F.col("a").alias("before"), "jaccard"), "greedy")
    undecided = links.select("id").distinct()
    state = write_table(links.select(F.col("before").alias("id")).distinct().join(undecided, "id", "left_anti").select("id", F.lit(None).cast("long").alias("duplicate_of")), "greedy")
    while True:
        open_rows = links.join(state.select("id"), "id", "left_anti")
        earlier = open_rows.join(state.select(F.col("id").alias("before"), F.col("duplicate_of").alias("of"), F.lit(1).alias("known")), "before", "left")
        ready = earlier.groupBy("id").agg(F.min(F.coalesce("known", F.lit(0))).alias("all_known"), F.min(F.when(F.col("known").isNotNull() & F.col("of").isNull(), F.struct((-F.col("jaccard")).alias("j"), "before"))).getField("before").alias("duplicate_of"))
        new = write_table(ready.where("all_known = 1").select("id", F.col("duplicate_of").cast("long")), "greedy")
        if new.isEmpty():
            break
        state = write_table(state.unionByName(new), "greedy")
    if firsts is None:
        return ids.join(state, "id", "left").select("id", "duplicate_of")
    # What a duplicate's copies may be duplicates of: its kept neighbours, which are unlike one another and so few.
    kept = state.where("duplicate_of is null").select(F.col("id").alias("near"))
    both = links.select("id", F.col("before").alias("near"), "jaccard").unionByName(links.select(F.col("before").alias("id"), F.col("id").alias("near"), "jaccard"))
    options = both.join(kept, "near").groupBy("id").agg(F.collect_list(F.struct((-F.col("jaccard")).alias("j"), "near")).alias("options"))
    gone = state.where("duplicate_of is not null").join(options, "id").select(F.col("id").alias("first"), "options")
    best = F.array_min(F.filter("options", lambda x: x.near < F.col("id"))).getField("near")
    found = F.when(F.col("options").isNotNull(), best).otherwise(F.when(F.col("first") != F.col("id"), F.col("first")))
    return ids.join(firsts, "id", "left").join(gone, "first", "left").select("id", found.cast("long").alias("duplicate_of"))


@F.pandas_udf(T.DoubleType())
def character_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of two strings."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def similar_short_texts(rows: DataFrame, token_share: float, character_share: float) -> DataFrame:
    """(a, b, ratio) of short texts that share enough tokens and characters; rows: id, text.

    Different texts are compared by their first ids, also if their token sets are equal. A
    copy is paired with its first, at a ratio of one; its other pairs are those of that one.
    Empty texts have no pairs.
    """
    members = write_table(with_first_id(rows.where("text <> ''").select("id", "text"), "text", "id"), "short")
    firsts = members.where("id = first_id").select("id", "text", F.array_distinct(F.split("text", " ")).alias("tokens"))
    of_set = write_table(firsts.join(representatives(firsts), "id").select("id", "text", "first"), "short")
    sets = similar_pairs(firsts.select("id", "tokens"), token_share).select("a", "b")
    same = of_set.groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select(F.col("first").alias("a"), F.col("first").alias("b"))
    one, two = (of_set.select(F.col("first").alias(side), F.col("id").alias(f"i{side}"), F.col("text").alias(f"t{side}")) for side in "ab")
    both = sets.unionByName(same).join(one, "a").join(two, "b").where("a <> b or ia < ib")
    # The earlier of two texts comes first, whichever set's id is smaller.
    lower = F.col("ia") < F.col("ib")
    texts = both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.when(lower, F.col("ta")).otherwise(F.col("tb")).alias("ta"), F.when(lower, F.col("tb")).otherwise(F.col("ta")).alias("tb"))
    near = texts.select("a", "b", character_ratio("ta", "tb").alias("ratio")).where(F.col("ratio") >= character_share)
    return near.unionByName(members.where("id > first_id").select(F.col("first_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("ratio")))
