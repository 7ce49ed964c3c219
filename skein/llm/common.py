"""What several operators share: hashing of words, prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources.scratch import shared_folder, write_table  # noqa: F401  the operators take them from here

#: Stands for a null doc_id in sort keys and joins: below every other id.
NULL_ID = -(2**63)
#: The words of a text, as a regular expression that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"

def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def body(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def id_or_lowest(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def text_tag(text: str = "text") -> Column:
    """64 bits of the text, which tell apart rows that repeat a doc_id, or have none, with other texts."""
    return F.xxhash64(body(text))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``rows``; what Arrow holds of read ones goes back, since Python workers live on after a task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


# Hashing. All arithmetic is modulo 2**64.

_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "again": 0xAF251AF3B0F025B5}
_BLOCK = 1 << 18
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    if kind not in _tables or len(_tables[kind][0]) < n:
        size = max(n, _BLOCK + 64)
        base = _BASE[kind]
        with np.errstate(over="ignore"):
            made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 2**64)))
        if n > 4 * _BLOCK:
            return made
        _tables[kind] = made
    return _tables[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _word_hashes_of(a: np.ndarray) -> np.ndarray:
    gap = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers("byte", len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE["again"]))


def word_hashes(data: bytes) -> np.ndarray:
    """64 bits for each word of a UTF-8 text, in order."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= _BLOCK:
        return _word_hashes_of(a)
    parts, at = [], 0
    while at < len(a):
        end = min(len(a), at + _BLOCK)
        while end < len(a):  # cut at a white space
            space = np.flatnonzero(_SPACE[a[at:end]])
            if len(space):
                end = at + int(space[-1]) + 1
                break
            end = min(len(a), end + (end - at))
        parts.append(_word_hashes_of(a[at:end]))
        at = end
    return np.concatenate(parts)


def rolling(words: np.ndarray, width: int, kind: str = "word") -> np.ndarray:
    """64 bits for each run of ``width`` consecutive words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > _BLOCK:
        return np.concatenate([rolling(words[i : i + _BLOCK + width - 1], width, kind) for i in range(0, n, _BLOCK)])
    up, down = _powers(kind, len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


#: A key that holds over one part in so many of a join's rows is dealt over several tasks.
HOT_PARTS = 1000


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None, counted: DataFrame | None = None, place: Column | None = None) -> DataFrame:
    """many joined to few, which has one row a key; no key of very many rows meets in one task.

    Keys that hold over 1 / HOT_PARTS of the rows of many are dealt over tasks of that
    size, and the row of few goes to each of them. There are fewer than HOT_PARTS such keys, so
    the table that names them is broadcast. many must be a written table: its rows are
    dealt by their place in it. Or else counted is one that holds the keys of the same rows, and
    place a column of many with their place in it.
    """
    counted = many if counted is None else counted
    least = -(-(counted.count() if rows is None else rows) // HOT_PARTS) + 1
    hot = counted.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*keys, F.ceil(F.col("_n") / least).alias("_parts"))
    if hot.isEmpty():
        return many.join(few, keys, how)
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id() if place is None else place, parts)).drop("_parts")
    copied = few.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


_PLACE_BITS = 33


def numbered(rows: DataFrame, tag: str, number: str = "number") -> DataFrame:
    """rows, written, with a number from 0 without gaps: each partition counts its own rows, and no row meets another."""
    placed = write_table(rows.withColumn("_at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_at", _PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return placed.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(number, F.col("_first") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)).drop("_part", "_first", "_at")


def prefix_sums(rows: DataFrame, group: str, key: str, value: str, ties: list[str], offsets: DataFrame) -> DataFrame:
    """Adds ``before``: the sum of value over the rows of the group that precede in the order (slot, key, *ties).

    offsets: what :func:`slot_offsets` gives for the same rows. Every (group, slot) is
    ordered alone, so a group that holds most rows is spread over as many tasks as it has slots.
    """
    inside = Window.partitionBy(group, "slot").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, [group, "slot"], "inner")
    return joined.withColumn("before", F.col("slot_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))


def slot_offsets(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, slot, slot_before): the sum of value over the group's smaller slots."""
    sums = rows.groupBy(group, "slot").agg(F.sum(value).alias("slot_sum"))
    earlier = Window.partitionBy(group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, "slot", F.coalesce(F.sum("slot_sum").over(earlier), F.lit(0)).alias("slot_before"))


def slot_count(rows: int, per_slot: int = 500, most: int = 65536) -> int:
    """A power of two: how many equal ranges of a uniform 16-bit key the rows are dealt into."""
    return 1 << max(4, min(most, max(1, rows // per_slot)).bit_length() - 1)


def slot_of(hex_key: Column, slots: int) -> Column:
    """The range that a uniform hexadecimal key falls into."""
    return F.expr("int(0)") if slots <= 1 else F.floor(F.conv(F.substring(hex_key, 1, 4), 16, 10).cast("int") / F.lit(65536 // slots)).cast("int")
