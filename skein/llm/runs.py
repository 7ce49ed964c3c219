"""Repeated keys across documents: range partitions, secondary sort, one streaming pass.

Rows are (k, doc, t, c): 64 bits of a key's hash, the document, 64 bits of the text's hash,
and a long that packs 16 more bits of the key's hash and a position of 32 bits. Range partitioning on
(key, document) also splits a key that a third of all documents hold; what a partition
can't decide alone are the keys of its first and last run, at most two, and those are
settled from one summary row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import shuffle_partitions, write_table

ROWS = "k long, doc long, t long, c long"
_SCHEMA = pa.schema([("kind", pa.int8()), ("k", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("last", pa.int64())])
_DECIDED, _OPEN, _SUMMARY = 0, 1, 2


def pack(key_low: np.ndarray | int, position: np.ndarray) -> np.ndarray:
    """16 bits of key, 16 of nothing, 32 bits of position, as a signed long."""
    high = (np.asarray(key_low).astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)
    return (high | position.astype(np.uint64)).view(np.int64)


def _stream(min_docs: int):
    def out(kind, k, c, doc, t, n, last):
        size = len(k)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(x, kind_of), size)) for x, kind_of in zip((kind, k, c, doc, t, n, last), (np.int8, *[np.int64] * 6))], schema=_SCHEMA)

    def runs(k, c, doc):
        """Starts of the runs, and for each row its run, for each run its documents and its first one's id."""
        h = c >> 48
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        step = np.concatenate([[True], doc[1:] != doc[:-1]]) | new
        return start, run, np.add.reduceat(step.astype(np.int64), start), doc[start]

    def decide(k, c, doc, t):
        start, run, docs, first = runs(k, c, doc)
        gone = (docs[run] >= min_docs) & (doc != first[run])
        return out(_DECIDED, k[gone], c[gone], doc[gone], t[gone], first[run][gone], 0)

    def leave_open(k, c, doc, t):
        start, run, docs, first = runs(k, c, doc)  # one run
        yield out(_OPEN, k, c, doc, t, 0, 0)
        yield out(_SUMMARY, k[:1], c[:1], doc[:1], t[:1], docs[:1], doc[-1:])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the run that is still open
        first = True

        def ended():
            nonlocal first
            whole = [np.concatenate(x) for x in zip(*held)]
            if first:
                first = False
                return leave_open(*whole)
            return [decide(*whole)]

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("k", "c", "doc", "t")]
            if held:
                k, c = (held[-1][x][-1] for x in (0, 1))
                other = np.flatnonzero((now[0] != k) | (now[1] >> 48 != c >> 48))
                lead = int(other[0]) if len(other) else len(now[0])
                if lead:
                    held.append([x[:lead] for x in now])
                if lead == len(now[0]):
                    continue
                yield from ended()
                now = [x[lead:] for x in now]
            start = runs(*now[:3])[0]
            if first and len(start) > 1:  # the partition's first run has ended
                held = [[x[: start[1]] for x in now]]
                yield from ended()
                now = [x[start[1] :] for x in now]
                start = start[1:] - start[1]
            if cut := start[-1]:
                yield decide(*[x[:cut] for x in now])
            held = [[x[cut:] for x in now]]
        if held:
            yield from leave_open(*[np.concatenate(x) for x in zip(*held)])

    return stream


def later_documents(rows: DataFrame, min_docs: int, largest_first: bool, tag: str) -> DataFrame:
    """(k, doc, t, c, first) of the rows whose key is in at least min_docs documents, but for those of its first document.

    Its first document, in ``first``, is the largest id if largest_first, else the smallest.
    rows must give the same
    rows whenever Spark computes them again.
    """
    h = F.shiftright("c", 48)
    order = ["k", h, F.desc("doc") if largest_first else F.asc("doc")]
    parts = shuffle_partitions(rows.sparkSession)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "t", "c")
    streamed = write_table(ordered.mapInArrow(_stream(min_docs), "kind byte, k long, c long, doc long, t long, n long, last long"), tag)
    spans = F.array_sort(F.collect_list(F.struct(F.col("doc").alias("first"), "last", "n")))
    if largest_first:
        spans = F.reverse(spans)
    # A document whose rows go on in the next partition counts once.
    seams = "aggregate(sequence(1, size(spans) - 1), 0L, (s, i) -> s + if(spans[i - 1].last = spans[i].first, 1L, 0L))"
    total = F.expr(f"aggregate(spans, 0L, (s, x) -> s + x.n) - if(size(spans) > 1, {seams}, 0L)")
    open_keys = (
        streamed.where(F.col("kind") == _SUMMARY)
        .groupBy("k", h.alias("h"))
        .agg(spans.alias("spans"))
        .where(total >= min_docs)
        .select("k", "h", F.expr("spans[0].first").alias("keeper"))
    )
    # At most two rows for each range partition, so the broadcast is bounded.
    settled = streamed.where(F.col("kind") != _SUMMARY).withColumn("h", h).join(F.broadcast(open_keys), ["k", "h"], "left")
    own = F.col("kind") == _DECIDED
    return settled.where(own | (F.col("doc") != F.col("keeper"))).select("k", "doc", "t", "c", F.when(own, F.col("n")).otherwise(F.col("keeper")).alias("first"))


def by_document(decided: DataFrame) -> DataFrame:
    """(doc, t, positions): the distinct decided positions of each text, whatever number of equal rows it stands in."""
    return decided.groupBy("doc", "t").agg(F.collect_set(F.col("c").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("positions"))
