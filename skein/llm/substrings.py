"""Substring dedup: words that windows of an earlier document cover go.

A first pass merges count-min sketches of all partitions; a second one groups exactly
the windows whose estimate is two or more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import body, id_or_lowest, mix, rolling, slices, text_tag, texts, word_hashes, write_table
from skein.llm.runs import ROWS, by_document, later_documents, pack

WINDOW = 50
_OWN = ("n_words", "n_removed", "kept")
#: A window is counted under the smallest-hashed run of this many words in it. Equal
#: windows share that run, so its count is never below the window's; neighbouring
#: windows mostly share it too, which leaves about one in thirteen positions to count.
GRAM = 25
#: Counters in each of the sketch's two rows, at most, as bits. There are about four for each
#: distinct run that was counted; the merged sketch keeps one bit a counter (two or more?), so
#: what is broadcast is 128 MB at most, whatever the input.
MOST_BITS = 29
#: The sketch is merged in so many parts for each row, by the first bits of the cell.
_PART_BITS = 8
_LEAST_BITS = _PART_BITS + 3
#: Touched cells that a task holds before it sends them on.
_HELD = 1 << 24
_SALT = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03))
_ROWS = pa.schema([("k", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("c", pa.int64())])


def _cells(anchors: np.ndarray, row: int) -> np.ndarray:
    """32 bits for each run; a sketch of fewer cells takes the first bits."""
    return (mix(anchors ^ _SALT[row]) >> np.uint64(32)).astype(np.uint32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _anchors(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window the hash it is counted under."""
    return _sliding_min(rolling(words, gram), window - gram + 1)


def _sketch(window: int, gram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint32)
        once, more, new = [none, none], [none, none], [[], []]

        def fold():
            for row in (0, 1):
                once[row], count = np.unique(np.concatenate([once[row], *new[row]]), return_counts=True)
                more[row] = np.union1d(more[row], once[row][count > 1])
                new[row] = []

        for batch in slices(batches):
            for data in texts(batch.column("text")):
                words = word_hashes(data)
                if len(words) >= window:
                    anchors = np.unique(_anchors(words, window, gram))  # a document counts once
                    for row in (0, 1):
                        new[row].append(_cells(anchors, row))
            if sum(map(len, new[0])) > max(1 << 20, len(once[0])):
                fold()
            if len(once[0]) > _HELD:
                yield from pack_up(once, more)
                once, more = [none, none], [none, none]
        fold()
        yield from pack_up(once, more)

    def pack_up(once: list[np.ndarray], more: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """This task's counters, capped at two, by part: the touched cells, and those touched again."""
        shift = np.uint32(32 - _PART_BITS)
        for row in (0, 1):
            parts = np.unique(once[row] >> shift)
            borders = np.append(parts, np.uint32(1 << _PART_BITS)).astype(np.int64) << (32 - _PART_BITS)
            ends = [np.searchsorted(x.astype(np.int64), borders) for x in (once[row], more[row])]
            cut = [[x[a:b].tobytes() for a, b in zip(at, at[1:])] for x, at in zip((once[row], more[row]), ends)]
            if len(parts):
                yield pa.RecordBatch.from_pydict({"part": pa.array(row * (1 << _PART_BITS) + parts.astype(np.int32), pa.int32()), "n": pa.array([len(x) // 4 for x in cut[0]], pa.int64()), "once": pa.array(cut[0], pa.binary()), "more": pa.array(cut[1], pa.binary())})

    return emit


def _merge(bits: int):
    """Adds the tasks' counters of each part, one after another; one bit a cell says whether two or more came."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, shift = 1 << (bits - _PART_BITS), np.uint32(32 - bits)
        part, count = None, np.zeros(size, np.uint8)
        done = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(count > 1).tobytes(), 1)], pa.binary())})
        for batch in batches:
            for now, *both in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "more"))):
                if now != part:
                    if part is not None:
                        yield done()
                    part, count = now, np.zeros(size, np.uint8)
                for cells in both:
                    at, n = np.unique((np.frombuffer(cells, np.uint32) >> shift) & np.uint32(size - 1), return_counts=True)
                    count[at] = np.minimum(count[at] + np.minimum(n, 2), 2)
        if part is not None:
            yield done()

    return emit


def repeat_sketch(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, most_bits: int = MOST_BITS) -> tuple[list[np.ndarray], int]:
    """The merged sketch, as two bitmaps and their size in bits: may a run of words be in two documents?

    Every task merges what it reads; the parts of all tasks are then added up as they stream
    by, so no worker holds more than one part of one sketch. The number of cells
    follows the number of runs counted, up to most_bits; past that the sketch lets more windows
    through to the exact pass and still loses none.
    """
    parts = write_table(rows.select("text").mapInArrow(_sketch(window, gram), "part int, n long, once binary, more binary"), "sketches")
    counted = parts.agg(F.sum("n")).first()[0] or 0
    bits = min(most_bits, max(_LEAST_BITS, int(2 * counted).bit_length()))
    dealt = parts.repartition("part").sortWithinPartitions("part")
    merged = dealt.mapInArrow(_merge(bits), "part int, bits binary").collect()  # 2 * 2**bits / 8 bytes at most
    maps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    size = (1 << bits) // 8 >> _PART_BITS
    for x in merged:
        row, part = divmod(x.part, 1 << _PART_BITS)
        maps[row][part * size : (part + 1) * size] = np.frombuffer(zlib.decompress(x.bits), np.uint8)
    return maps, bits


def _window_rows(sketch, window: int, gram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, bits = sketch.value
        for batch in slices(batches, 64):
            ks, docs, tags, cs = [], [], [], []
            for doc, tag, data in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), texts(batch.column("text"))):
                words = word_hashes(data)
                if len(words) < window:
                    continue
                anchors = _anchors(words, window, gram)
                # Neighbours share anchors: look each run of equal ones up once.
                head = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
                hit = np.ones(len(head), bool)
                for row in (0, 1):
                    cell = (_cells(anchors[head], row) >> np.uint32(32 - bits)).astype(np.int64)
                    hit &= (maps[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                if not hit.any():
                    continue
                at = np.flatnonzero(np.repeat(hit, np.diff(np.append(head, len(anchors)))))
                # Only windows that can repeat are hashed in full, by two families.
                ks.append(rolling(words, window)[at].view(np.int64))
                cs.append(pack(rolling(words, window, "again")[at], at))
                docs.append(np.full(len(at), doc, np.int64))
                tags.append(np.full(len(at), tag, np.int64))
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ks, docs, tags, cs)], schema=_ROWS)

    return emit


def _spans(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, drops, kept = [], [], []
            for data, starts in zip(texts(batch.column("text")), batch.column("positions").to_pylist()):
                words = data.split()
                counts.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, np.array(starts), 1)
                    np.add.at(edge, np.array(starts) + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [w for w, g in zip(words, gone) if not g]
                drops.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in batch.schema.names if c not in ("text", "positions")}, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(drops, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return emit


def remove_repeated_passages(docs: DataFrame, payload: list[str] | tuple[str, ...] = (), window: int = WINDOW, gram: int = GRAM, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, payload, n_words, n_removed and kept: the words that stay, one space between them.

    A window is ``window`` consecutive words of one document, a word what ASCII white space
    separates. A word goes if a window covers it whose words also start somewhere in a
    document with a smaller doc_id. Windows are judged on the input, and compared by 80
    bits of hash.

    Null, empty and short texts have no window and lose nothing. A null doc_id is below all
    others. Rows that repeat a doc_id are one document and don't take from each other.
    No rows: no rows. Of other columns only payload is carried, and of that not what is
    called text, n_words, n_removed or kept.
    """
    rows = docs.select(id_or_lowest().alias("doc"), text_tag().alias("tag"), body().alias("text"))
    sketch = docs.sparkSession.sparkContext.broadcast(repeat_sketch(rows, window, gram, most_bits))
    windows = rows.mapInArrow(_window_rows(sketch, window, gram), ROWS)
    gone = by_document(later_documents(windows, 2, False, "windows"))
    names = [c for c in dict.fromkeys(["doc_id", *payload]) if c not in ("text", *_OWN)]
    own = [F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(names)]
    whole = docs.select(*own, body().alias("text"), id_or_lowest().alias("_doc"), text_tag().alias("_tag"))
    joined = whole.join(gone.select(F.col("doc").alias("_doc"), F.col("t").alias("_tag"), "positions"), ["_doc", "_tag"], "left").drop("_doc", "_tag")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[: len(own)])
    return joined.mapInArrow(_spans(window), f"{schema}, n_words long, n_removed long, kept string").toDF(*names, *_OWN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT d.doc_id, d.row_id, u.i, md5(array_to_string(d.w[u.i : u.i + 49], ' ')) AS h
  FROM d, LATERAL (SELECT unnest(range(1, len(d.w) - 48)) AS i) u),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM starts GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT s.row_id, s.i + k.k AS pos
  FROM starts s JOIN firsts f ON s.h = f.h AND s.doc_id > f.first_doc, (SELECT unnest(range(0, 50)) AS k) k),
words AS (
  SELECT d.doc_id, d.row_id, u.word, u.pos FROM d, LATERAL (SELECT unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS pos) u),
kept AS (
  SELECT w.row_id, string_agg(w.word, ' ' ORDER BY w.pos) AS text, count(*) AS n
  FROM words w ANTI JOIN gone g ON w.row_id = g.row_id AND w.pos = g.pos GROUP BY w.row_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.row_id = k.row_id
"""
