"""Line dedup: repeated lines go, as compressed keep bitmaps for each document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import body, id_or_lowest, slices, text_tag, texts
from skein.llm.runs import ROWS, by_document, later_documents, pack

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
_OWN = ("text", "n_lines", "n_dropped", "keep_bitmap")
_EDGE = b" \t\n\x0b\x0c\r"
_ROWS = pa.schema([("k", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("c", pa.int64())])


def _line_rows(min_length: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, docs, tags, places = [], [], [], []
            for doc, tag, data in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), texts(batch.column("text"))):
                for at, line in enumerate(data.split(b"\n")):
                    key = line.strip(_EDGE).lower()
                    if len(key) >= min_length and (len(key) >= 4 * min_length or len(key.decode("utf-8", "replace")) >= min_length):
                        keys.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        tags.append(tag)
                        places.append(at)
            both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
            c = pack(both[:, 1], np.array(places, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy().view(np.int64)), pa.array(np.array(docs, np.int64)), pa.array(np.array(tags, np.int64)), pa.array(c)], schema=_ROWS)

    return emit


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts, drops, maps = [], [], []
        for data, gone in zip(texts(batch.column("text")), batch.column("positions").to_pylist()):
            n = data.count(b"\n") + 1
            keep = np.ones(n, bool)
            if gone:
                keep[gone] = False
            counts.append(n)
            drops.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in batch.schema.names if c != "positions"}, "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(drops, pa.int64()), "keep_bitmap": pa.array(maps, pa.binary())})


def kept_text(data: bytes, n_lines: int, n_dropped: int, bitmap: bytes) -> bytes:
    """The lines that the bitmap keeps, joined by a line feed."""
    if not n_dropped:
        return data
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines)
    return b"\n".join(line for line, k in zip(data.split(b"\n"), keep) if k)


def _decided(docs: DataFrame, payload: list[str], min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The payload as _p0, _p1 ..., then text and positions, what :func:`_bitmaps` takes."""
    rows = docs.select(id_or_lowest().alias("doc"), text_tag().alias("tag"), body().alias("text"))
    gone = by_document(later_documents(rows.mapInArrow(_line_rows(min_length), ROWS), min_documents, True, "lines"))
    own = [F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(payload)]
    whole = docs.select(*own, body().alias("text"), id_or_lowest().alias("_doc"), text_tag().alias("_tag"))
    return whole.join(gone.select(F.col("doc").alias("_doc"), F.col("t").alias("_tag"), "positions"), ["_doc", "_tag"], "left").drop("_doc", "_tag")


def _schema(decided: DataFrame) -> str:
    """Of the columns before positions."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in decided.schema[:-1])


def line_keep_bitmaps(docs: DataFrame, payload: list[str] | tuple[str, ...] = (), min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, payload, text, n_lines, n_dropped and keep_bitmap (zlib of one bit for each line, 1: stays).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key
    of at least min_length code points in at least min_documents documents loses its lines,
    except those of the largest doc_id that holds it. Keys are compared by 80 bits of hash.

    Null or empty texts are one empty line, which stays. A null doc_id counts as one
    document, below all others. Rows that repeat a doc_id are parts of one document; each
    gets its own bitmap. No rows: no rows. Of other columns only payload is carried, and of
    that not what is called text, n_lines, n_dropped or keep_bitmap.
    """
    own = [c for c in dict.fromkeys(["doc_id", *payload]) if c not in _OWN]
    decided = _decided(docs, own, min_length, min_documents)
    return decided.mapInArrow(_bitmaps, f"{_schema(decided)}, n_lines long, n_dropped long, keep_bitmap binary").toDF(*own, *_OWN)


def drop_lines(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs without the dropped lines, with the given columns; n_chars, if it is there, follows the text."""
    carried = [c for c in columns if c != "text"]
    decided = _decided(docs, carried)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bitmaps(batches):
            kept = [kept_text(*x).decode("utf-8", "replace") for x in zip(texts(batch.column("text")), *(batch.column(c).to_pylist() for c in _OWN[1:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(kept, pa.string())], names=[*batch.schema.names[: len(carried)], "text"])

    out = decided.mapInArrow(cut, _schema(decided)).toDF(*carried, "text")
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out).select(*[F.col(f"`{c}`") for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _decided(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bitmaps(batches):
            kept = [hashlib.sha256(kept_text(*x)).hexdigest() for x in zip(texts(batch.column("text")), *(batch.column(c).to_pylist() for c in _OWN[1:]))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("_p0"), "n_lines": batch.column("n_lines"), "n_dropped": batch.column("n_dropped"), "kept_sha256": pa.array(kept, pa.string())})

    return decided.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH lines AS (
  SELECT doc_id, row_id, u.pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS line, unnest(range(1, len(d.parts) + 1)) AS pos) u),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, h.key IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM lines l LEFT JOIN hot h ON l.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row_id
"""
