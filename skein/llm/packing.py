"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import body, prefix_sums, slices, slot_count, slot_of, slot_offsets, write_table

LONGEST = 1024
END_ID = 0
# Fixed value: how a byte-level pre-tokenizer cuts a text before the merges.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose class two Unicode tables could differ, or very long runs of white
#: space, send their text to the tokenizer whole.
_ODD = re.compile("[^\t\n\r\x20-\x7E\xA1-\u024F\u2010-\u2027\u2030-\u205E\u20AC]|[\t\n\r ]{2000}")
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the others from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if the tokenizer is plain byte-level BPE whose ids stand in the order of its merges; else None."""
    model, cut, post = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("post_processor") or {"type": "ByteLevel"}
    plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    extra = spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or extra or post.get("type") != "ByteLevel":
        return None
    letters, vocab = _byte_letters(), model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if len(vocab) != 256 + len(merged) or any(vocab.get(x, 256) > 255 for x in letters) or any(vocab.get(x) != 256 + i for i, x in enumerate(merged)):
        return None
    return {bytes(map(letters.__getitem__, word)): i for word, i in vocab.items()}


class Encoder:
    """A tokenizer file's ids. Where the file is plain byte-level BPE the same merges run in tiktoken, which is faster."""

    def __init__(self, path: str):
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [x["content"] for x in spec.get("added_tokens") or ()]
        if ranks := _ranks(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def whole(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _ODD.search(text) or any(x in text for x in self.added):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast(text)


def token_bytes(data: list[str], path: str) -> list[bytes]:
    """Each text's ids, little-endian in four bytes, as the tokenizer gives them without special tokens added."""
    if path not in _encoders:  # lives as long as the Python worker
        _encoders[path] = Encoder(path)
    ids = _encoders[path].ids
    return [np.array(ids(text), "<u4").tobytes() for text in data]


def binary_pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of n ids cut into pieces of ``longest`` and then of falling powers of two."""
    cut = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at, size = n - n % longest, longest // 2
    while at < n:
        if n - at >= size:
            cut.append((at, size))
            at += size
        size //= 2
    return cut


def _pieces(path: str, longest: int, end_id: int, with_ids: bool):
    end = struct.pack("<I", end_id)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_bytes(batch.column("text").to_pylist(), path)):
                ids += end
                n = len(ids) // 4
                for start, length in binary_pieces(n, longest):
                    own = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc_id, start, length, zlib.crc32(own), n, own)):
                        column.append(value)
            arrays = [pa.array(x, pa.int64()) for x in rows[:5]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return emit


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids: a row for each piece.

    A document is its text's ids and end_id. Its length's binary digits cut it into pieces
    of a power of two, ``longest`` at most, and each piece is a sequence: no padding, and
    no sequence crosses documents. Sequences of a length are numbered in the order of a
    hash of (doc_id, start, ids), by distributed prefix sums; sequence_id is that number times
    16 plus the length's exponent, so ``sequence_id % 16`` tells the bucket.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are packed each,
    with sequences of their own. No rows: no rows. Other columns are ignored.
    """
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    made = docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(_pieces(tokenizer, longest, end_id, with_ids), columns)
    # The ids' checksum keeps the pieces of a repeated doc_id, or of none, from meeting in one slot.
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "ids_crc32", "doc_tokens").cast("binary"))
    pieces = write_table(made, "pieces").withColumn("key", key).withColumn("one", F.lit(1).cast("long"))
    pieces = pieces.withColumn("slot", slot_of(F.col("key"), slot_count(pieces.count())))
    numbered = prefix_sums(pieces, "length", "key", "one", ["doc_id", "start", "ids_crc32"], slot_offsets(pieces, "length", "one"))
    exponent = F.round(F.log2("length")).cast("long")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") * 16 + exponent).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
