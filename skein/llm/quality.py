"""Quality classifier: averaged subword embeddings with a softmax, trained by SGD in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import body, mix, slices, texts, word_hashes

#: Buckets of each kind of feature (words, word 2-grams, character 3-grams), as bits.
BITS = 17
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.5
SEED = 7
#: The most labelled documents that are learned from: what reaches the driver is bounded by it.
SAMPLE = 2000
THRESHOLD = 0.7

_PART = 1 << BITS
_END = 3 * _PART  # the bucket of the mark that every text has at its end
#: Values are whole multiples of 1 / _UNIT, so that sums don't depend on their order.
_UNIT = 2.0**20
_PIECE = 1 << 17
_SPACES = re.compile(rb"[ \t-\r]")


def _cut(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about _PIECE bytes, cut at white space."""
    at = 0
    while len(data) - at > _PIECE:
        space = _SPACES.search(data, at + _PIECE)
        if not space:
            break
        yield data[at : space.start()]
        at = space.start()
    yield data[at:]


def _grouped(data: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(documents, pieces) in groups of bounded size."""
    docs: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for doc, text in enumerate(data):
        for piece in _cut(text):
            docs.append(doc)
            pieces.append(piece)
            size += len(piece)
            if size >= _PIECE:
                yield docs, pieces
                docs, pieces, size = [], [], 0
    if pieces:
        yield docs, pieces


def features(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) arrays: words, word 2-grams, the character 3-grams of each word with its borders, and the end mark.

    A 2-gram is hashed by the difference of its words' hashes, so a word that follows itself
    has one bucket, whatever the word: what is learned of it holds for unseen words too.
    """
    last_doc, last_word = -1, np.uint64(0)
    for docs, pieces in _grouped(data):
        words_of = [p.split() for p in pieces]
        doc = np.repeat(np.array(docs, np.int64), [len(w) for w in words_of])
        if not len(doc):
            continue
        line = b" " + b" ".join([w for words in words_of for w in words]) + b" "
        words = word_hashes(line)
        yield doc, (words >> np.uint64(64 - BITS)).astype(np.int64)
        follows = np.concatenate([[last_doc], doc[:-1]]) == doc
        pairs = mix(words - np.concatenate([[last_word], words[:-1]])) >> np.uint64(64 - BITS)
        yield doc[follows], pairs[follows].astype(np.int64) + _PART
        c = np.frombuffer(line.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        inside = c[1:-1] != 32
        h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35))[inside]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield doc[np.cumsum(~inside)[inside]], (h >> np.uint32(32 - BITS)).astype(np.int64) + 2 * _PART
        last_doc, last_word = int(doc[-1]), words[-1]
    yield np.arange(len(data)), np.full(len(data), _END)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        own: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for doc, bucket in features(texts(batch.column("text"))):
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
            for i, part in zip(at, np.split(bucket, at[1:]) if len(doc) else []):
                own[doc[i]].append(part)
        found = [np.unique(np.concatenate(x), return_counts=True) for x in own]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "label": batch.column("label"),
            "ids": pa.array([i.astype(np.uint32).tobytes() for i, _ in found], pa.binary()),
            "counts": pa.array([n.astype(np.float32).tobytes() for _, n in found], pa.binary()),
        })


def train(ids: np.ndarray, counts: np.ndarray, ends: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Learns vectors and softmax by SGD, one document at a time; returns them folded.

    ids and counts hold all documents' buckets one after another, up to ``ends``. A
    document's vector is the mean of its features' vectors, and for two classes the
    softmax depends on the difference of their weights only. So what scoring needs is
    one number a bucket (its vector times that difference) and a bias.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.random((_END + 1, DIMENSIONS), np.float32) * 2 - 1) / DIMENSIONS
    weights, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = max(1, epochs * len(labels)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            own = slice(ends[i - 1] if i else 0, ends[i])
            at, share = ids[own], counts[own] / counts[own].sum()
            mean = share @ vectors[at]
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = rate * (1 - done / steps)
            back = p @ weights
            weights -= step * np.outer(p, mean)
            bias -= step * p
            vectors[at] -= np.outer(share * np.float32(len(at) ** 0.5 * step), back.astype(np.float32))
            done += 1
    return np.round(vectors @ (weights[1] - weights[0]) * _UNIT), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The folded model from at most ``sample`` labelled documents, those first by hash.

    Only rows whose crc32(doc_id as text) mod 4 is not 2 are learned from; null ids and
    labels other than 0 and 1 are left out. The bound holds for documents too, where ids
    repeat. What a document sends is bounded by the number of buckets. Without labelled
    rows every score is 0.5.
    """
    open_rows = labels.where("quality in (0, 1) and doc_id is not null").where(fold() != 2)
    chosen = open_rows.select("doc_id", F.col("quality").cast("int").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    # At most ``sample`` pairs of numbers: a bounded broadcast.
    found = docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(sample)
    rows = found.mapInArrow(_examples, "doc_id long, label int, ids binary, counts binary").toArrow()
    # In the order of that hash, so that every run learns alike.
    flat = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in rows.column(name)), kind)
    ends = np.cumsum([len(x.as_py()) // 4 for x in rows.column("ids")], dtype=np.int64)
    return train(flat("ids", np.uint32), flat("counts", np.float32), ends, rows.column("label").to_numpy())


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def scores(data: list[bytes], model: tuple[np.ndarray, float]) -> np.ndarray:
    value, bias = model
    total, n = np.zeros(len(data)), np.zeros(len(data))
    for doc, bucket in features(data):
        total += np.bincount(doc, value[bucket], len(data))
        n += np.bincount(doc, minlength=len(data))
    return 1 / (1 + np.exp(-np.clip(total / _UNIT / n + bias, -700, 700)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """Adds the column ``name``: how likely the whole text is of quality 1, from 0 to 1.

    Null and empty texts have one feature, the end mark, and get a score too. Equal texts
    get equal scores; no column but text is read, all others are kept but one called
    ``name``, whose place the score takes. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scores(texts(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def keep_good(docs: DataFrame, labels: DataFrame, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least threshold, with the given columns."""
    scored = score(docs.select(*columns), fit(docs, labels), "_score")
    return scored.where(F.col("_score") >= threshold).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
