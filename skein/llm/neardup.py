"""Near-duplicate classes by DartMinHash signatures, a banded join and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import HOT_PARTS, body, id_or_lowest, mix, rolling, slices, spread_join, text_tag, texts, word_hashes, write_table
from skein.llm.runs import later_documents
from skein.operators.graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at similarity s shares a band with probability 1 - (1 - s**WIDE)**BANDS: at 0.8
#: all but 8 in a million, at 0.43 one in fourteen.
BANDS, WIDE = 64, 8
#: A pair at the threshold is ruled out by its sketches with a chance of 3 in a million.
DEVIATIONS = 4.5
#: Bits, at most, of the map that says whose sets are asked for: what is broadcast takes 32 MB at most.
MOST_CELLS = 1 << 28
_NEVER = np.uint64(2**64 - 1)
_REGION, _CELL, _DART, _SLICE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
#: Chances of 0, 1, 2 ... darts in a region of area one, summed: a Poisson law of mean one.
_POISSON = (np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1.0, 14.0)])) * 2.0**32).astype(np.uint64)
_ROWS = 1 << 15


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """k values; at each, two weighted sets agree with the probability of their weighted Jaccard similarity.

    The plane of weight by rank above every element is cut into regions of area one. A
    hash of element and region says how many darts lie in it (Poisson, mean one) and where:
    at which weight, which rank, and which of the k coordinates. A dart counts if its
    weight is below the element's; each coordinate keeps its dart of lowest rank. Ranks are
    searched upward until every coordinate has one, so the work is about k log k darts
    plus one for each element. weights None: all are one. No elements: all values alike.
    """
    found = np.full(k, _NEVER)
    if not len(elements):
        return found
    if weights is None:
        slices_, room = mix(elements), None
    else:
        tall = np.ceil(weights).astype(np.int64)
        at = np.arange(tall.sum()) - np.repeat(np.cumsum(tall) - tall, tall)
        slices_ = mix(np.repeat(elements, tall) + at.astype(np.uint64) * _SLICE * (at > 0))
        slices_[at == 0] = mix(np.repeat(elements, tall)[at == 0])
        room = np.minimum(1.0, np.repeat(weights, tall) - at)
    rank, cells = 0, max(1, int(np.ceil(k * (np.log(k) + 1.5) / len(slices_))))
    while (found == _NEVER).any():
        step = max(1, _ROWS // len(slices_))
        for first in range(rank, rank + cells, step):
            cell = np.arange(first, min(first + step, rank + cells), dtype=np.uint64)
            for low in range(0, len(slices_), _ROWS):
                region = mix((slices_[low : low + _ROWS] * _REGION)[None, :] + (cell * _CELL)[:, None]).ravel()
                darts = np.searchsorted(_POISSON, region >> np.uint64(32), side="right")
                many = np.cumsum(darts)
                turn = np.arange(many[-1] if len(many) else 0) - np.repeat(many - darts, darts)
                dart = mix(np.repeat(region, darts) + (turn.astype(np.uint64) + np.uint64(1)) * _DART)
                height = np.repeat(np.repeat(cell, len(region) // len(cell)), darts)
                packed = (height << np.uint64(48)) | (dart >> np.uint64(16))
                if room is not None:
                    level = (mix(dart ^ _SLICE) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                    inside = level < np.repeat(np.tile(room[low : low + _ROWS], len(cell)), darts)
                    dart, packed = dart[inside], packed[inside]
                np.minimum.at(found, (dart % np.uint64(k)).astype(np.int64), packed)
        rank += cells
        cells = max(1, rank)
    return found


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64) * _DART)
    for i in range(rows.shape[1]):
        out = mix(out ^ (rows[:, i] * _CELL))
    return out


def shingles(data: bytes, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the text's distinct runs of ``width`` words, and their counts; of fewer words, all are one run."""
    words = word_hashes(data)
    return np.unique(rolling(words, min(width, max(1, len(words)))), return_counts=True)


def identity(data: bytes) -> bytes:
    """128 bits of the text's words: texts of the same words in the same order are copies."""
    return xxhash.xxh3_128_digest(b" ".join(data.split()))


def _signed(weigh: bool, bands: int, wide: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, keys = [], []
            for data in texts(batch.column("text")):
                hashes.append(identity(data))
                sh, counts = shingles(data)
                keys.append(band_hashes(dart_minhash(sh, counts.astype(np.float64) if weigh else None, bands * wide), bands).view(np.int64) if len(sh) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "t": batch.column("t"), "h": pa.array(hashes, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    return emit


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted arrays, repeats counted."""
    merged = np.sort(np.concatenate([np.unique(x), np.unique(y)]))
    both = merged[1:][merged[1:] == merged[:-1]]
    if len(x) + len(y) == len(merged):
        return len(both)
    count = lambda a: np.searchsorted(a, both, "right") - np.searchsorted(a, both, "left")
    return int(np.minimum(count(x), count(y)).sum())


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates in a long."""
    nibbles = np.zeros(-(-len(signature) // 16) * 16, np.uint64)
    nibbles[: len(signature)] = signature & np.uint64(15)
    return np.bitwise_or.reduce(nibbles.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def _sets(weigh: bool, bands: int, wide: int, bits):
    """The shingle sets of the texts whose cell is set, as 64 bits for each element, sorted; their bands and sketches. A text that repeats in the partition comes once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.frombuffer(bits.value, np.uint8)
        seen: set[bytes] = set()
        for batch in slices(batches, 1024):
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((asked[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)))
            tags, sets, keys, sketches = [], [], [], []
            for data in texts(batch.column("text")):
                tag = identity(data)
                if tag in seen:
                    continue
                seen.add(tag)
                sh, counts = shingles(data)
                signature = dart_minhash(sh, counts.astype(np.float64) if weigh else None, bands * wide)
                tags.append(tag)
                sets.append((np.repeat(sh, counts) if weigh else sh).tobytes())
                keys.append(band_hashes(signature, bands).view(np.int64))
                sketches.append(sketch(signature).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"h": pa.array(tags, pa.binary()), "s": pa.array(sets, pa.binary()), "bands": pa.array(keys, longs), "sketch": pa.array(sketches, longs)})

    return emit


def sets_of(whole: DataFrame, involved: DataFrame, weigh: bool, bands: int, wide: int) -> DataFrame:
    """(node, s, bands, sketch) of the involved (node, h, t), with no text moved: a bitmap of bounded size drops most others where they are read."""
    cells = min(MOST_CELLS, max(1 << 20, 1 << (8 * involved.count()).bit_length()))
    cell = F.pmod(F.xxhash64("t"), F.lit(cells))
    # Buckets and bits are counted from value 1 on.
    marks = involved.select((cell + 1).alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    asked = np.zeros(cells // 8, np.uint8)
    for x in marks.collect():  # cells / 8 bytes at most
        asked[(x.bucket - 1) * 4096 : x.bucket * 4096] = np.frombuffer(x.bits, np.uint8)
    bits = whole.sparkSession.sparkContext.broadcast(asked.tobytes())
    found = whole.select("text", cell.alias("cell")).mapInArrow(_sets(weigh, bands, wide, bits), "h binary, s binary, bands array<long>, sketch array<long>")
    return found.join(involved.drop("t"), "h").drop("h").dropDuplicates(["node"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        na, nb, both = [], [], []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            na.append(len(x))
            nb.append(len(y))
            both.append(_overlap(x, y))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), **{c: pa.array(x, pa.int64()) for c, x in (("na", na), ("nb", nb), ("both", both))}})


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both): the sizes of two sets and of what they share; pairs is a written table, and a text of very many pairs is spread."""
    left, right = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    rows = pairs.count()
    placed = pairs.withColumn("_at", F.monotonically_increasing_id())
    joined = spread_join(placed, left, ["a"], rows=rows, counted=pairs)
    joined = spread_join(joined, right, ["b"], rows=rows, counted=pairs, place=F.col("_at")).drop("_at")
    return joined.mapInArrow(_compare, "a long, b long, na long, nb long, both long")


def _linked(similarity: float):
    return F.col("both") >= similarity * (F.col("na") + F.col("nb") - F.col("both"))


def _may_link(similarity: float, k: int):
    """By their sizes and sketches, may documents a and b be similar?

    At the threshold a coordinate's four bits differ with a chance of p = 15/16 of what is
    missing to one; more than DEVIATIONS standard deviations above that are ruled out.
    """
    p = (1 - similarity) * 15 / 16
    most = k * p + DEVIATIONS * (k * p * (1 - p)) ** 0.5

    def differing(x, y):
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    unlike = F.aggregate(F.zip_with("sketch_a", "sketch_b", differing), F.lit(0), lambda s, x: s + x)
    return (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9) & (unlike <= most)


def _classes(docs: DataFrame, similarity: float, bands: int, wide: int, weigh: bool) -> tuple[DataFrame, DataFrame]:
    """(id, t, h), a row for each document, h 128 bits of its words; and (h, root, low, least): each text's class, the smallest id in it, null if it has none, and the smallest h."""
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), text_tag().alias("t"), body().alias("text"))
    signed = write_table(whole.mapInArrow(_signed(weigh, bands, wide), "id long, t long, h binary, bands array<long>"), "signed")
    # One row for each text, reduced before the shuffle, and numbered in the order of the
    # smallest id: so what stands first in a bucket is its oldest text, mostly the original.
    own = signed.groupBy("h").agg(F.min(F.struct("t", "bands")).alias("x"), F.min("id").alias("low"))
    own = own.select("h", "low", "x.t", "x.bands").orderBy(F.col("low").asc_nulls_last(), "h")
    own = write_table(own.withColumn("node", F.monotonically_increasing_id()), "texts")
    rows = own.select(F.explode("bands").alias("k"), F.col("node").alias("doc"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("c"))
    met = write_table(later_documents(rows, 2, False, "buckets").select("k", "doc", "first"), "met")
    involved = met.select(F.col("doc").alias("node")).union(met.select("first")).distinct().join(own.select("node", "h", "t"), "node")
    sets = write_table(sets_of(whole, write_table(involved, "involved"), weigh, bands, wide), "sets")
    known = sets.select(F.col("node").alias("doc"), (F.octet_length("s") / 8).alias("n"), "bands", "sketch")
    # First every text beside one: the smallest it shares a band with.
    pairs = write_table(met.groupBy(F.col("doc").alias("b")).agg(F.min("first").alias("a")).select("a", "b"), "pairs")
    links = write_table(compared(pairs, sets).where(_linked(similarity)).select("a", "b"), "links")
    root = components(links)
    # Then, in the buckets that this leaves in several classes, all beside the smallest; then pairs of the others.
    for pairs_of, needs in ((_star_pairs, known.drop("bands")), (_apart_pairs, known)):
        apart = write_table(_in_split_buckets(met, root).join(needs, "doc"), "apart")
        pairs = write_table(pairs_of(apart, similarity, bands * wide), "pairs")
        if not pairs.isEmpty():
            links = write_table(links.unionAll(compared(pairs, sets).where(_linked(similarity)).select("a", "b")), "links")
            root = components(links)
    placed = own.select("node", "h", "low").join(root, "node", "left").select("h", F.coalesce("root", "node").alias("root"), "low")
    lowest = placed.groupBy("root").agg(F.min("low").alias("low"), F.min("h").alias("least"))
    return signed.select("id", "t", "h"), placed.select("h", "root").join(lowest, "root")


def _in_split_buckets(met: DataFrame, root: DataFrame) -> DataFrame:
    """(k, doc, first, root) of the buckets whose texts are of several classes, by what is linked so far."""
    members = met.unionAll(met.select("k", F.col("first").alias("doc"), "first").distinct())
    members = members.join(root.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    split = members.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("k")
    return members.join(split, "k", "left_semi")


def _star_pairs(apart: DataFrame, similarity: float, k: int) -> DataFrame:
    """(a, b): the smallest of a bucket, and each of it that is of another class and that sketches don't rule out."""
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("doc", "root", "n", "sketch")]
    centre = apart.where("doc = first").select("k", *side("a"))
    pairs = spread_join(apart.where("doc <> first").select("k", *side("b")), centre, ["k"]).where("root_a <> root_b")
    return pairs.where(_may_link(similarity, k)).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()


def _apart_pairs(apart: DataFrame, similarity: float, k: int) -> DataFrame:
    """(a, b) of one bucket but of different classes that sketches don't rule out; a bucket of very many is dealt over several tasks."""
    left, right = (apart.select("k", *[F.col(c).alias(f"{c}_{x}") for c in ("doc", "root", "n", "bands", "sketch")]) for x in "ab")
    least = -(-apart.count() // HOT_PARTS) + 1
    hot = F.broadcast(apart.groupBy("k").agg(F.count("*").alias("_n")).where(F.col("_n") > least).select("k", F.ceil(F.col("_n") / least).alias("_parts")))  # under HOT_PARTS rows
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    left = left.join(hot, "k", "left").withColumn("_salt", F.pmod(F.col("doc_a"), parts)).drop("_parts")
    right = right.join(hot, "k", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    # A pair is taken up in the first band that it shares, so once.
    same = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True)
    taken = F.expr("doc_a < doc_b and root_a <> root_b") & _may_link(similarity, k) & (same == F.array_position("bands_a", left.k))
    more = left.join(right, (left.k == right.k) & (left._salt == right._salt) & taken)
    return more.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, wide: int = WIDE, weigh: bool = False) -> DataFrame:
    """(doc_id, class_id), a row for each document; class_id is the smallest doc_id of the class.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles
    is at least ``similarity`` (weigh: of the multisets, each shingle weighted by its count);
    classes are what links connect. Words are what ASCII white space separates, unchanged. A
    text of fewer than five words has one shingle, of all its words; texts of the same words
    in the same order are copies, empty and null ones among them, and one of them stands for
    all from then on.

    Candidates share a band of DartMinHash signatures; each is verified by its whole sets.
    Every text is first compared with the smallest it shares a band with. Where these links
    leave a band's bucket in several classes, all are compared with the bucket's smallest, and
    where it is still in several, with each other, unless they are of one class already or
    their sketches (four bits of each coordinate) rule them out. No bucket is collected.

    A null doc_id stays null; a class without any id has a hash, below zero, as class_id.
    Rows that repeat a doc_id are documents of their own, in the classes of their texts. No
    rows: no rows. Other columns are ignored.
    """
    rows, classes = _classes(docs, similarity, bands, wide, weigh)
    named = F.coalesce("low", -F.shiftrightunsigned(F.xxhash64("least"), 1) - 1)
    return spread_join(rows, classes.select("h", named.alias("class_id")), ["h"]).select(F.col("id").alias("doc_id"), "class_id")


def keep_one(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One document of each class, unchanged: the one of the smallest doc_id, without any if no other; of its texts the one of the smallest hash."""
    rows, classes = _classes(docs, SIMILARITY, BANDS, WIDE, False)
    placed = spread_join(rows, classes.select("h", "root"), ["h"])
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("x"))
    best = best.select(id_or_lowest("x.id").alias("_id"), F.col("x.t").alias("_t"))
    # Rows of one id and text are reduced to one before they are shuffled.
    distinct = docs.select(*columns, id_or_lowest().alias("_id"), text_tag().alias("_t")).dropDuplicates(["_id", "_t"])
    return distinct.join(best, ["_id", "_t"], "left_semi").select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
