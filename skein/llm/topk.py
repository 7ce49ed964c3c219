"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import shared_folder, write_table

K = 5
#: Queries of one wave, and bytes of their vectors: what is broadcast at once is bounded by both.
WAVE_ROWS, WAVE_BYTES = 2048, 16 << 20
#: Bits of a histogram's digit at most.
MOST_BITS = 10
_ROWS = 1024
_LEAST, _MOST = -(2**63), 2**63 - 1


def floored(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double, as longs; null if the vector or a component is null or not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Past the range of a long a component is held at its end.
    return F.when(fine, F.transform(doubles, lambda x: F.floor(F.least(F.greatest(x * float(scale), F.lit(-(2.0**63))), F.lit(2.0**63 - 1024)))))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of long) for each length of vector."""
    offsets = column.offsets.to_numpy()
    flat, size = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, flat[offsets[at][:, None] + np.arange(dim)]


def _norms(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return np.sqrt((y * y).sum(axis=1)) * (1 + 1e-9)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b, as longs; what is past a long is held at its ends.

    No partial sum of an inner product exceeds the product of the norms. Where that fits,
    matrices of floats are exact; rows too large for that are worked out in integers, and
    in Python's own where longs don't suffice.
    """
    out = np.empty((len(a), len(b)), np.int64)
    if not a.shape[1] or not len(a) or not len(b):
        out[:] = 0
        return out
    na, nb = _norms(a), _norms(b)
    small_a, small_b = na < 2.0**26, nb < 2.0**26
    for qa, qb in ((small_a, small_b), (~small_a, small_b), (small_a, ~small_b), (~small_a, ~small_b)):
        if not qa.any() or not qb.any():
            continue
        x, y = a[qa], b[qb]
        most = na[qa].max() * nb[qb].max()
        if most < 2.0**53:
            exact = np.float32 if most < 2.0**24 else np.float64
            found = (x.astype(exact) @ y.astype(exact).T).astype(np.int64)
        elif most < 2.0**62:
            found = x @ y.T
        else:
            found = np.clip(x.astype(object) @ y.astype(object).T, _LEAST, _MOST).astype(np.int64)
        out[np.ix_(qa, qb)] = found
    return out


class _Wave:
    """A bounded set of queries as it is broadcast: ids, and vectors by length."""

    def __init__(self, rows: list):
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        size = np.array([len(r.v) for r in rows])
        self.by_dim = {}
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            self.by_dim[int(dim)] = (at, np.array([rows[i].v for i in at], np.int64).reshape(len(at), dim))

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries' places, candidates' ids, scores, which pairs aren't a query and its own id) of a batch of candidates."""
        ids = batch.column("vec_id").to_numpy()
        for rows, matrix in _vectors(batch.column("v")):
            if (known := self.by_dim.get(matrix.shape[1])) is None:
                continue
            at, vectors = known
            yield at, ids[rows], inner_products(vectors, matrix), self.ids[at][:, None] != ids[rows][None, :]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _digits(reach: float) -> tuple[int, int, int]:
    """(lowest score, bits of a digit, digits) that hold all scores within reach, in as few rounds as MOST_BITS allows."""
    base = max(_LEAST, -int(min(reach, 2.0**63)) - 1)
    bits = max(1, (2 * -base).bit_length())
    rounds = -(-bits // MOST_BITS)
    return base, -(-bits // rounds), rounds


def _lifted(scores: np.ndarray, base: int) -> np.ndarray:
    """How far scores lie over base."""
    return scores.view(np.uint64) - np.array([base], np.int64).view(np.uint64)


def _histogram(shared, k: int, base: int, bits: int, place: int):
    """For each query: of the scores that share its known leading digits, how many have which next digit; from the top until k are met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, prefix = shared.value
        bins = 1 << bits
        counts = np.zeros((len(wave.ids), bins), np.int64)
        for batch in _batches(batches):
            for at, _, scores, other in wave.scored(batch):
                u = _lifted(scores, base) >> np.uint64(bits * place)
                fits = other & (u >> np.uint64(bits) == prefix[at][:, None])
                cell = np.where(fits, np.arange(len(at))[:, None] * bins + (u & np.uint64(bins - 1)).astype(np.int64), len(at) * bins)
                counts[at] += np.bincount(cell.ravel(), minlength=len(at) * bins + 1)[:-1].reshape(len(at), bins)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_pydict({"q": pa.array(q.astype(np.int32)), "bin": pa.array(b.astype(np.int32)), "n": pa.array(counts[q, b])})

    return run


def _select(shared, k: int):
    """For each query the candidates scoring over its kth value, and of those at it the k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, kth = shared.value
        for batch in _batches(batches):
            for at, ids, scores, other in wave.scored(batch):
                order = np.argsort(ids, kind="stable")
                ids, scores, other = ids[order], scores[:, order], other[:, order]
                low = kth[at][:, None]
                tie = (scores == low) & other
                q, c = np.nonzero((scores > low) & other | tie & (np.cumsum(tie, axis=1) <= k))
                yield pa.RecordBatch.from_pydict({"q": pa.array(at[q].astype(np.int32)), "query_id": pa.array(wave.ids[at[q]]), "vec_id": pa.array(ids[c]), "score": pa.array(scores[q, c])})

    return run


def _kth_values(candidates: DataFrame, wave: _Wave, k: int, reach: float) -> np.ndarray:
    """Each query's kth highest score, or the least long where there are fewer candidates.

    Digit by digit: histograms summed over all candidates say which digit the kth value has
    next. What comes back to the driver is one row a query of the wave.
    """
    spark = candidates.sparkSession
    base, bits, rounds = _digits(reach)
    n = len(wave.ids)
    need, prefix, few = np.full(n, k), np.zeros(n, np.uint64), np.zeros(n, bool)
    down = Window.partitionBy("q").orderBy(F.desc("bin"))  # at most 2**bits rows a query
    for place in range(rounds - 1, -1, -1):
        shared = spark.sparkContext.broadcast((wave, prefix))
        counted = candidates.mapInArrow(_histogram(shared, k, base, bits, place), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        asked = spark.createDataFrame([(int(q), int(x)) for q, x in enumerate(need)], "q int, need long")
        ranked = counted.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(asked), "q")
        found = ranked.where("upto >= need and upto - n < need").select("q", "bin", (F.col("need") - (F.col("upto") - F.col("n"))).alias("still")).collect()
        reached = np.zeros(n, bool)
        prefix <<= np.uint64(bits)
        for r in found:
            reached[r.q] = True
            prefix[r.q] |= np.uint64(r.bin)
            need[r.q] = r.still
        few |= ~reached
        shared.destroy()
    kth = (prefix + np.array([base], np.int64).view(np.uint64)).view(np.int64)
    return np.where(few, _LEAST, kth)


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    queries and candidates have vec_id and v, an array of long (see :func:`floored`). The
    candidates stay in their partitions; queries come to them in waves of bounded size, and
    every wave is scored against every candidate of the same vector length. No pair ever
    leaves a task: the tasks' histograms are summed for each query, the bin that holds the kth
    value is refined until it is one value wide; then the scores over that value, and of
    those at it the smallest ids, are kept.

    Rows with null id or v take no part. A query never meets candidates of its own id; one
    that repeats with the same vector is asked once, with other vectors once for each, and
    in candidates each row counts. Fewer than k candidates: all of them. Scores are
    exact, and past a long held at its ends. No rows: no rows. Other columns are ignored.
    """
    spark = queries.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    fit = lambda x: x.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long"), F.col("v").cast("array<long>"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    asked = write_table(fit(queries).distinct(), "queries")
    rows = write_table(fit(candidates), "candidates")
    nq, size, mq = asked.agg(F.count("*"), F.sum(F.size("v") * 8 + 64), F.max(norm)).first()
    mc = rows.agg(F.max(norm)).first()[0]
    if not nq or mc is None:
        return spark.createDataFrame([], result)
    # Dealt by hash, so a wave is a little more or less than its share: half of what is allowed.
    waves = max(1, -(-2 * nq // WAVE_ROWS), -(-2 * size // WAVE_BYTES)) if nq > WAVE_ROWS or size > WAVE_BYTES else 1
    asked = asked.withColumn("wave", F.pmod(F.xxhash64("vec_id", "v"), F.lit(waves)))
    folder = f"{shared_folder(spark)}/skein-top-{uuid.uuid4().hex}"
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    spark.createDataFrame([], result).write.parquet(folder)
    for number in range(waves):
        wave = _Wave(sorted(asked.where(F.col("wave") == number).select("vec_id", "v").collect(), key=lambda r: (r.vec_id, r.v)))
        if not len(wave.ids):
            continue
        kth = _kth_values(rows, wave, k, float(mq) * float(mc) * (1 + 1e-9) + 1)
        shared = spark.sparkContext.broadcast((wave, kth))
        kept = rows.mapInArrow(_select(shared, k), "q int, query_id long, vec_id long, score long")
        best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.schema(result).parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), floored(F.col("embedding")).alias("v"))
    return exact_top_k(rows.where("vec_id % 50 = 0"), rows)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
