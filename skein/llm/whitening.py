"""Whitening of vectors: distributed block matrices for the scatter and the projection, a local eigensolver between.

The products are MLlib's ``BlockMatrix``: centred rows are indexed and dealt into blocks, the
transpose times the rows is the scatter, whose eigenvectors are found on the driver (it has a
row and a column for each dimension), and the rows times the whitening matrix are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import numbered, slices, write_table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries are held at this size, so that sums of a thousand stay in a long.
_MOST = 1 << 52
#: Rows and columns of a block: 8 MB at most.
_BLOCK = 1024
#: Eigenvalues of at most this share of the largest are zero but for rounding.
_ZERO = 1e-12
OUT = "{id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Centre:
    """Of the distinct rows: how many, their sums by dimension, and the largest entry's size."""

    n: int
    sums: list[int]
    largest: int


def _longs(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _moments(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, largest = 0, np.zeros(width, object), 0
        for batch in slices(batches, 1000):
            x = _longs(batch.column("x"), width)
            n, sums, largest = n + len(x), sums + x.sum(0).astype(object), max(largest, int(np.abs(x).max(initial=0)))
        if n:
            yield pa.RecordBatch.from_pydict({"dimension": np.arange(width, dtype=np.int32), "n": np.full(width, n), "s": [str(s) for s in sums], "largest": np.full(width, largest)})

    return emit


def centre_of(fit: DataFrame, width: int) -> Centre:
    """fit: a column x, an array<long> of ``width`` entries. A task sends one row for each dimension."""
    made = fit.select("x").mapInArrow(_moments(width), "dimension int, n long, s string, largest long")
    rows = made.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("largest").alias("largest")).orderBy("dimension").collect()
    return Centre(rows[0].n, [int(r.s) for r in rows], max(r.largest for r in rows))


def _centred(width: int, centre: Centre):
    # Longs where no value can pass them, else Python's integers.
    reach = centre.n * centre.largest + max(map(abs, centre.sums))
    kind = np.int64 if reach < 2**62 else object
    small = width * reach * reach < 2**62

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(centre.sums, kind)
        for batch in slices(batches, 1000):
            apart = _longs(batch.column("x"), width).astype(kind) * centre.n - sums
            whole = apart if small else apart.astype(object)
            deviation = [min(int(d), 2**63 - 1) for d in (whole * whole).sum(1)]
            values = (apart / centre.n).astype(np.float64).ravel()
            ends = np.arange(0, len(values) + 1, width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("index"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["index", "deviation", "centred"])

    return emit


def _blocks(indexed: DataFrame, rows: int, width: int) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(indexed.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, rows, width).toBlockMatrix(_BLOCK, min(width, _BLOCK))


def _scatter(matrix: BlockMatrix, rows: int) -> np.ndarray:
    """Transpose times matrix. The product is of few blocks, so what is summed is dealt over tasks of some 32 blocks."""
    splits = max(1, rows // (32 * _BLOCK))
    flipped = matrix.transpose()
    product = flipped._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _as_blocks(spark: SparkSession, local: np.ndarray, height: int) -> BlockMatrix:
    parts = [((i, 0), Matrices.dense(len(p), p.shape[1], p.ravel(order="F").tolist())) for i, p in enumerate(local[at : at + height] for at in range(0, len(local), height))]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), height, local.shape[1])


def _whiten(rows: DataFrame, width: int, components: int) -> DataFrame:
    spark = rows.sparkSession
    fit = numbered(rows.select("x").distinct(), "fit", "index")
    centre = centre_of(fit, width)
    centred = lambda df: df.select("index", "x").mapInArrow(_centred(width, centre), "index long, deviation long, centred array<double>")
    matrix = _blocks(centred(fit), centre.n, width).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = _scatter(matrix, centre.n) / centre.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    kept = min(components, width)
    values, vectors = np.maximum(values[::-1], 0)[:kept], vectors[:, ::-1][:, :kept]
    there = values > _ZERO * values[0]
    turn = np.where(there, vectors / np.sqrt(np.where(there, values, 1)), 0)
    project = lambda m: m.multiply(_as_blocks(spark, turn, m.colsPerBlock))
    error = None
    if there.any():
        own = (_scatter(project(matrix), centre.n) / centre.n - np.eye(kept))[there][:, there]
        error = float(np.abs(own).max())
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)

    indexed = write_table(numbered(rows, "rows", "index"), "indexed")
    apart = write_table(centred(indexed), "centred")
    result = project(_blocks(apart, apart.count(), width)).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", result._java_matrix_wrapper._java_model)
    found = found.select("index", F.posexplode(vector_to_array("vector")).alias("place", "whitened"))
    total = float(np.trace(covariance))
    shares = F.array(*[F.lit(float(v) / total if total > 0 else None).cast("double") for v in values])
    flags = F.array(*[F.lit(bool(x)) for x in there])
    return found.join(apart.select("index", "deviation"), "index").join(indexed.select("index", "_id"), "index").select(
        "_id", (F.col("place") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation",
        F.when(F.get(flags, F.col("place")), F.col("whitened")).alias("whitened"), F.get(shares, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or empty or hold null or non-finite entries take no part. An entry c counts as the
    integer floor(64 c) + 1000000 (floor(64 c) is held between -2**52 and 2**52). The covariance,
    of divisor n, is over the n distinct vectors; components are its eigenvectors, by falling
    eigenvalue. deviation is the exact sum of (n x - S)**2 over the dimensions, S the sums of the distinct
    vectors, held at the largest long. explained is the eigenvalue's share of the trace. identity_error
    is measured on the whitened distinct vectors.

    A component without variance has whitened null; where no vector differs from another,
    explained and identity_error are null too. Vectors of several lengths are whitened by
    length, each like a table of its own. Rows that repeat an id, or have none, stay each. No
    rows: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(_MOST)), F.lit(-_MOST)) + SHIFT
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole).select(F.col(id).alias("_id"), F.transform(vector, held).alias("x"))
    rows = write_table(rows, "vectors")
    widths = sorted(r.w for r in rows.select(F.size("x").alias("w")).distinct().collect())
    made = [_whiten(rows.where(F.size("x") == w), w, components) for w in widths]
    if not made:
        return spark.createDataFrame([], OUT.format(id=f"`{id}` {vectors.schema[id].dataType.simpleString()}"))
    out = made[0]
    for more in made[1:]:
        out = out.unionAll(more)
    return out.withColumnRenamed("_id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
