"""Whitening of embeddings with distributed block matrices.

Rows are indexed and cut into blocks of a ``BlockMatrix``. The transpose times the matrix
gives the scatter, the only matrix that the driver sees (dimensions squared, whatever the
number of rows); its eigenvectors make the whitening matrix, and the blocks times that matrix
are the whitened rows.

Sums, centring and deviations are exact: entries are put on a grid of integers first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripkit.llm.common import numbered
from tripkit.operators.layout import checkpointed

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
# Rows and columns of a block: 8 MB of doubles at most.
BLOCK_ROWS = 1024
BLOCK_COLUMNS = 1024
# So many row blocks are multiplied in one task of a scatter.
BLOCKS_A_TASK = 16
# Entries of the grid stay integers that a double holds exactly.
GRID_END = float(1 << 53)


@dataclass(frozen=True)
class Grid:
    """An entry ``c`` becomes ``floor(scale * c) + offset``."""

    scale: int = SCALE
    offset: int = OFFSET

    def of(self, embedding: Column) -> Column:
        """The grid vector; entries beyond 2**53 grid steps count as 2**53."""
        end = F.lit(GRID_END)

        def place(c: Column) -> Column:
            steps = c.cast("double") * F.lit(float(self.scale))
            return F.floor(F.greatest(F.least(steps, end), -end)).cast("long") + F.lit(self.offset).cast("long")

        return F.transform(embedding, place)


def _packed(rows: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """``(block, ids, x)``: numbered rows of ``(vec_id, x)`` in blocks, all full but the last.

    ``x`` holds a block's vectors one after another, as 4-byte integers where they fit.
    """
    schema = T.StructType().add("block", T.LongType()).add("ids", T.ArrayType(rows.schema["vec_id"].dataType)).add("x", T.BinaryType())
    kind = pa.list_(rows.limit(0).toArrow().schema.field("vec_id").type)

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group["number"].to_numpy())
        x = group["x"].combine_chunks().flatten().to_numpy().reshape(-1, dims)[order]
        small = np.abs(x).max() < 1 << 31
        ids = group["vec_id"].take(pa.array(order)).to_pylist()
        raw = x.astype("<i4" if small else "<i8").tobytes()
        return pa.table({"block": group["block"].slice(0, 1), "ids": pa.array([ids], kind), "x": pa.array([raw], pa.binary())})

    blocked = rows.select("vec_id", "x", "number", F.floor(F.col("number") / block_rows).cast("long").alias("block"))
    return checkpointed(blocked.groupBy("block").applyInArrow(pack, schema))


def _ints(raw: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * rows * dims else "<i8").reshape(rows, dims).astype(np.int64)


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, as machine integers where they suffice."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _column_sums(packed: DataFrame, dims: int) -> list[int]:
    """Exact sums of the columns: a partial sum for each partition, added up as decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            for ids, raw in zip(batch["ids"].to_pylist(), batch["x"].to_pylist(), strict=True):
                x = _ints(raw, len(ids), dims)
                exact = x if np.abs(x).max() < 1 << 50 else x.astype(object)
                total = [t + int(s) for t, s in zip(total, exact.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], ["at", "part"])

    parts = packed.select("ids", "x").mapInArrow(add, "at int, part string")
    found = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    sums = {r["at"]: int(r["total"]) for r in found}
    return [sums[i] for i in range(dims)]


def _centred(packed: DataFrame, dims: int, n: int, sums: list[int], shape: tuple[int, int], rows: int) -> BlockMatrix:
    """The rows less their mean as a distributed matrix of blocks."""
    height, width = shape

    def blocks(row):
        x = _exact(_ints(bytes(row["x"]), len(row["ids"]), dims), n, sums) / n
        x = np.asarray(x, np.float64)
        for at in range(0, dims, width):
            piece = x[:, at : at + width]
            yield (row["block"], at // width), DenseMatrix(*piece.shape, piece.ravel(order="F"))

    return BlockMatrix(packed.select("block", "ids", "x").rdd.flatMap(blocks), height, width, rows, dims)


def _scatter(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    """The transpose times the matrix.

    The rows are the middle dimension of this product. It is dealt out to tasks of
    ``BLOCKS_A_TASK`` blocks, whose products are added up; a single call of ``multiply`` without
    that number would gather all rows in one task.
    """
    turned = matrix.transpose()
    splits = max(1, -(-blocks // BLOCKS_A_TASK))
    made = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _local(spark: SparkSession, matrix: np.ndarray, height: int) -> BlockMatrix:
    """A matrix of the driver (dimensions by components) as a distributed one."""
    pieces = [((at // height, 0), matrix[at : at + height]) for at in range(0, len(matrix), height)]
    blocks = [(key, DenseMatrix(*piece.shape, piece.ravel(order="F"))) for key, piece in pieces]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), height, matrix.shape[1], *matrix.shape)


def _rows_of(spark: SparkSession, blocks: RDD) -> DataFrame:
    """``(at, y)``: the number and the entries, row after row, of each row block of a product."""
    rows = blocks.map(lambda b: (int(b[0][0]), bytearray(np.ascontiguousarray(b[1].toArray(), "<f8").tobytes())))
    return spark.createDataFrame(rows, "at long, y binary")


def whiten(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    components: int = COMPONENTS,
    grid: Grid | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(vec_id, dims, n, deviation, whitened, explained, identity_error)``, a row for each sound row.

    Rows whose vector is NULL, empty or holds NULL or non-finite entries are left out. The others
    go to the grid. The fit list is each distinct grid vector once: ``n`` vectors, whose mean
    and covariance (divisor ``n``, centred first) decide the principal components, in falling
    order of variance, the sign such that the largest entry is positive. ``whitened`` has a row's coordinate on
    each of the first ``components`` (all, if the vectors have fewer entries) over the root of
    its variance, and ``explained`` the share of each in the whole variance. ``deviation`` is
    the sum of ``(n * x - sum)**2``, exact; NULL if a long can't hold it. ``identity_error`` is the largest
    entry of the difference between the covariance of the whitened fit list and the identity.

    A component without variance (fewer distinct vectors than components, constant entries)
    has NULL in ``whitened`` and doesn't count for ``identity_error``; without any variance
    ``explained`` is NULL and ``identity_error`` 0. Vectors of different length are whitened apart, length
    after length: one fit each. Ids may be NULL or repeated, and every row gets its result.
    No rows give no rows.

    The driver holds matrices of dimensions squared and one key of every block of 1,024 rows,
    which the multiplication lists to place the blocks.
    """
    spark, grid = vectors.sparkSession, grid or Grid()
    entries = F.col(embedding)
    sound = (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(entries.isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(vec_id).alias("vec_id"), grid.of(entries).alias("x")
    )
    sizes = [r["dims"] for r in rows.groupBy(F.size("x").alias("dims")).agg(F.lit(1)).orderBy("dims").collect()]
    parts = [_whitened(spark, rows.where(F.size("x") == size), size, components, block_rows) for size in sizes]
    if not parts:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, dims int, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def _whitened(spark: SparkSession, rows: DataFrame, dims: int, components: int, block_rows: int) -> DataFrame:
    distinct = numbered(rows.select("x").distinct(), "number").withColumn("vec_id", F.lit(None).cast("long"))
    fit = _packed(distinct, dims, block_rows)
    every = _packed(numbered(rows, "number"), dims, block_rows)
    count = F.sum(F.size("ids")).alias("rows")
    (n, fit_blocks), (total, all_blocks) = ([int(v) for v in p.agg(count, F.count(F.lit(1))).first()] for p in (fit, every))
    sums = _column_sums(fit, dims)

    width = min(dims, BLOCK_COLUMNS)
    matrix = _centred(fit, dims, n, sums, (block_rows, width), n)
    covariance = _scatter(matrix, fit_blocks) / n
    values, bases = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, dims)
    values, bases = values[::-1][:k], bases[:, ::-1][:, :k]
    bases = bases * np.where(bases[np.abs(bases).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    live = values > max(values[0], 0.0) * dims * np.finfo(float).eps
    explained = [float(max(v, 0.0) / trace) if trace > 0 else None for v in values]
    projection = _local(spark, bases / np.sqrt(np.where(live, values, 1.0)), width)

    spread = _scatter(matrix.multiply(projection), fit_blocks) / n
    gap = np.abs(spread - np.eye(k))[np.ix_(live, live)]
    error = float(gap.max(initial=0.0))

    product = _centred(every, dims, n, sums, (block_rows, width), total).multiply(projection)
    joined = every.join(_rows_of(spark, product.blocks), F.col("block") == F.col("at")).select("ids", "x", "y")
    dead = np.flatnonzero(~live).tolist()
    schema = T.StructType().add("vec_id", rows.schema["vec_id"].dataType)
    for name, kind in (("dims", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "array<double>")):
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch["ids"][i].values
                x, y = _ints(batch["x"][i].as_py(), len(ids), dims), np.frombuffer(batch["y"][i].as_py(), "<f8")
                exact = _exact(x, n, sums)
                if exact.dtype == object or dims * float(np.abs(exact).max()) ** 2 >= 2.0**62:
                    exact = exact.astype(object)
                far = [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1).tolist()]
                if dead:
                    y = y.reshape(len(ids), k).astype(object)
                    y[:, dead] = None
                    y = y.ravel().tolist()
                whitened = pa.ListArray.from_arrays(pa.array(range(0, (len(ids) + 1) * k, k), pa.int32()), pa.array(y, pa.float64()))
                same = [pa.array([v] * len(ids), t) for v, t in ((dims, pa.int32()), (n, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *same, pa.array(far, pa.int64()), whitened], names=schema.names)

    return joined.mapInArrow(unpack, schema).select(
        "*", F.array(*[F.lit(e).cast("double") for e in explained]).alias("explained"), F.lit(error).alias("identity_error")
    )
