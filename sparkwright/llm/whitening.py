"""Whitening of embeddings on Spark MLlib's BlockMatrix.

Rows are numbered without gaps, centred and dealt into blocks of a
``BlockMatrix``. The transpose times the matrix is the scatter (dimensions by
dimensions), whose eigenvectors come from one local ``eigh``. The blocks times
the whitening matrix are the projected rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import save_intermediate

SCALE, OFFSET = 64, 1_000_000    # the fixed-point form of a component (fixed by the query's contract)
COMPONENTS = 32
BLOCK_BYTES = 32 << 20           # largest block of rows
LEAST_BLOCK_ROWS = 256
BLOCKS_PER_TASK = 4              # blocks whose products one task adds up
FLAT = 1e-12                     # an eigenvalue below this share of the largest is no direction of the data

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null and no non-finite entry."""
    d = F.transform(vector, lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(d, fine), F.lit(False))


def fixed_point(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry, as long. An entry whose value does
    not fit into a long is an overflow error, not a wrong number."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index``, gapless from 0: its place in the written part
    plus the rows of the parts before it. The driver sees one count per part."""
    spark = rows.sparkSession
    own = rows.withColumn("part", F.spark_partition_id().cast("long"))
    own = save_intermediate(own.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "vectors")
    ahead, starts = 0, []
    for r in own.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r.part, ahead))
        ahead += r.n
    before = spark.createDataFrame(starts, "part long, ahead long")
    # One row per part of the written table: its number is known before the join.
    return own.join(F.broadcast(before), "part").withColumn("index", F.col("place") + F.col("ahead")).drop("part", "place", "ahead")


def block_matrix(rows: DataFrame, n: int, d: int, block_rows: int) -> BlockMatrix:
    """Blocks of ``block_rows`` rows from the frame (index, vector array); stays in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(block_rows, d)


def product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a times b, the inner dimension in ``splits`` parts. Each part is one
    task's sum of block products and the sums are reduced, so that no task
    meets all blocks where the result is a single one."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def local_block(spark: SparkSession, values: np.ndarray) -> BlockMatrix:
    """A small matrix as a BlockMatrix of one block."""
    r, c = values.shape
    block = DenseMatrix(r, c, values.ravel(order="F"))
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), r, c)


def scatter(blocks: BlockMatrix, n_blocks: int) -> np.ndarray:
    """Transpose times matrix, gathered: dimensions by dimensions."""
    return product(blocks.transpose(), blocks, -(-n_blocks // BLOCKS_PER_TASK)).toLocalMatrix().toArray()


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """(index, vector array) of a BlockMatrix; stays in the JVM."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.toDF("index", "vector").select("index", vector_to_array("vector").alias("vector"))


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``df`` and component (from 1, by falling
    eigenvalue): vec_id, component, n, deviation, whitened, explained, identity_error.

    All usable rows are the fit list; entries are taken in fixed point
    (``fixed_point``). ``deviation`` is exact; ``whitened`` is the centred row on the
    component over the root of its eigenvalue; ``explained`` its share of the
    trace; ``identity_error`` the largest entry by which the covariance of
    all ``whitened`` values, computed from them, differs from the identity.

    Null vectors and those with null or non-finite entries are dropped. Rows
    with equal or null ids are kept apart. Components whose eigenvalue is zero
    (below ``FLAT`` of the largest) have no direction and are left out, so a
    table of equal vectors, of one row or of none gives no rows. Vectors of
    more than one length are refused. Other columns are not read.

    The driver holds the scatter, a number per block of rows (at most 32 MB
    each) and one per written part; no task holds more than a few blocks.
    """
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), fixed_point(F.col(vector_col)).alias("x"))
    rows = _numbered(rows)
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("d"), F.max(F.size("x")).alias("most")).first()
    if one.d != one.most:
        raise ValueError(f"vectors have {one.d} to {one.most} entries")
    n, d = one.n, one.d
    empty = spark.createDataFrame([], RESULT)
    if not n or not d:
        return empty
    entries = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at")
    totals = entries.agg(F.sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    sums = [int(r.s) for r in totals]
    # n * x - S, exactly; the largest bounds the squared sum, which beyond 63 bits is summed in decimals.
    most = max(max(abs(n * r.low - r.s), abs(n * r.high - r.s)) for r in totals)
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    off = F.zip_with("x", total, lambda x, s: F.lit(n).cast("long") * x - s)
    if most * most * d < 2**63:
        deviation = F.aggregate(off, F.lit(0).cast("long"), lambda a, y: a + y * y)
    else:
        wide = lambda y: y.cast("decimal(19,0)")
        deviation = F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda a, y: (a + wide(y) * wide(y)).cast("decimal(38,0)")).cast("long")
    centred = rows.select("index", F.transform(off, lambda y: y.cast("double") / F.lit(float(n))).alias("vector"))
    parallel = max(1, spark.sparkContext.defaultParallelism)
    block_rows = max(1, min(BLOCK_BYTES // (8 * d), max(LEAST_BLOCK_ROWS, -(-n // (BLOCKS_PER_TASK * parallel)))))
    blocks = block_matrix(centred, n, d, block_rows)
    n_blocks = -(-n // block_rows)
    covariance = scatter(blocks, n_blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > FLAT * max(values.max(), 0.0)]
    if not len(order):
        return empty
    whitening = vectors[:, order] / np.sqrt(values[order])
    explained = values[order] / np.trace(covariance)
    projected = save_intermediate(rows_of(product(blocks, local_block(spark, whitening), 1)), "whitened")
    k = len(order)
    means = projected.select([F.avg(F.get("vector", i)).alias(f"m{i}") for i in range(k)]).first()
    level = F.array(*[F.lit(m) for m in means])
    again = block_matrix(projected.select("index", F.zip_with("vector", level, lambda x, m: x - m).alias("vector")), n, k, block_rows)
    error = float(np.abs(scatter(again, n_blocks) / n - np.eye(k)).max())
    shares = F.array(*[F.lit(float(e)) for e in explained])
    both = rows.select("index", "vec_id", deviation.alias("deviation")).join(projected, "index")
    return both.select("vec_id", "deviation", F.posexplode("vector").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
