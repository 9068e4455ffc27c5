"""Embedding whitening with Spark MLlib's BlockMatrix.

1. Vectors become whole numbers x (common.fixed_point). The fit list holds each distinct x
   once; it is written with a row number, so that every later read sees the same numbering.
2. The centred rows are indexed and dealt into distributed blocks of BLOCK_ROWS rows
   (IndexedRowMatrix.toBlockMatrix). Transpose-multiply gives the scatter matrix; the middle
   dimension is split, so that no task gets more than SPLIT_BLOCKS blocks of either side.
3. The scatter matrix, whose size is that of a vector squared, is decomposed locally (eigh).
   Eigenvectors over the roots of their eigenvalues are the whitening matrix.
4. BlockMatrix multiplication by it projects the rows. The covariance of the projection is
   measured in the same manner, and its distance from the identity reported.
5. Each row of the table takes the projection of its x by a 128-bit hash of x. Only these
   short rows are shuffled, and a vector with very many copies is salted (skew.attach).

The driver holds one d x d matrix, and the block coordinates that BlockMatrix.multiply
gathers: two integers for each block of BLOCK_ROWS vectors.

Defined results: rows whose vector is null, empty, of another length than most, or holds null
or non-finite entries are left out; repeated rows and null ids are rows like others; a
component without variance (beyond rounding) has whitened null, and identity_error is taken
over the others (null if there are none); a deviation that no long can hold is null; a table
without such rows gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlark.llm.common import fixed_point, table
from orderlark.operators.skew import attach
from orderlark.session import stored

COMPONENTS = 4
BLOCK_ROWS = 1024
BLOCK_COLUMNS = 1024
#: Blocks of either operand that one task multiplies.
SPLIT_BLOCKS = 16
#: Eigenvalues below this share of the largest one are taken for rounding.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int | None]  # per dimension; None where no long holds it
    means: list[float]
    matrix: np.ndarray  # d x components, zero columns for components without variance
    values: np.ndarray  # eigenvalues of the components
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.values > NO_VARIANCE * max(self.trace, 0.0)


def fit_list(kept: DataFrame) -> DataFrame:
    """Each distinct x once: index (dense from 0), h1, h2 (hash of x), x."""
    once = kept.select("x").distinct()
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(once.select("x", *hashes(), F.spark_partition_id().alias("part"), inside.alias("at")), "vectors")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a write task.
    offsets = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return stored(rows.join(offsets, "part").select((F.col("offset") + F.col("at")).alias("index"), "h1", "h2", "x"), "fit")


def hashes() -> list:
    return [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(5), "x", F.lit(7)).alias("h2")]


def blocks(fit: DataFrame, means: list[float], n: int) -> BlockMatrix:
    """The centred rows as a distributed matrix of n rows."""
    at = F.lit(means)
    centred = fit.select("index", array_to_vector(F.transform("x", lambda c, i: c.cast("double") - F.get(at, i))).alias("vector"))
    rows = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, len(means))
    # Read by both multiplications; a lost block is built again from the stored rows.
    return rows.toBlockMatrix(BLOCK_ROWS, min(BLOCK_COLUMNS, len(means))).persist(StorageLevel.MEMORY_AND_DISK)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, as a local array of columns x columns."""
    splits = -(-matrix.numRows() // (BLOCK_ROWS * SPLIT_BLOCKS))
    left, right = matrix.transpose()._java_matrix_wrapper, matrix._java_matrix_wrapper
    # The form with a split middle dimension is public in Spark but has no Python method:
    # without it a narrow result is computed in a single task.
    product = BlockMatrix(left.call("multiply", right._java_model, splits), matrix.colsPerBlock, matrix.colsPerBlock)
    return product.toLocalMatrix().toArray()


def local_blocks(spark: SparkSession, array: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A small array as a matrix that is cut along its rows."""
    rows, columns = array.shape
    cut = [array[at : at + rows_per_block] for at in range(0, rows, rows_per_block)]
    dealt = [((i, 0), DenseMatrix(len(part), columns, part.ravel(order="F"))) for i, part in enumerate(cut)]
    return BlockMatrix(spark.sparkContext.parallelize(dealt, 1), rows_per_block, columns, rows, columns)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, BlockMatrix] | None:
    """The whitening of a fit list, and its centred blocks; None for an empty list."""
    per = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i")
    rows = per.agg(F.count(F.lit(1)).alias("n"), F.try_sum("c").alias("s"), F.avg(F.col("c").cast("double")).alias("m")).orderBy("i").collect()
    if not rows:
        return None
    n = rows[0]["n"]
    means = [r["m"] if r["s"] is None else r["s"] / n for r in rows]
    matrix = blocks(fit, means, n)
    covariance = scatter(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    found = Whitening(n, [r["s"] for r in rows], means, np.zeros(vectors.shape), np.maximum(values, 0.0), float(np.trace(covariance)))
    found.matrix[:, found.live] = vectors[:, found.live] / np.sqrt(values[found.live])
    return found, matrix


def projected(matrix: BlockMatrix, whitening: Whitening, spark: SparkSession) -> tuple[DataFrame, float | None]:
    """(index, whitened) of the fit list, and the largest entry of the projection's covariance
    minus the identity."""
    product = matrix.multiply(local_blocks(spark, whitening.matrix, matrix.colsPerBlock))
    live = whitening.live
    covariance = scatter(product)[np.ix_(live, live)] / whitening.n
    error = float(np.abs(covariance - np.eye(len(covariance))).max()) if live.any() else None

    def rows(block):
        (i, _), values = block
        return [(i * BLOCK_ROWS + r, [float(v) for v in row]) for r, row in enumerate(values.toArray())]

    return spark.createDataFrame(product.blocks.flatMap(rows), "index long, whitened array<double>"), error


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    remaining row of the table and component."""
    spark = df.sparkSession
    kept = fixed_point(df, id_col, vec_col)
    fit = fit_list(kept)
    found = fitted(fit, components)
    if found is None:
        return spark.createDataFrame([], f"{kept.select('vec_id')._jdf.schema().toDDL()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    whitening, matrix = found
    values, error = projected(matrix, whitening, spark)
    n, sums = F.lit(whitening.n).cast("long"), F.array(*[F.lit(s).cast("long") for s in whitening.sums])
    apart = F.transform("x", lambda c, i: F.try_subtract(F.try_multiply(n, c), F.get(sums, i)))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))
    per_vector = stored(fit.select("index", "h1", "h2", deviation.alias("deviation")).join(values, "index").drop("index"), "whitened")
    rows = attach(kept.select("vec_id", *hashes()), per_vector, ["h1", "h2"], how="inner")
    facts = [
        F.struct(
            F.lit(k + 1).alias("component"),
            (F.get("whitened", F.lit(k)) if live else F.lit(None).cast("double")).alias("whitened"),
            F.lit(float(value / whitening.trace) if whitening.trace > 0 else 0.0).alias("explained"),
        )
        for k, (value, live) in enumerate(zip(whitening.values, whitening.live, strict=True))
    ]
    each = rows.select("vec_id", "deviation", F.explode(F.array(*facts)).alias("c"))
    return each.select("vec_id", "c.component", n.alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLE = {}
