"""Whitening of factor snapshots on MLlib's distributed block matrices.

1. Exact sums give each factor's mean; every snapshot is centred before anything is multiplied.
2. The centred rows get an index, from counts per partition, and are laid out in blocks (``IndexedRowMatrix`` to
   ``BlockMatrix``).
3. The transposed matrix times the matrix is the scatter. The rows in the middle of that product are split into as many
   parts as there are partitions, and the parts' small products are summed, so no task sees the whole table.
4. The scatter of the factors, a square of their number, is solved on the driver by ``numpy.linalg.eigh``.
5. The matrix times the whitening matrix projects the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegralType

from tidegauge.llm.schemas import schema
from tidegauge.session import materialise

BLOCK_BYTES = 1 << 20  # of the doubles of one block
BLOCK_COLS = 1024
#: Eigenvalues up to this share of the largest are rounding: such a direction has no variance to divide by.
NOTHING = 1e-12
_ROW_BITS = 33  # low bits of monotonically_increasing_id
_EXACT = "decimal(38,0)"


def _usable(values: str | Column) -> Column:
    """Not null, and no entry null, infinite or not a number."""
    kept = F.forall(F.col(values).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(values).isNotNull() & F.coalesce(kept, F.lit(False))


def _indexed(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows numbered from 0 without a gap and without a sort, and their number; one small row per partition is joined back."""
    numbered = materialise(df.withColumn("_mid", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = numbered.join(F.broadcast(offsets), "_part")
    index = (F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_offset")).alias("index")
    return placed.select("*", index).drop("_mid", "_part", "_offset"), numbered.count()


def _product(left: BlockMatrix, right: BlockMatrix, parts: int) -> BlockMatrix:
    """``left`` times ``right``; the dimension in the middle is dealt over ``parts`` parts of each result partition."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def whiten(snapshots: DataFrame, components: int = 8) -> DataFrame:
    """Whitened principal components of ``snapshots(security_code, factor_values, ...)``.

    Covariances have the divisor ``n``, the number of snapshots. Components are unit eigenvectors of the covariance,
    numbered from 1 by falling eigenvalue; each takes the sign that makes its largest entry positive. At most
    ``components`` are given, fewer if there are fewer factors or if a direction has no variance: equal snapshots, or a
    single one, have none and give no row.

    Returns per snapshot and component ``security_code, component, n, deviation, whitened, explained,
    identity_error``: ``deviation`` is the sum over factors of ``(n * value - sum of values) ** 2``, exact as
    ``decimal(38,0)`` when the values are whole numbers and a double otherwise; ``whitened`` the centred snapshot on the
    component over the root of the eigenvalue; ``explained`` the eigenvalue's share of all variance;
    ``identity_error``, one value, the largest absolute entry of the covariance of the whitened columns minus the
    identity.

    Snapshots whose values are null or hold a null or non-finite entry are dropped, as are those that do not have the
    most frequent number of values (the larger on a tie). Null and repeated security codes are kept, a row for each;
    other columns are ignored; an empty table gives an empty result.
    """
    values = snapshots.schema["factor_values"].dataType
    whole = isinstance(values, ArrayType) and isinstance(values.elementType, IntegralType)
    if not whole and not (isinstance(values, ArrayType) and isinstance(values.elementType, (DoubleType, FloatType))):
        raise ValueError("factor_values must be an array of whole or floating-point numbers")
    cast = "array<long>" if whole else "array<double>"
    key = ("security_code", snapshots.schema["security_code"].dataType)
    usable = snapshots.where(_usable("factor_values")).select("security_code", F.col("factor_values").cast(cast).alias("factor_values"))
    lengths = usable.groupBy(F.size("factor_values").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    spark, deviation = snapshots.sparkSession, _EXACT if whole else "double"
    made = schema(key, f"component int, n long, deviation {deviation}, whitened double, explained double, identity_error double")
    if lengths is None or not lengths["d"]:
        return spark.createDataFrame([], made)
    d = lengths["d"]
    rows, n = _indexed(usable.where(F.size("factor_values") == d))

    each = rows.select(F.posexplode("factor_values").alias("at", "value"))
    sums = dict(each.groupBy("at").agg(F.sum(F.col("value").cast(_EXACT) if whole else F.col("value"))).collect())
    if whole:
        total = F.array(*[F.lit(int(sums[i])).cast(_EXACT) for i in range(d)])
        apart = F.zip_with("factor_values", total, lambda v, s: v.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") - s)
        squares = F.aggregate(apart, F.lit(0).cast(_EXACT), lambda a, v: (a + v * v).cast(_EXACT))
    else:
        total = F.array(*[F.lit(float(sums[i])) for i in range(d)])
        squares = F.aggregate(F.zip_with("factor_values", total, lambda v, s: v * n - s), F.lit(0.0), lambda a, v: a + v * v)
    mean = F.array(*[F.lit(float(sums[i] / n)) for i in range(d)])
    centred = F.zip_with(F.col("factor_values").cast("array<double>"), mean, lambda v, m: v - m)

    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    deep = max(1, BLOCK_BYTES // (8 * d))
    matrix = IndexedRowMatrix(vectors, n, d).toBlockMatrix(deep, min(d, BLOCK_COLS))
    parts = max(1, vectors.rdd.getNumPartitions())
    matrix.persist(StorageLevel.MEMORY_AND_DISK)  # both products and their block indices read it; lost blocks are made anew
    covariance = _product(matrix.transpose(), matrix, parts).toLocalMatrix().toArray() / n
    eigenvalues, eigenvectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-eigenvalues, kind="stable")[:components]
    order = order[eigenvalues[order] > NOTHING * max(eigenvalues[-1], 0.0)]
    if not len(order):
        return spark.createDataFrame([], made)
    chosen = eigenvectors[:, order]
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    whitening = chosen / np.sqrt(eigenvalues[order])
    k, wide = len(order), matrix.colsPerBlock
    blocks = [((i // wide, 0), Matrices.dense(len(part), k, part.ravel(order="F"))) for i in range(0, d, wide) for part in (whitening[i:i + wide],)]
    projected = _product(matrix, BlockMatrix(spark.sparkContext.parallelize(blocks, 1), wide, k, d, k), 1)
    scores = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model).select(
        "index", vector_to_array("vector").alias("scores"))
    done = materialise(rows.select("index", "security_code", squares.alias("deviation")).join(scores, "index").drop("index"))
    matrix._java_matrix_wrapper.call("blocks").unpersist(False)

    score = [F.col("scores")[i] for i in range(k)]
    middle = done.agg(*[F.avg(s) for s in score]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    entries = done.agg(*[F.avg((score[i] - F.lit(middle[i])) * (score[j] - F.lit(middle[j]))) for i, j in pairs]).first()
    error = max(abs(x - (i == j)) for x, (i, j) in zip(entries, pairs))
    shares = F.array(*[F.lit(float(e / np.trace(covariance))) for e in eigenvalues[order]])
    long = done.select("security_code", "deviation", F.posexplode("scores").alias("at", "whitened"))
    return long.select(
        "security_code", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
