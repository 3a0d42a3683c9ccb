"""Whitening of vectors by the singular value decomposition of the centred rows.

Entries become whole numbers, so sums, means and deviations are exact. MLlib's ``RowMatrix.computeSVD`` of the centred
rows gives the components: its right singular vectors are the eigenvectors of the covariance, a squared singular value
over the number of rows is an eigenvalue (divisor n). The total variance does not come from the decomposition but from the
exact deviations of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Whole steps that a unit is cut into, and what is added to them.
STEPS, SHIFT = 1024, 100_000
#: Entries of this size or more cannot be counted in whole numbers; their vectors count as not finite.
HUGE = float(1 << 36)
#: A direction with this share of the largest variance or less is rounding: none.
NO_VARIANCE = 1e-10


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that can be used."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("v is not null and size(v) > 0").where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < HUGE), F.lit(False))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * STEPS) + SHIFT).alias("x"))


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(n, S): number of rows and exact sums by dimension. Tasks add up batches; Spark adds up a row for each batch and
    dimension, as decimals."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "x")  # below 2^51 each, and a batch has some thousand rows
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["n", "s"])

    some = rows.select("x").mapInArrow(added, "n long, s array<long>")
    made = some.select("n", F.posexplode("s").alias("dim", "s")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (int(made[0]["n"]) if made else 0), np.array([int(r["s"]) for r in made], object)


def components(rows: DataFrame, n: int, total: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the covariance, by falling eigenvalue: ``most`` at the most, none of
    variance 0."""
    minus = F.array(*[F.lit(str(-s)).cast("decimal(38,0)") for s in total])
    times = F.lit(str(n)).cast("decimal(18,0)")
    exact = F.zip_with("x", minus, lambda x, s: (x.cast("decimal(18,0)") * times + s).cast("double") / n)
    centred = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(exact).alias("v")), "v")
    # all singular values: the decomposition is LAPACK's of the Gramian then, not an iteration that stops at a tolerance
    svd = RowMatrix(centred, n, len(total)).computeSVD(len(total), computeU=False, rCond=1e-12)
    e = svd.s.toArray() ** 2 / n
    u = svd.V.toArray().T
    some = e > NO_VARIANCE * e.max(initial=0.0)
    return e[some][:most], u[some][:most]


def whiten(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    An entry c becomes x = floor(1024 c) + 100000. ``n`` rows with sums S are fitted, all of them. ``component`` counts
    the unit eigenvectors of x's covariance (divisor n) from 1 by falling eigenvalue e, ``most`` of them at the most;
    ``deviation`` is the exact sum of (n x - S)^2 over the dimensions, ``whitened`` is (x - S / n) projected on the component,
    over sqrt(e), ``explained`` is e / trace. ``identity_error`` is the largest absolute entry of the whitened columns'
    covariance minus the identity: a check, the same in all rows.

    Vectors that are null, empty, or hold null, non-finite or huge (2^36 or more) entries give no rows, nor do those that
    have not the length of most (ties: the greater length). Directions without variance (10^-10 of the largest or less) are no components, so equal vectors, a single vector and an
    empty table give no rows. Among equal eigenvalues any basis may come. A deviation over 2^63 is null. Rows that repeat
    are fitted and returned as often as they stand, null ids too. Other columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vec_col)
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("x") == (usual["size"] if usual else 0))
    n, total = sums(rows)
    e, u = components(rows, n, total, most) if n else (np.zeros(0), np.zeros((0, 0)))
    if not len(e):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most_seen = max(abs(s) for s in total)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "x")
            fits = max(most_seen, n * int(np.abs(x).max())) < 1 << 62
            off = n * x - total.astype(np.int64) if fits else n * x.astype(object) - total
            big = off.dtype == object or np.abs(off).max() >= 1 << 28  # squares of 2^56 fit in up to 64 dimensions
            square = ((off.astype(object) ** 2).sum(axis=1)) if big or off.shape[1] > 64 else (off**2).sum(axis=1)
            white = off.astype(float) / n @ u.T / np.sqrt(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("vec_id")), pa.array([str(d) for d in square.tolist()]), pa.array(white.tolist(), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "w"],
            )

    made = materialize(rows.mapInArrow(projected, "vec_id long, deviation string, w array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)")))
    k = len(e)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    # Spark's covariance adds up centred moments
    stats = made.agg(F.sum("deviation").alias("total"), *[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    trace = float(stats["total"]) / float(n) ** 3
    error = max(abs(stats[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*[F.lit(float(v) / trace) for v in e])
    each = made.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))
