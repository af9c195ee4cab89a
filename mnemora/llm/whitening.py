"""Embedding whitening: principal components of scaled integer embeddings, each brought to variance one.

Entries become integers, so sums are exact, and each row less the mean is exact before it becomes a double:
(n * x - S) / n has one rounding. The Gramian of these rows is MLlib's, over a RowMatrix; divided by n it is the covariance.
Its eigenvectors are found on the driver, where a matrix of the vectors' length squared is all that is held, and the
matrix that whitens is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sheltered, written

#: An entry is floor(SCALE * c) + SHIFT; entries further from zero than MOST, before the shift, count as MOST.
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 40
COMPONENTS = 32


def covariance(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The Gramian of rows that are centred, divided by n, as a symmetric matrix; rows: column array<double>."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def whitening_matrix(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions over the roots of their eigenvalues, as columns; eigenvalues) of the largest eigenvalues, falling.

    A direction without variance (an eigenvalue within rounding of zero) can't be brought to one: its column is zero.
    """
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    real = e > max(e[0], 0.0) * len(v) * np.finfo(float).eps if len(e) else np.zeros(0, bool)
    return np.where(real, u / np.sqrt(np.where(real, e, 1.0)), 0.0), np.where(real, e, 0.0)


def _whole(x: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, without the shift, which changes neither differences nor deviations."""
    return F.transform(x, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long"))


def _centred(rows: DataFrame, n: int, sums: list[int], most: int, kind: str) -> DataFrame:
    """(id, deviation, centred): sum of (n * x - S) ** 2, and (n * x - S) / n, from (id, whole)."""
    wide = n * most * 2 >= 2**62 or len(sums) * (2 * n * most) ** 2 >= 2**62  # then Python's integers, which have no bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, object if wide else np.int64)
        for b in batches:
            x = b["whole"].flatten().to_numpy().reshape(b.num_rows, len(sums))
            d = n * x.astype(object if wide else np.int64) - s
            deviation = [str(k) for k in (d * d).sum(axis=1)]
            flat = pa.array((d / n).astype(np.float64).ravel())
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(sums))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(deviation, pa.string()), pa.ListArray.from_arrays(offsets, flat)], ["id", "deviation", "centred"])

    return rows.select("id", "whole").mapInArrow(run, f"id {kind}, deviation string, centred array<double>")


def _projected(rows: DataFrame, w: np.ndarray, kind: str) -> DataFrame:
    """(id, deviation, whitened): the rows of `_centred` times the matrix, which is broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(w))  # length x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            z = b["centred"].flatten().to_numpy().reshape(b.num_rows, w.shape[0]) @ w
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([b["id"], b["deviation"], pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], ["id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"id {kind}, deviation string, whitened array<double>")


def _identity_error(rows: DataFrame, n: int, width: int) -> float:
    """The largest absolute entry of the covariance of `whitened` less the identity, measured on the rows."""
    means = {r.i: r.m for r in rows.select(F.posexplode("whitened").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()}
    mean = F.array(*[F.lit(means[i]) for i in range(width)])
    again = rows.select(F.zip_with("whitened", mean, lambda x, m: x - m).alias("x"))
    return float(np.abs(covariance(again, "x", n) - np.eye(width)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n, length, deviation decimal(38,0), whitened, explained: array<double>, identity_error) of every vector
    without null, infinite or NaN entries; those with one, and null vectors, take no part.

    An entry c counts as floor(scale * c), held within 2**40 of zero. n: the vectors; deviation: the sum of
    (n * x - S)**2 over the entries, exact (null beyond 38 digits). whitened: x less the mean on the unit eigenvectors of the covariance, by falling
    eigenvalue, `components` at most, each over the root of its eigenvalue; explained: eigenvalue over the sum of all.
    identity_error: the largest entry of the covariance of whitened less the identity, measured.

    Vectors of different lengths are spaces of their own, each fitted to itself (a few jobs for each length). A direction
    without variance, as where all vectors are equal, there is one, or there are fewer than entries, has whitened and explained 0, and
    counts as an error of 1. Null and repeated ids are rows like others; empty vectors have empty arrays and an error
    of 0; an empty table gives an empty table; other columns are not read. Nothing but sums and matrices of a vector's length reaches the driver.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    d, (i, v) = sheltered(vectors, id_col, vector_col)
    x = F.col(v).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = written(d.where(F.col(v).isNotNull() & ~bad).select(F.col(i).alias("id"), _whole(x, scale).alias("whole")), "whiten-rows")
    lengths = {r.length: r.n for r in rows.groupBy(F.size("whole").alias("length")).agg(F.count("*").alias("n")).collect()}

    schema = f"id {kind}, deviation string, whitened array<double>"
    out = _shown(vectors.sparkSession.createDataFrame([], schema), 0, 0, [], 0.0, id_col)
    for length, n in sorted(lengths.items()):
        own = rows.where(F.size("whole") == length)
        if not length:
            out = out.unionByName(_shown(own.select("id", F.lit("0").alias("deviation"), F.array().cast("array<double>").alias("whitened")), n, 0, [], 0.0, id_col))
            continue
        summed = own.select(F.posexplode("whole").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.max(F.abs("x")).alias("most")).orderBy("i").collect()
        centred = written(_centred(own, n, [int(r.s) for r in summed], max(r.most for r in summed), kind), "whiten-centred")
        v_ = covariance(centred, "centred", n)
        w, e = whitening_matrix(v_, components)
        done = written(_projected(centred, w, kind), "whitened")
        share = (e / np.trace(v_) if np.trace(v_) > 0 else e).tolist()
        out = out.unionByName(_shown(done, n, length, share, _identity_error(done, n, len(e)), id_col))
    return out


def _shown(rows: DataFrame, n: int, length: int, explained: list[float], error: float, id_col: str) -> DataFrame:
    share = F.array(*map(F.lit, explained)).cast("array<double>")
    return rows.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), F.lit(length).alias("length"), F.try_to_number("deviation", F.lit("9" * 38)).alias("deviation"), "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
