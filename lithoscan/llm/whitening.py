"""Whitening of embeddings by the singular vectors of centred rows.

Vectors become whole numbers, and each different one counts once in the fit.
MLlib's ``computeSVD`` runs on the distributed, centred rows; a singular value
s belongs to the variance s²/n.  The total variance comes from exact integer
deviations, apart from the decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Singular values below this share of the largest are no variance but rounding.
LEAST_SHARE = 1e-7

EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with the ``sums`` of their entries, and the first
    components: one column of ``axes``, one variance each."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    #: Share of each component in the total variance, and the largest entry of
    #: the whitened fit's covariance less the identity.
    explained: tuple[float, ...]
    identity_error: float


def whole_vectors(df: DataFrame, vector_col: str = "embedding", scale: float = 256.0) -> tuple[DataFrame, int]:
    """The columns of ``df`` and ``_x``, the vector as floor(scale * entry); and its length.

    Rows go whose vector is null or empty, holds a null or a number that is not
    finite, or has another length than most (of equally many, than the longest)."""
    entries = F.col(vector_col).cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(entries.isNotNull() & (F.size(entries) > 0) & ~F.coalesce(bad, F.lit(True)))
    lengths = rows.groupBy(F.size(vector_col).alias("_d")).count().orderBy(F.desc("count"), F.desc("_d")).first()
    size = lengths["_d"] if lengths else 0
    whole = F.transform(entries, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    return rows.where(F.size(vector_col) == size).withColumn("_x", whole), size


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sums of (n x - S)² by row: in machine integers where they fit."""
    far = np.abs(n * x.astype(float) - sums.astype(float)).max(initial=0.0)
    if far * far * x.shape[1] < 2**62 and n * float(np.abs(x).max(initial=0)) < 2**62:
        apart = n * x - sums.astype(np.int64)
        return (apart * apart).sum(axis=1).tolist()
    return [sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]


def _project(n: int, sums: np.ndarray, axes: np.ndarray, variances: np.ndarray):
    """Batches with ``_x`` to the same without it, with the exact deviation (null
    beyond 38 digits) and the whitened coordinates."""
    size, scales = len(sums), np.sqrt(variances)
    mean = (sums / n).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            deviation = [d if d < 10**38 else None for d in _deviations(x, n, sums)]
            white = ((x - mean) @ axes / scales).ravel()
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype="<i4") * len(scales), pa.array(white))
            names = [c for c in batch.schema.names if c != "_x"]
            columns = [*map(batch.column, names), pa.array(deviation, EXACT), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "deviation", "whitened"])

    return run


def _projected(rows: DataFrame, *fit) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_x")
    told = ", ".join(filter(None, [kept, "deviation decimal(38,0), whitened array<double>"]))
    return rows.mapInArrow(_project(*fit), told)


def _double(value: int) -> Column:
    return F.lit(float(value))


def fit_whitening(vectors: DataFrame, most: int = 4) -> Whitening | None:
    """Fit on the different ``_x`` of ``vectors``; none where they do not vary.

    Only sums, the components and a few variances come to the driver: their size
    is that of one vector, or of its Gramian, whatever the number of rows."""
    spark = vectors.sparkSession
    fit = materialize(vectors.select("_x").distinct(), "vectors")
    each = F.posexplode(F.transform("_x", lambda c: c.cast("decimal(20,0)"))).alias("at", "c")
    sums = [int(r["s"]) for r in fit.select(each).groupBy("at").agg(F.sum("c").alias("s")).orderBy("at").collect()]
    n = fit.count()
    if n < 2:
        return None
    means = F.array(*map(_double, (s / n for s in sums)))
    centred = F.zip_with(F.col("_x").cast("array<double>"), means, lambda c, m: c - m)
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("v")), "v")
    # All singular values: then the Gramian is decomposed by LAPACK, to double precision.
    svd = RowMatrix(rows, n, len(sums)).computeSVD(len(sums), computeU=False, rCond=LEAST_SHARE)
    values, axes = svd.s.toArray(), svd.V.toArray()
    variances = values[:most] ** 2 / n
    if not len(variances) or variances[0] <= 0:
        return None
    axes, whole = axes[:, : len(variances)], np.array(sums, dtype=object)
    white = _projected(fit, n, whole, axes, variances)
    k = len(variances)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    spread = [F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]
    told = white.agg(F.sum("deviation").alias("total"), *spread).first()
    error = max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    total = int(told["total"]) / n**3
    return Whitening(n, tuple(sums), axes, variances, tuple(float(v / total) for v in variances), error)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, most: int = 4) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: one row
    for each vector and component, numbered from 1 by falling variance.

    ``deviation`` is the exact sum of (n x - S)², decimal(38,0).  Vectors that can't be
    used are left out (:func:`whole_vectors`), null ids are kept, repeated rows are
    repeated, and count once in the fit.  There are as many components as the
    fit has variances over zero, ``most`` at the most: none for an empty table
    or where all vectors are alike, and then no rows.  Other columns are not
    carried."""
    rows, _ = whole_vectors(df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")), "_v", scale)
    rows = rows.select("_id", "_x")
    fit = fit_whitening(rows, most)
    if fit is None:
        kinds = dict(component="int", n="long", deviation="decimal(38,0)", whitened="double", explained="double", identity_error="double")
        return rows.limit(0).select(F.col("_id").alias(id_col), *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])
    found = _projected(rows, fit.n, np.array(fit.sums, dtype=object), fit.axes, fit.variances)
    explained = F.array(*map(F.lit, fit.explained))
    return found.select("_id", "deviation", F.posexplode("whitened").alias("_i", "whitened")).select(
        F.col("_id").alias(id_col), (F.col("_i") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
        "whitened", explained[F.col("_i")].alias("explained"), F.lit(fit.identity_error).alias("identity_error"),
    )
