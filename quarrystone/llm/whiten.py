"""Embedding whitening: singular value decomposition of centred distributed rows.

Entries become whole numbers on a fixed grid, so sums, and deviations from the mean, are exact whatever the order of
addition. Rows, centred, are a distributed row matrix of Spark's MLlib, whose computeSVD sums the Gram matrix on the
executors; singular values over n are the covariance's eigenvalues. The total variance comes from the exact deviations,
apart from the decomposition. Per row the driver holds nothing; per dimension it holds sums and one matrix.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; so are empty vectors, which
have no components. Vectors of different length cannot share a covariance: each length is fitted on its own, with its
own n. Directions without variance (up to 1e-12 of the largest eigenvalue, where rounding is all there is) cannot be
whitened and give no rows, so one row alone, or equal rows, give none. Repeated rows count each for itself; a null
vec_id stays null; an empty table gives no rows. A deviation that no long can hold is null. Where n times the largest grid
number has more than 62 bits the job fails, as no long could hold the deviations' parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 8
#: Grid: floor(STEPS * entry) + SHIFT.
STEPS, SHIFT = 1024, 100_000
#: Eigenvalues up to this share of the largest are rounding.
NO_VARIANCE = 1e-12
LARGEST = 2**62


def on_grid(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, x array<bigint> of the rows that remain."""
    entry = F.col("embedding").cast("array<double>")
    sound = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False)) & (F.size("embedding") > 0))
    step = lambda c: F.when(F.abs(c) < LARGEST / STEPS / 2, F.floor(c * STEPS) + SHIFT).otherwise(F.raise_error(F.lit("an entry lies outside the grid")).cast("bigint"))
    return rows.select(F.col("vec_id").cast("long"), F.transform(entry, step).alias("x"))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(dim, place, total, largest, n): partial sums of a task."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, part in batch.groupby(batch["x"].map(len)):
            x, total = np.stack(part["x"].to_numpy()), held.setdefault(int(dim), [0, 0, 0])
            total[:] = total[0] + x.sum(axis=0, dtype=np.int64), np.maximum(total[1], np.abs(x).max(axis=0)), total[2] + len(x)
    for dim, (total, largest, n) in held.items():
        yield pd.DataFrame({"dim": np.int32(dim), "place": np.arange(dim, dtype=np.int32), "total": total, "largest": largest, "n": np.int64(n)})


def squared(d: np.ndarray) -> list[int]:
    """The sum of squares of each row of whole numbers, exact: in limbs of 21 bits, as squares of large ones leave 64 bits."""
    size = np.abs(d)
    if size.max(initial=0) < 2**21:
        return (size * size).sum(axis=1).tolist()
    low, mid, high = size & 0x1FFFFF, size >> 21 & 0x1FFFFF, size >> 42
    shares = [low * low, 2 * low * mid, 2 * low * high + mid * mid, 2 * mid * high, high * high]
    return [sum(int(s) << 21 * k for k, s in enumerate(row)) for row in zip(*[s.sum(axis=1).tolist() for s in shares], strict=True)]


def _projected(total: np.ndarray, n: int, directions: np.ndarray):
    """(vec_id, deviation, high, low, z0 ...): deviations exact, and rows on the given directions, already scaled."""
    k = directions.shape[1]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = n * np.stack(batch["x"].to_numpy()) - total
            sums = squared(d)
            z = (d / n) @ directions
            out = {"vec_id": batch["vec_id"].astype("Int64"), "deviation": pd.array([s if s < 2**63 else None for s in sums], dtype="Int64")}
            out |= {"high": [s >> 62 for s in sums], "low": [s & 2**62 - 1 for s in sums]}
            yield pd.DataFrame(out | {f"z{j}": z[:, j] for j in range(k)})

    return project


def _fitted(rows: DataFrame, dim: int, total: np.ndarray, n: int, components: int) -> DataFrame | None:
    spark, rows = rows.sparkSession, rows.where(F.size("x") == dim)
    sums = F.array(*[F.lit(int(t)) for t in total])
    centred = F.transform(F.zip_with("x", sums, lambda x, s: x * F.lit(n) - s), lambda d: d.cast("double") / F.lit(float(n)))
    frame = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row")
    # All directions, though few are asked for: only then is the decomposition a direct one, to double precision.
    svd = RowMatrix(frame, n, dim).computeSVD(dim, computeU=False)
    values = svd.s.toArray() ** 2 / n
    kept = int((values > NO_VARIANCE * values.max(initial=0)).sum())
    k = min(components, kept)
    if not k:
        return None
    values, directions = values[:k], svd.V.toArray()[:, :k] / np.sqrt(values[:k])
    z = [f"z{j}" for j in range(k)]
    fields = ", ".join(["vec_id long, deviation long, high long, low long", *(f"{c} double" for c in z)])
    wide = written(rows.mapInPandas(_projected(total, n, directions), fields))
    moments = wide.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")], *[F.avg(c).alias(c) for c in z]).first()
    variance = float((int(moments["high"]) << 62) + int(moments["low"])) / float(n) ** 3
    apart = [F.col(c) - F.lit(moments[c]) for c in z]
    products = wide.agg(*[(F.sum(apart[i] * apart[j]) / n).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    error = max(abs(products[f"p{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))
    told = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col(c).alias("whitened"), F.lit(float(values[j] / variance)).alias("explained")) for j, c in enumerate(z)])
    out = wide.select("vec_id", "deviation", F.explode(told).alias("c"))
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = written(on_grid(vectors))
    summed = rows.select("x").mapInPandas(_sums, "dim int, place int, total long, largest long, n long").groupBy("dim", "place")
    held = summed.agg(F.sum("total").alias("total"), F.max("largest").alias("largest"), F.sum("n").alias("n")).toPandas()  # a row for each dimension of a vector
    if any(int(a) * int(b) >= LARGEST for a, b in zip(held["largest"], held["n"], strict=True)):
        raise ValueError("entries are too large for so many rows")
    fits = [_fitted(rows, int(dim), part.sort_values("place")["total"].to_numpy(), int(part["n"].iloc[0]), components) for dim, part in held.groupby("dim")]
    fits = [f for f in fits if f is not None]
    if not fits:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, fits)
