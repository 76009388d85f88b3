"""Least squares from one table of products, with a defined answer for collinear columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Eigenvalues of the scaled table below this share of the largest count as 0.
TOLERANCE = 1e-11


@dataclass(frozen=True)
class LinearFit:
    """Coefficients and intercept of a linear model."""

    coefficients: DenseVector
    intercept: float
    rank: int
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows of a table with a `prediction`."""
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients])
        products = F.zip_with(vector_to_array(self.features), weights, lambda x, c: x * c)
        return df.withColumn("prediction", F.aggregate(products, F.lit(float(self.intercept)), lambda s, p: s + p))


def products(rows: DataFrame, width: int, centre: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of columns, taken about `centre`: each task adds up its own rows, Spark the tasks' tables."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width) - centre
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select("z").mapInArrow(add_up, "i int, row array<double>")
    each = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in each.collect():
        out[r.i, r.j] = r.v
    return out


def least_squares(train: DataFrame, label: str, features: str, n_features: int, alpha: float = 0.0) -> LinearFit:
    """Minimise |y - b0 - Xb|^2 + alpha |b|^2; among equal minima (collinear columns, alpha 0) the b of least length.

    Two passes: means, then products about the means. Columns are scaled to the same spread before their rank is found, so
    that units do not matter for it; the length of b is measured in the columns as given.
    """
    rows = train.select(F.concat(vector_to_array(features), F.array(F.col(label).cast("double"))).alias("z"))
    width = n_features + 1
    means = rows.select(F.posexplode("z").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).orderBy("j").collect()
    centre = np.array([r.m for r in means])
    table = products(rows, width, centre)
    gram, target = table[:-1, :-1], table[:-1, -1]
    spread = np.sqrt(np.diag(gram))
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0.0)
    if alpha:
        rank = n_features
        b = scale_solve(gram, target, alpha, scale)
    else:
        values, vectors = np.linalg.eigh(gram * np.outer(scale, scale))
        full = values > TOLERANCE * max(values.max(initial=0.0), 1e-300)
        rank = int(full.sum())
        z = vectors[:, full] @ ((vectors[:, full].T @ (scale * target)) / values[full])
        b = scale * z
        free = np.where(scale > 0, scale, 1.0)[:, None] * vectors[:, ~full]
        if free.shape[1]:  # move along what does not change the fit to the shortest b
            b = b - free @ np.linalg.lstsq(free, b, rcond=None)[0]
    return LinearFit(Vectors.dense(b), float(centre[-1] - centre[:-1] @ b), rank, features)


def scale_solve(gram: np.ndarray, target: np.ndarray, alpha: float, scale: np.ndarray) -> np.ndarray:
    """(gram + alpha) b = target, solved in columns of equal spread."""
    d = np.where(scale > 0, scale, 1.0)
    return d * np.linalg.solve((gram + alpha * np.eye(len(gram))) * np.outer(d, d), d * target)
