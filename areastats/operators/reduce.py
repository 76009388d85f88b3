"""Principal components and clusters."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce as fold
from operator import add

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areastats.operators.features import assemble, minmax_scaling, standard_scaling
from areastats.operators.kmeans import KMeansFit, best_fits
from areastats.operators.stats import group_means, value_counts

# -- principal components -----------------------------------------------------


@dataclass(frozen=True)
class Components:
    """Principal axes of standardised columns."""

    cols: tuple[str, ...]
    model: PCAModel
    signs: tuple[float, ...]
    scaled: DataFrame

    @property
    def spark(self):
        return self.scaled.sparkSession

    def _axes(self):
        pc = self.model.pc.toArray()
        return [(k, [float(v) * self.signs[k] for v in pc[:, k]]) for k in range(pc.shape[1])]

    def variance(self) -> DataFrame:
        """Share of the variance each axis explains."""
        rows = [(k + 1, float(v)) for k, v in enumerate(self.model.explainedVariance.toArray())]
        return self.spark.createDataFrame(rows, "axis int, explained double")

    def loadings(self) -> DataFrame:
        """Weight of each column on each axis."""
        rows = [(c, k + 1, v) for k, axis in self._axes() for c, v in zip(self.cols, axis)]
        return self.spark.createDataFrame(rows, "metric string, axis int, loading double")

    def circle(self) -> DataFrame:
        """Correlation of each column with each axis: loading times root of the eigenvalue.

        The columns are standardised, so the eigenvalues add up to their number.
        """
        roots = [
            (k + 1, float(max(v, 0.0) * len(self.cols)) ** 0.5)
            for k, v in enumerate(self.model.explainedVariance.toArray())
        ]
        root = self.spark.createDataFrame(roots, "axis int, root double")
        return self.loadings().join(root, "axis").select(
            "metric", "axis", (F.col("loading") * F.col("root")).alias("correlation")
        )

    def scores(self, ids: Sequence[str]) -> DataFrame:
        """Coordinates of each row on the axes: ids, axis_1, axis_2, ..."""
        out = self.model.transform(assemble(self.scaled, self.cols))
        values = vector_to_array("scores")
        return out.select(
            *ids, *[(values[k] * F.lit(s)).alias(f"axis_{k + 1}") for k, s in enumerate(self.signs)]
        )


def principal_components(df: DataFrame, cols: Sequence[str], k: int | None = None) -> Components:
    """Fit principal components on the standardised columns.

    The direction of an axis is arbitrary; here the first of its largest loadings is positive.
    """
    scaled = standard_scaling(df, cols).apply(df)
    model = PCA(k=k or len(cols), inputCol="features", outputCol="scores").fit(assemble(scaled, cols))
    signs = []
    for axis in model.pc.toArray().T:
        top = max(abs(v) for v in axis)
        leading = next(v for v in axis if abs(v) >= top * (1 - 1e-9))
        signs.append(1.0 if leading > 0 else -1.0)
    return Components(tuple(cols), model, tuple(signs), scaled)


# -- clusters -----------------------------------------------------------------


def _distance(cols: Sequence[str], centre: Sequence[float]) -> Column:
    return F.sqrt(fold(add, [F.pow(F.col(c) - F.lit(float(v)), F.lit(2)) for c, v in zip(cols, centre)]))


def assign_centres(
    df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]], into: str = "cluster"
) -> DataFrame:
    """Add the number of the nearest centre (the lower one if two are equally near) and its distance."""
    distances = F.array(*[_distance(cols, c) for c in centres])
    return (
        df.withColumn("_d", distances)
        .withColumn("distance", F.array_min("_d"))
        .withColumn(into, (F.array_position("_d", F.array_min("_d")) - 1).cast("int"))
        .drop("_d")
    )


def distortion(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """Mean distance of the rows to their nearest centre."""
    return assign_centres(df, cols, centres).agg(F.avg("distance").alias("distortion"))


def _best_fits(df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int, seed: int, max_iter: int) -> dict[int, KMeansFit]:
    """For each k the best of `n_init` starts. One that still moved after `max_iter` rounds is reported as a warning."""
    best = best_fits(df, cols, ks, n_init, seed, max_iter)
    for k, fit in best.items():
        if fit.rounds >= max_iter:
            warnings.warn(f"{k} clusters: still moving after {max_iter} rounds", stacklevel=3)
    return best


def fit_clusters(
    df: DataFrame, cols: Sequence[str], k: int = 4, n_init: int = 10, seed: int = 42, max_iter: int = 300
) -> KMeansFit:
    """K-means: the best of `n_init` starts, by total squared distance."""
    return _best_fits(df, cols, [k], n_init, seed, max_iter)[k]


def sorted_centres(model: KMeansFit) -> list[list[float]]:
    """Cluster centres in ascending order, so that numbering does not depend on the start."""
    return sorted([float(v) for v in c] for c in model.clusterCenters())


def elbow(
    df: DataFrame,
    cols: Sequence[str],
    ks: Sequence[int] = (2, 3, 4, 5, 6),
    n_init: int = 10,
    seed: int = 42,
    max_iter: int = 300,
) -> DataFrame:
    """Mean distance to the nearest centre for each number of clusters, in one pass over the rows."""
    models = _best_fits(df, cols, ks, n_init, seed, max_iter)
    centres = {k: sorted_centres(m) for k, m in models.items()}
    row = df.agg(*[F.avg(F.least(*[_distance(cols, c) for c in centres[k]])).alias(str(k)) for k in ks])
    return row.unpivot([], [str(k) for k in ks], "k", "distortion").withColumn("k", F.col("k").cast("int"))


@dataclass(frozen=True)
class Clusters:
    """Rows with their cluster, and what describes the clusters."""

    labelled: DataFrame
    cols: tuple[str, ...]
    centres: list[list[float]]

    def labels(self, key: str) -> DataFrame:
        return self.labelled.select(key, "cluster").orderBy(key)

    def sizes(self) -> DataFrame:
        return value_counts(self.labelled, "cluster")

    def profile(self) -> DataFrame:
        return group_means(self.labelled, ["cluster"], list(self.cols))


def cluster_rows(
    df: DataFrame, cols: Sequence[str], k: int = 4, n_init: int = 10, seed: int = 42, scale: bool = False
) -> Clusters:
    """Cluster rows and label them, numbering clusters by ascending centre.

    The columns are used as they are unless `scale` brings them to 0..1 first.
    """
    data = minmax_scaling(df, cols).apply(df, "_scaled") if scale else df
    used = [f"{c}_scaled" for c in cols] if scale else list(cols)
    centres = sorted_centres(fit_clusters(data, used, k, n_init, seed))
    labelled = assign_centres(data, used, centres)
    return Clusters(labelled.drop(*(used if scale else [])), tuple(cols), centres)
