"""K-means of many starts: draws, rounds and odd tables."""

import numpy as np
import pytest

from areastats.operators import kmeans


def table(spark, points):
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "a double, b double")


def test_fits_are_settled_and_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(90, 2)) + np.repeat([[0, 0], [6, 0], [0, 9]], 30, 0)
    points = np.vstack([points, points[:20]])
    fits = [kmeans.best_fits(df, ["a", "b"], [2, 3, 5], 4, 1, 100) for df in (table(spark, points), table(spark, points[::-1]).repartition(5))]
    for k in (2, 3, 5):
        fit = fits[0][k]
        assert fit.cost == pytest.approx(fits[1][k].cost)
        far = kmeans.squared(points, fit.centres)
        at = far.argmin(1)
        assert far.min(1).sum() == pytest.approx(fit.cost)
        assert fit.centres == pytest.approx(np.array([points[at == c].mean(0) for c in range(k)]))
    assert fits[0][3].cost < fits[0][2].cost / 2


def test_fewer_rows_than_clusters_and_missing_values(spark):
    fit = kmeans.best_fits(table(spark, [(1, 1), (1, 1), (2, 5)]), ["a", "b"], [4], 2, 1, 50)[4]
    assert fit.cost == 0 and {tuple(c) for c in fit.centres} == {(1.0, 1.0), (2.0, 5.0)}
    with pytest.raises(ValueError):
        kmeans.best_fits(table(spark, []), ["a"], [2], 1, 1, 5)
    with pytest.raises(Exception, match="missing value"):
        kmeans.best_fits(spark.createDataFrame([(1.0, None)], "a double, b double"), ["a", "b"], [2], 1, 1, 5)
