"""Departments by pay level: bands, principal components, clusters, map layer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from areastats.operators import bands, geo, reduce
from areastats.sources import materialise


@dataclass(frozen=True)
class DepartmentReport:
    """The parts of the report; the department table is written once and shared by all."""

    profile: DataFrame
    components: reduce.Components
    elbow: DataFrame
    clusters: reduce.Clusters

    def map(self, features: DataFrame, key: str, recodes: Mapping | None = None) -> DataFrame:
        return geo.map_layer(features, self.clusters.labelled.select(key, "cluster"), key, recodes)


def department_profile(areas: DataFrame, dep: str, cols: Sequence[str]) -> DataFrame:
    """Mean band number per department, over areas that have all columns; written once."""
    return materialise(bands.band_profile(bands.quantile_bands(areas, cols), dep, cols), "band-profile")


def department_report(
    banded: DataFrame,
    dep: str,
    cols: Sequence[str],
    k: int = 4,
    ks: Sequence[int] = (2, 3, 4, 5, 6),
    n_init: int = 10,
    seed: int = 42,
) -> DepartmentReport:
    """Run the report on one row per area with its bands (see `bands.quantile_bands`)."""
    profile = materialise(bands.band_profile(banded, dep, cols), "band-profile")
    return DepartmentReport(
        profile,
        reduce.principal_components(profile, cols),
        reduce.elbow(profile, cols, ks, n_init, seed),
        reduce.cluster_rows(profile, cols, k, n_init, seed),
    )
