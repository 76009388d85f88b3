"""The whole report: every table of its six sections, from the cleaned sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.operators import bands, cleaning, geo, models, stats
from areastats.operators.models import ModelSpec
from areastats.plans import clusters, leaderboard
from areastats.plans.profile import (
    ProfileRules,
    build_profile,
    clean_population,
    clean_regions,
    collapse_profile,
)
from areastats.sources import materialise, write_table


@dataclass(frozen=True)
class ReportColumns:
    """Which columns of the profile play which part."""

    classes: Mapping[object, str]
    total_rate: str
    category_rates: Sequence[str]
    class_rates: tuple[str, str]
    band_rates: Sequence[str]
    box_groups: Sequence[Sequence[str]]
    gap_rates: tuple[str, str]
    sizes: Sequence[str]
    large: str
    total: str = "firms"
    rate_limits: Mapping[str, float] = field(default_factory=dict)
    band_pairs: Sequence[tuple[str, str]] = ()

    @property
    def numeric(self) -> list[str]:
        return ["pop", *self.band_rates, *self.sizes, self.total]


@dataclass(frozen=True)
class Prepared:
    """Cleaned population, profile per area and class, and profile per area, each written once."""

    population: DataFrame
    profile: DataFrame
    simple: DataFrame


def prepare(
    population: DataFrame,
    geography: DataFrame,
    establishments: DataFrame,
    wages: DataFrame,
    rules: ProfileRules,
) -> Prepared:
    profile = materialise(build_profile(population, geography, establishments, wages, rules), "profile")
    people = clean_population(population, clean_regions(establishments, rules), rules)
    return Prepared(
        materialise(people, "population"), profile, materialise(collapse_profile(profile, rules), "profile-simple")
    )


def map_section(p: Prepared, cols: ReportColumns) -> dict[str, DataFrame]:
    """Points per firm size in web-map coordinates."""
    placed = cleaning.drop_null(p.profile, ["latitude", "longitude"])
    points = geo.to_mercator(placed, "longitude", "latitude")
    return {"size_layers": geo.size_layers(points, cols.sizes, ["area", "class", "x", "y"])}


def population_section(p: Prepared, cols: ReportColumns) -> dict[str, DataFrame]:
    """Class totals and shares, in the cleaned source and in the profile."""
    versions = {"source": p.population, "profile": p.profile}
    sums = {"total": ("pop", None)} | {f"total_{n}": ("pop", F.col("class") == F.lit(k)) for k, n in cols.classes.items()}
    out = {"population_shares": stats.compare_versions(versions, "reg", "class", "pop", cols.classes)}
    totals, means = None, None
    for name, frame in versions.items():
        row = stats.scalar_sums(frame, sums).withColumn("version", F.lit(name))
        mean = stats.mean_of_shares(frame, "reg", "class", "pop", cols.classes).withColumn("version", F.lit(name))
        totals = row if totals is None else totals.unionByName(row)
        means = mean if means is None else means.unionByName(mean)
        out[f"class_share_{name}"] = stats.class_share(frame, "reg", "class", "pop", cols.classes)
    return out | {"population_totals": totals, "mean_shares": means}


def firms_section(p: Prepared, cols: ReportColumns) -> dict[str, DataFrame]:
    """Firms by region, share of the large ones, and how these go with population."""
    groups = materialise(stats.group_sums(p.simple, ["reg_name"], ["pop", cols.total, cols.large]), "regions")
    large = stats.group_share(groups, "reg_name", cols.large, total=cols.large, share="share_pct")
    return {
        "firms_by_region": stats.sort_rows(groups.select("reg_name", cols.total), cols.total, ties=["reg_name"]),
        "large_firms": stats.sort_rows(large, "share_pct", ties=["reg_name"]),
        "firms_large_correlation": stats.correlation_test(groups, cols.large, cols.total),
        "firms_large_rank_paired": stats.rank_paired_correlation(
            groups.select("reg_name", cols.total), cols.total, groups.select("reg_name", cols.large), cols.large
        ),
        "firms_population_correlation": stats.correlation_test(groups, "pop", cols.total),
    }


def within_limits(simple: DataFrame, cols: ReportColumns) -> DataFrame:
    """Areas without an implausible rate."""
    for c, limit in cols.rate_limits.items():
        simple = cleaning.drop_where(simple, F.col(c) >= limit)
    return simple


def wages_section(p: Prepared, cols: ReportColumns) -> dict[str, DataFrame]:
    """Regional means, spread, and the gap between the classes."""
    plausible = within_limits(p.simple, cols)
    means = stats.group_means(p.simple, ["reg_name"], list(cols.category_rates))
    total = stats.group_means(plausible, ["reg_name"], [cols.total_rate])
    out = {
        "category_means": stats.sort_rows(means, cols.category_rates[0], ascending=False, ties=["reg_name"]),
        "region_means": stats.sort_rows(total, cols.total_rate, ties=["reg_name"]),
        "total_box": stats.box_stats(p.profile, [cols.total_rate]),
        "class_gap": stats.sort_rows(stats.gap_by_group(plausible, "reg_name", *cols.class_rates), "gap_pct", ties=["reg_name"]),
    }
    for i, group in enumerate(cols.box_groups, 1):
        out[f"box_{i}"] = stats.box_stats(plausible, list(group))
    return out


def unmatched_bands(banded: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """Per pair of columns the rows that have a band in one of the two only, in one pass.

    Both bands stand in the same row, so no join is needed: pair, keys..., metric, band, presence.
    """
    if not pairs:
        raise ValueError("state the pairs of columns to compare")
    sides = F.array(
        *[
            F.struct(
                F.lit(f"{x}/{y}").alias("pair"),
                F.when(F.col(f"{y}_band").isNull(), F.lit(x)).otherwise(F.lit(y)).alias("metric"),
                F.coalesce(f"{x}_band", f"{y}_band").alias("band"),
                F.when(F.col(f"{y}_band").isNull(), "left_only").otherwise("right_only").alias("presence"),
                (F.col(f"{x}_band").isNull() != F.col(f"{y}_band").isNull()).alias("alone"),
            )
            for x, y in pairs
        ]
    )
    listed = banded.select(*keys, F.explode(sides).alias("side"))
    return listed.where("side.alone").select("side.pair", *keys, "side.metric", "side.band", "side.presence")


def band_section(
    p: Prepared,
    cols: ReportColumns,
    features: DataFrame | None = None,
    k: int = 4,
    n_init: int = 10,
    recodes: Mapping | None = None,
) -> dict[str, DataFrame]:
    """Quartile bands, components and clusters of the departments, and the map layer."""
    rates = list(cols.band_rates)
    areas = within_limits(p.simple, cols)
    labels = [f"{c}_band" for c in rates]
    ids = ["area", "dep", "reg", "reg_name"]
    # Everything below works on the labels, so the cut points are found once.
    banded = materialise(bands.quantile_bands(areas, rates).select(*ids, *labels), "bands")
    complete = bands.complete_bands(banded, rates)
    report = clusters.department_report(banded, "dep", rates, k=k, n_init=n_init)
    out = {
        "quartiles": bands.quantile_table(areas, rates),
        "bands": complete,
        "bands_described": stats.describe_categories(complete, labels),
        "bands_unmatched": unmatched_bands(banded, cols.band_pairs, ["area", "dep", "reg_name"]),
        "band_gap": stats.sort_rows(bands.band_gap(areas, "reg_name", *cols.gap_rates), "gap_pct", ties=["reg_name"]),
        "department_profile": report.profile,
        "explained_variance": report.components.variance(),
        "loadings": report.components.loadings(),
        "circle": report.components.circle(),
        "scores": report.components.scores(["dep"]),
        "elbow": report.elbow,
        "clusters": report.clusters.labels("dep"),
        "cluster_sizes": report.clusters.sizes(),
        "cluster_profile": report.clusters.profile(),
    }
    if features is not None:
        out["map_layer"] = report.map(features, "dep", recodes)
    return out


def model_section(
    p: Prepared,
    cols: ReportColumns,
    numeric_specs: Sequence[ModelSpec] = leaderboard.NUMERIC_MODELS,
    one_hot_specs: Sequence[ModelSpec] = leaderboard.ONE_HOT_MODELS,
    unknown: str = "error",
) -> dict[str, DataFrame]:
    """Leader-board over both feature sets, coefficients and importances of each model."""
    key, cats = ["area", "class"], ["class", "reg", "dep"]
    rows = leaderboard.prepare(p.profile, key, cols.total_rate, cols.numeric, cats)
    variants = {
        "numeric": leaderboard.fit_variant(rows, key, cols.total_rate, cols.numeric, (), numeric_specs),
        "one_hot": leaderboard.fit_variant(rows, key, cols.total_rate, cols.numeric, cats, one_hot_specs, unknown=unknown),
    }
    out, predictions = {}, None
    for name, variant in variants.items():
        part = variant.predictions.withColumn("variant", F.lit(name))
        predictions = part if predictions is None else predictions.unionByName(part)
        for model, fitted in variant.models.items():
            if isinstance(fitted, models.GrownTrees):
                table = models.importances(fitted, variant.feature_names[model])
                out[f"importance_{name}_{model}"] = stats.top_k(table, "importance", 20, ties=["feature"])
            else:
                table = models.coefficients(fitted, variant.feature_names[model], rows.sparkSession)
                out[f"coefficients_{name}_{model}"] = stats.top_k(table, "magnitude", 20, ties=["feature"])
    predictions = materialise(predictions, "predictions")
    return out | {"predictions": predictions, "leader_board": models.leader_board(predictions, ["variant", "model"])}


def write_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write every table of a section to its own sub-folder."""
    for name, table in tables.items():
        write_table(table, f"{folder.rstrip('/')}/{name}", fmt)
