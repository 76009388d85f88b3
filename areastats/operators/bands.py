"""Quantile bands: cut a column at its quartiles and work with the labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areastats.operators.cleaning import recode, with_constants
from areastats.operators.quantiles import exact_quantiles, quantile_name
from areastats.operators.stats import gap_by_group, group_means, transpose

QUARTILES = (0.25, 0.5, 0.75)


def band_labels(n_cuts: int) -> list[str]:
    return [f"Q{i}" for i in range(1, n_cuts + 2)]


def band_numbers(n_cuts: int = 3) -> dict[str, int]:
    """Band label to its number: Q1 is 1."""
    return {label: i for i, label in enumerate(band_labels(n_cuts), 1)}


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES, exact: bool = True) -> Column:
    """All cut points of all columns as one struct, read with [column][quantile name].

    A scalar subquery: it is computed once and put into the plan as a constant.
    """
    table = exact_quantiles(df, cols, probs, exact=exact)
    names = [quantile_name(p) for p in probs]
    cells = [
        F.struct(*[F.max(F.when(F.col("metric") == c, F.col(q))).alias(q) for q in names]).alias(c) for c in cols
    ]
    return table.agg(F.struct(*cells).alias("cuts")).scalar()


def quantile_table(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES, across: bool = False
) -> DataFrame:
    """Cut points per column; `across` puts the columns side by side, one row per quantile."""
    names = [quantile_name(p) for p in probs]
    table = exact_quantiles(df, cols, probs).select("metric", *names)
    if not across:
        return table
    return transpose(table.withColumnRenamed("metric", "of"), "of", names, cols).withColumnRenamed(
        "metric", "quantile"
    )


def _band(value: Column, cuts: Sequence[Column]) -> Column:
    # The lowest band ends before its cut point, all others include theirs.
    labels = band_labels(len(cuts))
    expr = F.when(value < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        expr = expr.when(value <= cut, label)
    return expr.when(value > cuts[-1], labels[-1])


def quantile_bands(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    by: Sequence[str] = (),
    suffix: str = "_band",
    exact: bool = True,
) -> DataFrame:
    """Add a band label per column; a missing value is in no band.

    With `by` the cut points are those of the row's own group. `df` is read several
    times, so hand in a written table when it is costly to compute.
    """
    names = [quantile_name(p) for p in probs]
    if not by:
        return with_constants(
            df,
            quantile_row(df, cols, probs, exact),
            lambda row: {f"{c}{suffix}": _band(F.col(c), [row[c][q] for q in names]) for c in cols},
        )
    by = list(by)
    cuts = exact_quantiles(df, cols, probs, by, exact).groupBy(*by).agg(
        *[F.max(F.when(F.col("metric") == c, F.col(q))).alias(f"_{q}_{c}") for c in cols for q in names]
    )
    banded = df.join(cuts, by, "left").withColumns(
        {f"{c}{suffix}": _band(F.col(c), [F.col(f"_{q}_{c}") for q in names]) for c in cols}
    )
    return banded.select(*df.columns, *[f"{c}{suffix}" for c in cols])


def complete_bands(df: DataFrame, cols: Sequence[str], suffix: str = "_band") -> DataFrame:
    """Rows that have a band in every column."""
    return df.na.drop("any", subset=[f"{c}{suffix}" for c in cols])


def band_list(df: DataFrame, cols: Sequence[str], ids: Sequence[str], suffix: str = "_band") -> DataFrame:
    """Bands one below the other: ids, metric, band."""
    return (
        df.unpivot(list(ids), [f"{c}{suffix}" for c in cols], "metric", "band")
        .where(F.col("band").isNotNull())
        .withColumn("metric", F.replace("metric", F.lit(suffix), F.lit("")))
    )


def band_profile(
    df: DataFrame, group: str, cols: Sequence[str], n_cuts: int = 3, suffix: str = "_band"
) -> DataFrame:
    """Mean band number per group, over the rows that have a band in every column."""
    bands = [f"{c}{suffix}" for c in cols]
    numbered = recode(complete_bands(df, cols, suffix), bands, band_numbers(n_cuts), default="null", cast="int")
    return group_means(numbered, [group], dict(zip(bands, cols)))


def band_gap(
    df: DataFrame, group: str, high: str, low: str, cuts: Mapping[str, float | Column] | None = None
) -> DataFrame:
    """Gap per group between the top band of one column and the bottom band of another.

    The thresholds are each column's own outer quartiles unless `cuts` states
    others as {"high": ..., "low": ...}.
    """
    if cuts is None:
        df = df.withColumn("_cuts", quantile_row(df, [high, low], (0.25, 0.75)))
        cuts = {"high": F.col("_cuts")[high]["q75"], "low": F.col("_cuts")[low]["q25"]}
    return gap_by_group(
        df, group, high, low, F.col(high) > F.lit(cuts["high"]), F.col(low) < F.lit(cuts["low"])
    )
