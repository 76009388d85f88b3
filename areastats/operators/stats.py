"""Totals, shares, means, gaps, correlations and distribution summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areastats.functions import as_column, correlation_p_value, gap_percent, percent, round_to, row_sum
from areastats.operators.cleaning import with_constants
from areastats.operators.joins import pair_by_rank
from areastats.operators.quantiles import exact_quantiles, to_long

# -- totals -------------------------------------------------------------------


def scalar_sums(df: DataFrame, sums: Mapping[str, tuple[str | Column, Column | None]]) -> DataFrame:
    """One row of sums, each over the rows meeting its condition; a sum of nothing is 0."""
    exprs = []
    for name, (c, cond) in sums.items():
        value = as_column(c) if cond is None else F.when(cond, as_column(c))
        exprs.append(F.coalesce(F.sum(value), F.lit(0)).alias(name))
    return df.agg(*exprs)


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leave out rows that lack part of their group key."""
    return df.na.drop("any", subset=list(keys))


def group_sums(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], drop_null_keys: bool = True
) -> DataFrame:
    """Sums per group; a finer dimension is rolled away by leaving it out of `keys`."""
    rows = with_keys(df, keys) if drop_null_keys else df
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def group_means(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str] | Mapping[str, str], drop_null_keys: bool = True
) -> DataFrame:
    """Means per group, NaN counting as missing; a mapping renames: {source column: result column}."""
    names = cols if isinstance(cols, Mapping) else {c: c for c in cols}
    rows = with_keys(df, keys) if drop_null_keys else df
    fractional = {c for c, t in df.dtypes if t in ("double", "float")}
    known = {c: F.when(~F.isnan(c), F.col(c)) if c in fractional else F.col(c) for c in names}
    return rows.groupBy(*keys).agg(*[F.avg(known[c]).alias(new) for c, new in names.items()])


def collapse(
    df: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str],
    firsts: Sequence[str],
    order: Sequence[str | Column],
) -> DataFrame:
    """One row per key: some columns summed, the others taken from the first row that has them."""
    if not order:
        raise ValueError("'first' needs the columns that order the rows")
    at = F.struct(*[as_column(o) for o in order])
    return with_keys(df, keys).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in firsts],
    )


def column_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with min, max and mean of each column."""
    return df.agg(
        *[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    )


# -- shares -------------------------------------------------------------------


def class_totals(
    df: DataFrame, group: str, cls: str, value: str, classes: Mapping[object, str]
) -> DataFrame:
    """Total per group and class, one column per class plus their sum, in one pass.

    `classes` maps class values to column suffixes. A class absent from a group
    has no total there, and then neither has the group as a whole.
    """
    totals = with_keys(df, [group]).groupBy(group).agg(
        *[F.sum(F.when(F.col(cls) == F.lit(k), F.col(value))).alias(f"total_{n}") for k, n in classes.items()]
    )
    return totals.withColumn("total", row_sum([f"total_{n}" for n in classes.values()]))


def class_share(
    df: DataFrame, group: str, cls: str, value: str, classes: Mapping[object, str], of: str = "group"
) -> DataFrame:
    """Percent of each class within its group, or of each group within the class's grand total."""
    totals = class_totals(df, group, cls, value, classes)
    names = list(classes.values())
    if of == "group":
        return totals.withColumns({f"share_{n}": percent(f"total_{n}", "total") for n in names})
    if of != "total":
        raise ValueError(f"of must be 'group' or 'total', not {of!r}")
    grand = totals.agg(F.struct(*[F.sum(f"total_{n}").alias(n) for n in names])).scalar()
    return with_constants(
        totals, grand, lambda row: {f"share_{n}": percent(f"total_{n}", row[n]) for n in names}
    )


def mean_of_shares(
    df: DataFrame, group: str, cls: str, value: str, classes: Mapping[object, str]
) -> DataFrame:
    """Unweighted mean over groups of the class shares, beside the share in the whole."""
    shares = class_share(df, group, cls, value, classes)
    names = list(classes.values())
    whole = row_sum([F.sum(f"total_{n}") for n in names])
    return shares.agg(
        *[F.avg(f"share_{n}").alias(f"mean_share_{n}") for n in names],
        *[percent(F.sum(f"total_{n}"), whole).alias(f"overall_share_{n}") for n in names],
    )


def group_share(df: DataFrame, group: str, value: str, total: str = "total", share: str = "share") -> DataFrame:
    """Total per group and its percentage of the grand total."""
    totals = with_keys(df, [group]).groupBy(group).agg(F.sum(value).alias(total))
    grand = totals.agg(F.sum(total)).scalar()
    return totals.withColumn(share, percent(total, grand))


def compare_versions(
    versions: Mapping[str, DataFrame],
    group: str,
    cls: str,
    value: str,
    classes: Mapping[object, str],
    digits: int = 2,
    mode: str = "half_even",
) -> DataFrame:
    """Shares of each group in the class totals, for several versions of a table side by side."""
    tagged = None
    for name, frame in versions.items():
        part = frame.select(group, cls, value, F.lit(name).alias("_version"))
        tagged = part if tagged is None else tagged.unionByName(part)
    cells = {
        f"{n}_{v}": F.sum(F.when((F.col("_version") == v) & (F.col(cls) == F.lit(k)), F.col(value)))
        for v in versions
        for k, n in classes.items()
    }
    totals = with_keys(tagged, [group]).groupBy(group).agg(*[e.alias(c) for c, e in cells.items()])
    grand = totals.agg(F.struct(*[F.sum(c).alias(c) for c in cells])).scalar()
    return with_constants(
        totals, grand, lambda row: {f"share_{c}": round_to(percent(c, row[c]), digits, mode) for c in cells}
    ).drop(*cells)


def gap_by_group(
    df: DataFrame,
    group: str,
    high: str,
    low: str,
    high_where: Column | None = None,
    low_where: Column | None = None,
    gap: str = "gap_pct",
) -> DataFrame:
    """Mean of two columns per group and the gap between them in percent of the first.

    Each mean may be limited to rows meeting a condition.
    """
    hi = F.col(high) if high_where is None else F.when(high_where, F.col(high))
    lo = F.col(low) if low_where is None else F.when(low_where, F.col(low))
    means = with_keys(df, [group]).groupBy(group).agg(
        F.avg(hi).alias(f"mean_{high}"), F.avg(lo).alias(f"mean_{low}")
    )
    return means.withColumn(gap, gap_percent(f"mean_{high}", f"mean_{low}"))


# -- frequencies and distributions -------------------------------------------


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(col))


def describe_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per text column: values present, distinct values, the commonest and how often it occurs.

    Of equally common values the smallest is named. Values are counted before they
    are summarised, so no task holds all distinct values of a column. A column without
    any value has a row with counts of 0.
    """
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    counts = texts.unpivot([], list(cols), "metric", "value").groupBy("metric", "value").agg(F.count(F.lit(1)).alias("freq"))
    present = F.when(F.col("value").isNotNull(), F.col("freq"))
    return counts.groupBy("metric").agg(
        F.coalesce(F.sum(present), F.lit(0)).alias("n"),
        F.count("value").alias("n_unique"),
        F.min_by("value", F.when(present.isNotNull(), F.struct(-F.col("freq"), F.col("value")))).alias("top"),
        F.max(present).alias("freq"),
    )


def describe_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per number column: values present, mean, sample standard deviation, minimum, quartiles, maximum.

    NaN counts as missing. A column without any value has a row with n = 0.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "metric", "value")
    figures = numbers.withColumn("value", F.when(~F.isnan("value"), F.col("value"))).groupBy("metric").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )
    return figures.join(exact_quantiles(df, cols).drop("n"), "metric", "left")


def _with_fences(df: DataFrame, cols: Sequence[str], by: Sequence[str], reach: float) -> DataFrame:
    keys = [*by, "metric"]
    fences = exact_quantiles(df, cols, (0.25, 0.5, 0.75), by)
    spread = (F.col("q75") - F.col("q25")) * reach
    fences = fences.select(
        *keys, "q25", "q50", "q75", (F.col("q25") - spread).alias("_low"), (F.col("q75") + spread).alias("_high")
    )
    # Without groups there is one row per column, which is safe to broadcast.
    return to_long(df, by, cols).join(fences if by else F.broadcast(fences), keys)


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Box-plot figures per column (and group).

    Whiskers end at the outermost values within `reach` interquartile ranges of
    the box; what lies beyond is counted as outliers.
    """
    by = list(by)
    inside = (F.col("value") >= F.col("_low")) & (F.col("value") <= F.col("_high"))
    return _with_fences(df, cols, by, reach).groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("minimum"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max("q25").alias("q25"),
        F.max("q50").alias("q50"),
        F.max("q75").alias("q75"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.max("value").alias("maximum"),
        F.count_if(~inside).alias("n_outliers"),
    )


def outliers(df: DataFrame, cols: Sequence[str], ids: Sequence[str], reach: float = 1.5) -> DataFrame:
    """The values beyond the whiskers, with the row they belong to."""
    fences = exact_quantiles(df, cols, (0.25, 0.75))
    spread = (F.col("q75") - F.col("q25")) * reach
    bounds = fences.select("metric", (F.col("q25") - spread).alias("_low"), (F.col("q75") + spread).alias("_high"))
    rows = to_long(df, ids, cols).join(F.broadcast(bounds), "metric")
    beyond = (F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high"))
    return rows.where(beyond).select(*ids, "metric", "value")


# -- correlation --------------------------------------------------------------


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation over the rows that have both values; NULL if one of them does not vary.

    Spark's `corr` divides by zero in that case, which is an error under ANSI rules.
    """
    both = df.na.drop("any", subset=[x, y])
    rho = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    bounded = F.when(rho.isNotNull(), F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0)))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), bounded.alias("correlation"))


def correlation_test(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation and its two-sided p-value, for each group; both NULL where they are undefined.

    One aggregate: the p-value is a function of n and r, see `correlation_p_value`.
    """
    figures = correlation(df.withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")}), x, y, by)
    return figures.withColumn("p_value", correlation_p_value(F.col("correlation"), F.col("n")))


def rank_paired_correlation(left: DataFrame, x: str, right: DataFrame, y: str) -> DataFrame:
    """Correlation of two columns that were each sorted on their own before pairing.

    It tells how alike the two distributions are, not how the columns go together.
    """
    return correlation(pair_by_rank(left, x, right, y), x, y)


# -- order and shape ----------------------------------------------------------


def sort_rows(df: DataFrame, by: str, ascending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Sort with missing values last in either direction; `ties` settle equal values."""
    first = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(first, *ties)


def top_k(df: DataFrame, by: str, k: int, ascending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """The k first rows in sort order; every task keeps only k rows, so nothing is sorted whole."""
    return sort_rows(df, by, ascending, ties).limit(k)


def transpose(df: DataFrame, key: str, values: Sequence[str], headers: Sequence) -> DataFrame:
    """Turn a small table on its side: one row per column of `values`, one column per header.

    `headers` lists the key values; naming them spares a pass to find them.
    """
    return (
        df.unpivot([key], list(values), "metric", "value")
        .groupBy("metric")
        .pivot(key, list(headers))
        .agg(F.max("value"))
    )
