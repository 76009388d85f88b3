"""Cleaning a table: columns in and out, recoding, lookups, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areastats.functions import as_column, map_values, row_sum, to_number


def drop_columns(df: DataFrame, cols: Iterable[str], strict: bool = False) -> DataFrame:
    """Drop columns; with `strict` an absent name is an error."""
    cols = list(cols)
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*cols)


def rename_columns(df: DataFrame, names: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Rename by mapping, or by position with a full list of names."""
    if isinstance(names, Mapping):
        return df.withColumnsRenamed(dict(names))
    return df.toDF(*names)


def present_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that the table has, in table order."""
    return [c for c in df.columns if c in set(wanted)]


def sum_columns(df: DataFrame, sums: Mapping[str, Sequence[str]], drop: bool = False) -> DataFrame:
    """Add columns that are sums of others, e.g. coarser size bands."""
    out = df.withColumns({new: row_sum(parts) for new, parts in sums.items()})
    return out.drop(*{p for parts in sums.values() for p in parts}) if drop else out


def with_constants(df: DataFrame, row: Column, make: Callable[[Column], Mapping[str, Column]]) -> DataFrame:
    """Add columns that use figures of a one-row result, given as a scalar subquery holding a struct.

    The subquery enters the plan once, however many columns use it; no join is needed.
    """
    return df.withColumn("_row", row).withColumns(dict(make(F.col("_row")))).drop("_row")


def recode(
    df: DataFrame,
    cols: str | Sequence[str],
    mapping: Mapping,
    default: str = "keep",
    cast: str | None = None,
    into: str | None = None,
) -> DataFrame:
    """Apply one mapping to one or several columns (see `map_values`)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    if into is not None and len(cols) != 1:
        raise ValueError("`into` needs exactly one source column")
    exprs = {}
    for c in cols:
        expr = map_values(c, mapping, default)
        exprs[into or c] = expr.cast(cast) if cast else expr
    return df.withColumns(exprs)


def invert_mapping(mapping: Mapping) -> dict:
    """Value-to-key mapping; a repeated value would be ambiguous and is an error."""
    inverse = {v: k for k, v in mapping.items()}
    if len(inverse) != len(mapping):
        raise ValueError("mapping has repeated values, so it has no inverse")
    return inverse


def lookup(
    df: DataFrame,
    ref: DataFrame,
    key: str,
    value: str | Mapping[str, str],
    order: Sequence[str | Column] | None = None,
    ref_key: str | None = None,
) -> DataFrame:
    """Add columns of a reference table by key; unknown keys give NULL.

    `value` names the reference column, or maps reference columns to new names.
    A key may repeat in the reference only if `order` says which row is last, and
    that one wins. Spark broadcasts the reference when its measured size is small
    and shuffles it otherwise; a key frequent in `df` is split by adaptive execution.
    """
    values = {value: value} if isinstance(value, str) else dict(value)
    known = ref.where(F.col(ref_key or key).isNotNull())
    if order is not None:
        known = keep_last(known, [ref_key or key], order)
    ref = known.select(F.col(ref_key or key).alias(key), *values)
    clash = [new for new in values.values() if new in df.columns]
    if clash:
        raise ValueError(f"columns already present: {clash}")
    return df.join(ref.withColumnsRenamed(values), key, "left")


def override(df: DataFrame, rules: Iterable[tuple[Column, str, object]]) -> DataFrame:
    """Overwrite single cells: each rule is (condition, column, value); later rules win.

    A rule whose condition is NULL for a row leaves the row as it is.
    """
    for cond, col, value in rules:
        df = df.withColumn(col, F.when(cond, F.lit(value)).otherwise(F.col(col)))
    return df


def coerce_numeric(df: DataFrame, cols: Sequence[str], drop_bad: bool = True) -> DataFrame:
    """Turn columns into numbers; rows left without one are dropped by default."""
    out = df.withColumns({c: to_number(F.col(c).cast("string")) for c in cols})
    return out.na.drop("any", subset=list(cols)) if drop_bad else out


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(cols))


def drop_where(df: DataFrame, cond: Column) -> DataFrame:
    """Drop rows that meet a condition; where it is NULL the row stays."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def distinct_values(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    return df.select(*([cols] if isinstance(cols, str) else cols)).distinct()


def quality_counts(
    df: DataFrame, rules: Mapping[str, Column], distinct: Mapping[str, str] | None = None, exact: bool = True
) -> DataFrame:
    """One row: number of rows, of rows meeting each rule, and of distinct values.

    `exact=False` estimates the distinct values from a sketch instead of shuffling them.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(cond).alias(name) for name, cond in rules.items()],
        *[count(as_column(c)).alias(name) for name, c in (distinct or {}).items()],
    )


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chooser) -> DataFrame:
    if not order:
        raise ValueError("rows have no order of their own: name the columns that order them")
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*[F.col(c) for c in rest])
    # An aggregate, not a window: map tasks keep one row per key before the
    # shuffle, so a key that holds much of the table does not end in one task.
    best = df.groupBy(*keys).agg(chooser(row, F.struct(*[as_column(o) for o in order])).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in ascending `order` (NULL first); `order` should leave no ties."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last row per key in ascending `order`."""
    return _pick(df, keys, order, F.max_by)
