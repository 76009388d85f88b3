"""Joining tables on keys.

No join carries a broadcast hint. Spark measures the sides and broadcasts the one
that fits; otherwise it shuffles both and splits partitions that one key has filled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.operators.quantiles import rank_rows


def _suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]):
    """Give non-key columns that both tables have a suffix on either side."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in shared}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in shared}),
    )


def equi_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Inner or left join on equal keys; `null_safe` lets NULL match NULL."""
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join {how!r}")
    keys = list(keys)
    left, right = _suffixed(left, right, keys, suffixes)
    if not null_safe:
        return left.join(right, keys, how)
    right, cond = _same_keys(right, keys)
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def _same_keys(right: DataFrame, keys: Sequence[str]):
    """`right` with its keys renamed, and the condition that they equal those of the left side, NULL or not."""
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return right.withColumnsRenamed({k: f"_r_{k}" for k in keys}), cond


def _without(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of `left` whose key is not in `right`.

    Only the distinct keys of `right` are shuffled; a frequent key of `left` can be split.
    """
    right = right.select(*keys).distinct()
    if not null_safe:
        return left.join(right, list(keys), "left_anti")
    right, cond = _same_keys(right, keys)
    return left.join(right, cond, "left_anti")


def presence_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    indicator: str = "presence",
    null_safe: bool = False,
) -> DataFrame:
    """Full outer join with a column saying left_only, right_only or both; `null_safe` lets NULL match NULL.

    Put together from the matches and the rows without one. Spark can split a
    frequent key in each of the three joins, which it cannot in a full outer join.
    Each input is read for the matches and again for the rows without one.
    """
    keys = list(keys)
    left, right = _suffixed(left, right, keys, suffixes)
    both = equi_join(left, right, keys, null_safe=null_safe).withColumn(indicator, F.lit("both"))
    only_left = _without(left, right, keys, null_safe).withColumn(indicator, F.lit("left_only"))
    only_right = _without(right, left, keys, null_safe).withColumn(indicator, F.lit("right_only"))
    return both.unionByName(only_left, allowMissingColumns=True).unionByName(only_right, allowMissingColumns=True)


def unmatched(
    left: DataFrame, right: DataFrame, keys: Sequence[str], indicator: str = "presence", null_safe: bool = False
) -> DataFrame:
    """Rows whose key is in one table only; `null_safe` lets NULL match NULL."""
    only_left = _without(left, right, keys, null_safe).withColumn(indicator, F.lit("left_only"))
    only_right = _without(right, left, keys, null_safe).withColumn(indicator, F.lit("right_only"))
    return only_left.unionByName(only_right, allowMissingColumns=True)


def intersect_all(frames: Sequence[DataFrame], keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows whose key is in every table, with the columns of all of them; `null_safe` lets NULL match NULL.

    Every join uses the same keys, so the partitioning of the first is reused.
    """
    return reduce(lambda a, b: equi_join(a, b, keys, null_safe=null_safe), frames)


def align(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Put two grouped results side by side; a group missing on one side gives NULL there.

    `null_safe` makes the groups without a key one group.

    Both inputs have one row per key, so a full outer join cannot be skewed.
    """
    if not null_safe:
        return left.join(right, list(keys), "full")
    # Both key columns are NULL in a matched NULL group, so either side's key is the group's.
    renamed, cond = _same_keys(right, keys)
    joined = left.join(renamed, cond, "full").withColumns({k: F.coalesce(k, f"_r_{k}") for k in keys})
    return joined.drop(*[f"_r_{k}" for k in keys])


def pair_by_rank(left: DataFrame, x: str, right: DataFrame, y: str) -> DataFrame:
    """Pair the i-th smallest `x` with the i-th smallest `y`, whatever rows they come from."""
    a = rank_rows(left, x).select("rank", x)
    b = rank_rows(right, y).select("rank", y)
    return a.join(b, "rank")
