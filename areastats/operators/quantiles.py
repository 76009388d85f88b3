"""Exact quantiles and exact ranks of columns too large for one task.

Spark's own exact percentile gathers every distinct value of a group in one
buffer, and its approximate one merges the sketches of all tasks in one task.
Here numbers are first counted in ordered cells (`log_cell`), whose number is
bounded. The running count over the cells tells which cell holds a wanted rank;
only the numbers in such cells are then looked at one by one, after a second and
finer split of the cell between its smallest and largest number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areastats.functions import log_cell
from areastats.sources import materialise

SUBCELLS = 1024
RUNNING = (Window.unboundedPreceding, Window.currentRow)


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Columns to rows (ids, metric, value); missing values (NULL or NaN) are left out."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(list(ids), list(cols), "metric", "value").where("value IS NOT NULL AND NOT isnan(value)")


def quantile_name(p: float) -> str:
    """Column name of a quantile: 0.25 gives q25, 0.125 gives q12_5."""
    return "q" + f"{round(p * 100, 6):g}".replace(".", "_")


def _subcell(value: str, low: str, high: str) -> str:
    part = f"cast(floor(({value} - {low}) / ({high} - {low}) * {SUBCELLS}) as int)"
    return f"CASE WHEN {high} > {low} THEN least({part}, {SUBCELLS - 1}) ELSE 0 END"


def _hits(probs: Sequence[float], start: str, end: str) -> str:
    """The wanted ranks in [start, end), counted from 0: two neighbouring ones per quantile.

    The expression refers to the column `total`, the number of values.
    """
    slots = []
    for i, p in enumerate(probs):
        below = f"floor({float(p)!r}D * (total - 1))"
        slots.append(f"named_struct('slot', {2 * i}, 'rank', {below})")
        slots.append(f"named_struct('slot', {2 * i + 1}, 'rank', least({below} + 1, total - 1))")
    return f"filter(array({', '.join(slots)}), r -> r.rank >= {start} AND r.rank < {end})"


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """Quantiles with linear interpolation: one row per metric (and group).

    Output: by..., metric, n, and one column per probability (`quantile_name`).
    `exact=False` reads the data once and answers from a sketch.
    """
    by = list(by)
    keys = [*by, "metric"]
    names = [quantile_name(p) for p in probs]
    vals = to_long(df, by, cols)
    if not exact:
        at = ", ".join(f"{float(p)!r}D" for p in probs)
        got = vals.groupBy(*keys).agg(
            F.count("value").alias("n"), F.expr(f"percentile_approx(value, array({at}), 10000)").alias("q")
        )
        return got.select(*keys, "n", *[F.col("q")[i].alias(q) for i, q in enumerate(names)])

    # 1. Count per cell, find the cells that hold a wanted rank.
    vals = vals.withColumn("cell", log_cell("value"))
    per_group = Window.partitionBy(*keys)
    cells = (
        vals.groupBy(*keys, "cell")
        .agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .withColumns(
            {
                "before": F.sum("n").over(per_group.orderBy("cell").rowsBetween(*RUNNING)) - F.col("n"),
                "total": F.sum("n").over(per_group),
            }
        )
    )
    wanted = cells.where(f"size({_hits(probs, 'before', 'before + n')}) > 0").drop("n")

    # 2. Look again at the numbers of these cells only. Without groups there are at
    #    most 2 * len(probs) cells per column, so this side is safe to broadcast; with
    #    groups Spark measures it. Either way numbers are left out before they are counted.
    inside = vals.join(wanted if by else F.broadcast(wanted), [*keys, "cell"]).withColumn("n", F.lit(1))
    figures = [F.sum("n").alias("n"), F.max("before").alias("before"), F.max("total").alias("total")]
    values = (
        inside.withColumn("sub", F.expr(_subcell("value", "low", "high")))
        .groupBy(*keys, "cell", "sub", "value")
        .agg(*figures)
    )
    # Both uses of `values` need the same columns, so Spark runs it once and reuses it.
    hits = _hits(probs, "before + offset", "before + offset + n")
    by_sub = Window.partitionBy(*keys, "cell").orderBy("sub").rowsBetween(*RUNNING)
    subcells = (
        values.groupBy(*keys, "cell", "sub")
        .agg(*figures)
        .withColumn("offset", F.sum("n").over(by_sub) - F.col("n"))
        .where(f"size({hits}) > 0")
        .select(*keys, "cell", "sub", "offset")
    )

    # 3. Exact running count inside the finer cells, then interpolate.
    by_value = Window.partitionBy(*keys, "cell", "sub").orderBy("value").rowsBetween(*RUNNING)
    found = (
        values.join(subcells if by else F.broadcast(subcells), [*keys, "cell", "sub"])
        .withColumn("offset", F.col("offset") + F.sum("n").over(by_value) - F.col("n"))
        .withColumn("hit", F.expr(f"explode({hits})"))
    )
    picked = found.groupBy(*keys).agg(
        F.max("total").alias("n"),
        *[F.expr(f"max(value) FILTER (WHERE hit.slot = {s})").alias(f"_v{s}") for s in range(2 * len(probs))],
    )
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        at = f"{float(p)!r}D * (n - 1)"
        low, high = f"_v{2 * i}", f"_v{2 * i + 1}"
        out.append(F.expr(f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * ({at} - floor({at})) END").alias(name))
    return picked.select(*keys, "n", *out)


def rank_rows(df: DataFrame, col: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add `rank` (0, 1, 2, ...) by ascending `col`; rows without a value (NULL or NaN) are left out.

    Equal values are ordered by hash of `ties`, then by `ties`. The rows are cut into ranges
    of (value, hash), so a value that many rows share is cut as well, and written once: the
    counts per range and the ranks inside them must come from the same cut. Rows equal in
    value and in all of `ties` stay in one range.
    """
    ties = list(ties) or df.columns
    spark = df.sparkSession
    rows = df.withColumn("_v", F.col(col).cast("double")).where("_v IS NOT NULL AND NOT isnan(_v)")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.withColumn("_tie", F.xxhash64(*ties)).repartitionByRange(parts, "_v", "_tie")
    ranges = materialise(ranges.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # Unpartitioned, but over one row per range.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(*RUNNING)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_v", "_tie", *ties))
    ranked = ranges.withColumn("_row", inside).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return ranked.select(*df.columns, (F.col("_before") + F.col("_row") - 1).alias("rank"))
