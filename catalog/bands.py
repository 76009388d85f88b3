"""Quantile bands."""

from pyspark.sql import functions as F

from areastats.operators import bands as b
from areastats.operators import joins as j
from areastats.operators.quantiles import exact_quantiles
from areastats.sources import materialise
from catalog.areas import RATES, areas, with_areas
from catalog.registry import query, rounded, rsql, table
from catalog.stats import long_sql

COLS = RATES


def _cuts(cols):
    return "cuts AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.5) AS {c}_2, quantile_cont({c}, 0.75) AS {c}_3" for c in cols
    ) + " FROM simple)"


def _band(c):
    return (
        f"CASE WHEN {c} < {c}_1 THEN 'Q1' WHEN {c} <= {c}_2 THEN 'Q2' WHEN {c} <= {c}_3 THEN 'Q3' WHEN {c} > {c}_3 THEN 'Q4' END"
    )


def _banded(cols):
    return "banded AS (SELECT simple.*, " + ", ".join(f"{_band(c)} AS {c}_band" for c in cols) + " FROM simple, cuts)"


def _number(c):
    return f"CAST(substr({c}_band, 2) AS INTEGER)"


def area_rates(spark, d, *extra):
    """Area keys and rates, written once: bands read their input several times."""
    return materialise(areas(spark, d).select("area", "dep", "reg", *RATES, *extra), "areas")


@query(
    "quantile_table",
    with_areas(
        f"SELECT metric, {rsql({q: f'quantile_cont(value, {p})' for q, p in (('q25', .25), ('q50', .5), ('q75', .75))})} FROM l GROUP BY metric",
        f"l AS ({long_sql(RATES, 'simple')})",
    ),
)
def quantile_table(spark, d):
    return rounded(b.quantile_table(area_rates(spark, d), RATES))


@query(
    "quantile_table_across",
    with_areas(
        " UNION ALL ".join(
            f"SELECT '{q}' AS quantile, {rsql({c: f'quantile_cont({c}, {p})' for c in COLS})} FROM simple"
            for q, p in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99))
        )
    ),
)
def quantile_table_across(spark, d):
    return rounded(b.quantile_table(area_rates(spark, d), COLS, (0.1, 0.5, 0.99), across=True))


@query(
    "line_price_quantiles",
    f"""SELECT l_returnflag, metric, count(*) AS n, {rsql({'q25': 'quantile_cont(value, 0.25)', 'q50': 'quantile_cont(value, 0.5)', 'q75': 'quantile_cont(value, 0.75)'})}
        FROM ({long_sql(['l_extendedprice', 'l_quantity'], 'lineitem', 'l_returnflag,')}) GROUP BY ALL""",
)
def line_price_quantiles(spark, d):
    lines = table(spark, d, "lineitem")
    return rounded(exact_quantiles(lines, ["l_extendedprice", "l_quantity"], by=["l_returnflag"]))


@query(
    "quantile_bands",
    with_areas(f"SELECT area, {', '.join(f'{c}_band' for c in RATES)} FROM banded", _cuts(RATES), _banded(RATES)),
)
def quantile_bands(spark, d):
    return b.quantile_bands(area_rates(spark, d), RATES).select("area", *[f"{c}_band" for c in RATES])


@query(
    "bands_by_region",
    with_areas(
        f"SELECT area, reg, {', '.join(f'{_band(c)} AS {c}_band' for c in COLS)} FROM simple JOIN cuts USING (reg)",
        _cuts(COLS).replace("(SELECT ", "(SELECT reg, ", 1).replace("FROM simple", "FROM simple GROUP BY reg"),
    ),
)
def bands_by_region(spark, d):
    banded = b.quantile_bands(area_rates(spark, d), COLS, by=["reg"])
    return banded.select("area", "reg", *[f"{c}_band" for c in COLS])


@query(
    "band_complete",
    with_areas(
        f"SELECT area, dep, reg, {', '.join(f'{c}_band' for c in COLS)} FROM banded WHERE {' AND '.join(f'{c}_band IS NOT NULL' for c in COLS)}",
        _cuts(COLS),
        _banded(COLS),
    ),
)
def band_complete(spark, d):
    banded = b.quantile_bands(area_rates(spark, d), COLS)
    return b.complete_bands(banded, COLS).select("area", "dep", "reg", *[f"{c}_band" for c in COLS])


@query(
    "band_counts",
    with_areas(
        " UNION ALL ".join(
            f"SELECT '{c}' AS metric, {c}_band AS band, count(*) AS n FROM banded WHERE {c}_band IS NOT NULL GROUP BY ALL" for c in COLS
        ),
        _cuts(COLS),
        _banded(COLS),
    ),
)
def band_counts(spark, d):
    listed = b.band_list(b.quantile_bands(area_rates(spark, d), COLS), COLS, ["area"])
    return listed.groupBy("metric", "band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "band_presence",
    with_areas(
        """SELECT CASE WHEN y IS NULL THEN 'left_only' WHEN x IS NULL THEN 'right_only' ELSE 'both' END AS presence, count(*) AS n
           FROM (SELECT rate_a_f_band AS x, rate_a_o_band AS y FROM banded WHERE rate_a_f_band IS NOT NULL OR rate_a_o_band IS NOT NULL)
           GROUP BY ALL""",
        _cuts(COLS),
        _banded(COLS),
    ),
)
def band_presence(spark, d):
    banded = b.quantile_bands(area_rates(spark, d), ["rate_a_f", "rate_a_o"])
    keys = ["area", "dep", "reg"]
    sides = [b.band_list(banded, [c], keys).select(*keys, "band") for c in ("rate_a_f", "rate_a_o")]
    return j.presence_join(*sides, keys).groupBy("presence").agg(F.count(F.lit(1)).alias("n"))


PROFILE_CTES = (
    _cuts(RATES),
    _banded(RATES),
    "bp AS (SELECT dep, "
    + ", ".join(f"avg({_number(c)}) AS {c}" for c in RATES)
    + " FROM banded WHERE "
    + " AND ".join(f"{c}_band IS NOT NULL" for c in RATES)
    + " GROUP BY dep)",
)


@query("band_profile", with_areas(f"SELECT dep, {rsql({c: c for c in RATES})} FROM bp", *PROFILE_CTES))
def band_profile(spark, d):
    return rounded(b.band_profile(b.quantile_bands(area_rates(spark, d), RATES), "dep", RATES))


_GAP = f"""SELECT reg, {rsql({'mean_rate_a_f': 'h', 'mean_rate_r_o': 'l', 'gap_pct': '(h - l) / h * 100'})} FROM
  (SELECT reg, avg(rate_a_f) FILTER (WHERE rate_a_f > hi) AS h, avg(rate_r_o) FILTER (WHERE rate_r_o < lo) AS l
   FROM simple, c GROUP BY reg)"""


@query(
    "band_gap",
    with_areas(_GAP, "c AS (SELECT quantile_cont(rate_a_f, 0.75) AS hi, quantile_cont(rate_r_o, 0.25) AS lo FROM simple)"),
)
def band_gap(spark, d):
    return rounded(b.band_gap(area_rates(spark, d), "reg", "rate_a_f", "rate_r_o"))


@query("band_gap_stated", with_areas(_GAP, "c AS (SELECT 1700 AS hi, 1400 AS lo)"))
def band_gap_stated(spark, d):
    return rounded(b.band_gap(areas(spark, d), "reg", "rate_a_f", "rate_r_o", {"high": 1700, "low": 1400}))
