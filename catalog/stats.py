"""Totals, shares, gaps, correlations, distributions, order and shape."""

from pyspark.sql import functions as F

from areastats.operators import stats as s
from areastats.operators.cleaning import rename_columns
from areastats.sources import materialise
from catalog.areas import CLASSES, RATES, SIZES, areas, areas_by_class, with_areas
from catalog.registry import query, r, rounded, rsql, table

# The class share query is the smallest slice of the whole: lines by region and class.
_CLASS_ROWS = """rows AS (SELECT r_name AS reg, l_linestatus AS class, l_quantity AS pop FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_TOTALS = """t AS (SELECT reg, sum(pop) FILTER (WHERE class = 'F') AS total_f, sum(pop) FILTER (WHERE class = 'O') AS total_o,
  total_f + total_o AS total FROM rows GROUP BY reg)"""
_STATUS_TOTALS = _TOTALS.replace("FROM rows", "FROM profile")


def class_rows(spark, d, *extra):
    """Quantity per area and class: summed per order, joined on the same key, then summed per area.

    `extra` names columns of the orders to keep apart.
    """
    sums = {n: f"sum(l_quantity) FILTER (WHERE l_linestatus = '{k}')" for k, n in CLASSES.items()}
    per_area = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(*[F.expr(f"{e} AS {n}") for n, e in sums.items()])
        .join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
        .groupBy("o_custkey", *extra)
        .agg(*[F.sum(n).alias(n) for n in sums])
    )
    places = (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    stacked = ", ".join(f"'{k}', {n}" for k, n in CLASSES.items())
    rows = per_area.join(places, F.expr("o_custkey = c_custkey")).selectExpr(
        "r_name AS reg", "n_name AS dep", *extra, f"stack({len(sums)}, {stacked}) AS (class, pop)"
    )
    return rows.where("pop IS NOT NULL")


@query(
    "class_share_group",
    f"WITH {_CLASS_ROWS}, {_TOTALS} SELECT *, {rsql({'share_f': 'total_f / total * 100', 'share_o': 'total_o / total * 100'})} FROM t",
)
def class_share_group(spark, d):
    return rounded(s.class_share(class_rows(spark, d), "reg", "class", "pop", CLASSES)).orderBy("reg")


@query(
    "class_share_total",
    f"""WITH {_CLASS_ROWS}, {_TOTALS} SELECT *, {rsql({'share_f': 'total_f / (SELECT sum(total_f) FROM t) * 100',
        'share_o': 'total_o / (SELECT sum(total_o) FROM t) * 100'})} FROM t""",
)
def class_share_total(spark, d):
    return rounded(s.class_share(class_rows(spark, d), "reg", "class", "pop", CLASSES, of="total"))


@query(
    "mean_of_shares",
    f"""WITH {_CLASS_ROWS}, {_TOTALS} SELECT {rsql({
        'mean_share_f': 'avg(total_f / total * 100)', 'mean_share_o': 'avg(total_o / total * 100)',
        'overall_share_f': 'sum(total_f) / (sum(total_f) + sum(total_o)) * 100',
        'overall_share_o': 'sum(total_o) / (sum(total_f) + sum(total_o)) * 100'})} FROM t""",
)
def mean_of_shares(spark, d):
    return rounded(s.mean_of_shares(class_rows(spark, d), "reg", "class", "pop", CLASSES))


@query(
    "compare_versions",
    f"""WITH {_CLASS_ROWS},
        v AS (SELECT r_name AS reg, l_linestatus AS class, l_quantity AS pop FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
              WHERE o_orderstatus = 'F'),
        a AS (SELECT reg, sum(pop) FILTER (WHERE class = 'F') AS f, sum(pop) FILTER (WHERE class = 'O') AS o FROM rows GROUP BY reg),
        b AS (SELECT reg, sum(pop) FILTER (WHERE class = 'F') AS f, sum(pop) FILTER (WHERE class = 'O') AS o FROM v GROUP BY reg)
        SELECT a.reg, {rsql({'share_f_all': 'a.f / sum(a.f) OVER () * 100', 'share_o_all': 'a.o / sum(a.o) OVER () * 100',
                             'share_f_done': 'b.f / sum(b.f) OVER () * 100', 'share_o_done': 'b.o / sum(b.o) OVER () * 100'}, 2)}
        FROM a LEFT JOIN b USING (reg)""",
)
def compare_versions(spark, d):
    rows = class_rows(spark, d, "o_orderstatus")
    done = rows.where("o_orderstatus = 'F'")
    return s.compare_versions({"all": rows, "done": done}, "reg", "class", "pop", CLASSES, 2, "half_up")


@query(
    "scalar_totals",
    """SELECT sum(l_quantity) AS total, coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS total_f,
       coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS total_o, CAST(0 AS DOUBLE) AS total_x FROM lineitem""",
)
def scalar_totals(spark, d):
    kind = F.col("l_linestatus")
    sums = {"total": ("l_quantity", None), "total_f": ("l_quantity", kind == "F"), "total_o": ("l_quantity", kind == "O"), "total_x": ("l_quantity", kind == "X")}
    return s.scalar_sums(table(spark, d, "lineitem"), sums)


@query(
    "group_sum_by_class",
    f"WITH {_CLASS_ROWS.replace('r_name AS reg', 'n_name AS reg')}, {_TOTALS} SELECT reg AS dep, total_f, total_o, total FROM t",
)
def group_sum_by_class(spark, d):
    return s.class_totals(class_rows(spark, d), "dep", "class", "pop", CLASSES)


_GAP = {"mean_rate_a_f": "m_a", "mean_rate_a_o": "m_b", "gap_pct": "(m_a - m_b) / m_a * 100"}


@query(
    "gap_pct_region",
    with_areas(
        f"SELECT reg, {rsql(_GAP)} FROM (SELECT reg, avg(rate_a_f) AS m_a, avg(rate_a_o) AS m_b FROM simple GROUP BY reg)"
    ),
)
def gap_pct_region(spark, d):
    gaps = s.gap_by_group(areas(spark, d), "reg", "rate_a_f", "rate_a_o")
    return s.sort_rows(rounded(gaps), "gap_pct", ties=["reg"])


@query(
    "region_means",
    with_areas(f"SELECT reg AS region, {rsql({n: f'avg({c})' for c, n in zip(RATES, 'abcdef')})} FROM simple GROUP BY reg"),
)
def region_means(spark, d):
    means = s.group_means(areas(spark, d), ["reg"], RATES)
    return rounded(rename_columns(s.sort_rows(means, RATES[0], ascending=False), ["region", *"abcdef"]))


@query(
    "firms_by_region",
    with_areas(
        f"""SELECT *, {r('total / (SELECT sum(firms) FROM simple) * 100')} AS share
            FROM (SELECT reg, CAST(sum(firms) AS BIGINT) AS total FROM simple GROUP BY reg)"""
    ),
)
def firms_by_region(spark, d):
    return s.sort_rows(rounded(s.group_share(areas(spark, d), "reg", "firms")), "total", ties=["reg"])


@query(
    "large_share",
    with_areas(
        f"""SELECT *, {r('large / (SELECT sum(large) FROM simple) * 100')} AS pct
            FROM (SELECT reg, CAST(sum(large) AS BIGINT) AS large FROM simple GROUP BY reg)"""
    ),
)
def large_share(spark, d):
    return rounded(s.group_share(areas(spark, d), "reg", "large", total="large", share="pct"))


@query(
    "collapse_area",
    """SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS spent,
         arg_min(st, k) FILTER (WHERE st IS NOT NULL) AS st, arg_min(pr, k) AS pr
       FROM (SELECT o_custkey, o_totalprice, nullif(o_orderstatus, 'F') AS st, o_orderpriority AS pr, (o_orderdate, o_orderkey) AS k
             FROM orders) GROUP BY 1""",
)
def collapse_area(spark, d):
    rows = table(spark, d, "orders").select(
        "o_custkey",
        F.col("o_totalprice").cast("decimal(18,2)").alias("spent"),
        F.nullif("o_orderstatus", F.lit("F")).alias("st"),
        F.col("o_orderpriority").alias("pr"),
        "o_orderdate",
        "o_orderkey",
    )
    out = s.collapse(rows, ["o_custkey"], ["spent"], ["st", "pr"], ["o_orderdate", "o_orderkey"])
    return out.withColumn("spent", F.col("spent").cast("double"))


@query(
    "collapse_profile",
    with_areas(f"SELECT area, pop, reg, dep, {', '.join(RATES)} FROM simple"),
)
def collapse_profile(spark, d):
    return s.collapse(areas_by_class(areas(spark, d)), ["area"], ["pop"], ["reg", "dep", *RATES], ["class"])


@query("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return s.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query(
    "describe_categories",
    """WITH l AS (SELECT unnest(['p_brand', 'p_type', 'p_name']) AS metric, unnest([p_brand, p_type, p_name]) AS value FROM part),
       c AS (SELECT metric, value, count(*) AS k FROM l WHERE value IS NOT NULL GROUP BY ALL)
       SELECT metric, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_unique, arg_min(value, (-k, value)) AS top, max(k) AS freq
       FROM c GROUP BY metric""",
)
def describe_categories(spark, d):
    return s.describe_categories(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "none"]


@query(
    "describe_numbers",
    f"""WITH t AS (SELECT *, NULL AS none FROM lineitem),
       l AS (SELECT unnest([{', '.join(f"'{c}'" for c in _NUMBERS)}]) AS metric,
             unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in _NUMBERS)}]) AS value FROM t)
       SELECT metric, count(value) AS n, {rsql({'mean': 'avg(value)', 'std': 'stddev_samp(value)', 'minimum': 'min(value)',
       'maximum': 'max(value)', 'q25': 'quantile_cont(value, 0.25)', 'q50': 'quantile_cont(value, 0.5)',
       'q75': 'quantile_cont(value, 0.75)'})} FROM l GROUP BY metric""",
)
def describe_numbers(spark, d):
    """Figures of the number columns of lineitem, and of a column that has no value."""
    return rounded(s.describe_numbers(table(spark, d, "lineitem").withColumn("none", F.lit(None)), _NUMBERS))


_BOX = """l AS ({rows}),
  f AS (SELECT {by} metric, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75
        FROM l GROUP BY ALL),
  j AS (SELECT l.*, q25, q50, q75, value >= q25 - (q75 - q25) * 1.5 AND value <= q75 + (q75 - q25) * 1.5 AS ok
        FROM l JOIN f USING ({by} metric))"""
_BOX_OUT = rsql(
    {
        "minimum": "min(value)", "whisker_low": "min(value) FILTER (WHERE ok)", "q25": "max(q25)", "q50": "max(q50)",
        "q75": "max(q75)", "whisker_high": "max(value) FILTER (WHERE ok)", "maximum": "max(value)",
    }
)


def long_sql(cols, source, ids=""):
    names = ", ".join(f"'{c}'" for c in cols)
    return (
        f"SELECT * FROM (SELECT {ids} unnest([{names}]) AS metric, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in cols)}]) AS value "
        f"FROM {source}) WHERE value IS NOT NULL"
    )


@query(
    "box_stats",
    with_areas(
        f"SELECT metric, count(*) AS n, {_BOX_OUT}, count(*) FILTER (WHERE NOT ok) AS n_outliers FROM j GROUP BY metric",
        _BOX.format(rows=long_sql(RATES, "simple"), by=""),
    ),
)
def box_stats(spark, d):
    rows = materialise(areas(spark, d).select(*RATES), "areas")
    return rounded(s.box_stats(rows, RATES))


@query(
    "box_stats_by_region",
    with_areas(
        f"SELECT reg, metric, count(*) AS n, {_BOX_OUT}, count(*) FILTER (WHERE NOT ok) AS n_outliers FROM j GROUP BY reg, metric",
        _BOX.format(rows=long_sql(RATES, "simple", "reg,"), by="reg,"),
    ),
)
def box_stats_by_region(spark, d):
    rows = materialise(areas(spark, d).select("reg", *RATES), "areas")
    return rounded(s.box_stats(rows, RATES, by=["reg"]))


@query(
    "box_outliers",
    f"""WITH {_BOX.format(rows="SELECT o_orderkey, 'skewed' AS metric, o_totalprice * o_totalprice * o_totalprice / 1e12 AS value FROM orders", by="")}
        SELECT o_orderkey, metric, {r('value')} AS value FROM j WHERE NOT ok""",
)
def box_outliers(spark, d):
    price = F.col("o_totalprice")
    rows = table(spark, d, "orders").select("o_orderkey", (price * price * price / 1e12).alias("skewed"))
    return rounded(s.outliers(rows, ["skewed"], ["o_orderkey"]))


@query(
    "corr_region",
    with_areas(
        f"""SELECT count(*) AS n, {r('corr(pop, firms)')} AS correlation FROM
            (SELECT reg, sum(pop) AS pop, sum(firms) AS firms FROM simple GROUP BY reg)"""
    ),
)
def corr_region(spark, d):
    groups = s.group_sums(areas(spark, d), ["reg"], ["pop", "firms"])
    return rounded(s.correlation(groups, "pop", "firms"))


@query(
    "corr_by_region",
    with_areas(
        f"""SELECT reg, count(*) AS n, {r('corr(rate_a_f, rate_a_o)')} AS correlation FROM simple
            WHERE rate_a_f IS NOT NULL AND rate_a_o IS NOT NULL GROUP BY reg"""
    ),
)
def corr_by_region(spark, d):
    return rounded(s.correlation(areas(spark, d), "rate_a_f", "rate_a_o", by=["reg"]))


# For an odd number of degrees of freedom v = 2m + 1 the t distribution has the closed form
# p = 1 - 2/pi * (a + sin(a) * sum_k c_k * cos(a)^(2k - 1)), a = atan(t / sqrt(v)), c_k = prod 2i/(2i + 1).
_PVALUE = (
    "g AS (SELECT dep, sum(firms) AS firms, sum(large) AS large FROM simple GROUP BY dep)",
    "c AS (SELECT count(*) AS n, corr(large, firms) AS rho FROM g)",
    "a AS (SELECT n, rho, atan(abs(rho) / sqrt(1 - rho * rho)) AS a FROM c)",
    """k AS (SELECT i, CASE WHEN i = 1 THEN 1.0 ELSE (2.0 * i - 2) / (2.0 * i - 1) END AS step
        FROM (SELECT unnest(generate_series(1, (n - 3) // 2)) AS i FROM a))""",
    "w AS (SELECT i, exp(sum(ln(step)) OVER (ORDER BY i)) AS c FROM k)",
)


@query(
    "corr_pvalue",
    with_areas(
        f"""SELECT n, {r('rho')} AS correlation,
            {r("1 - 2 / pi() * (a + sin(a) * (SELECT sum(c * power(cos(a.a), 2 * i - 1)) FROM w))")} AS p_value FROM a""",
        *_PVALUE,
    ),
)
def corr_pvalue(spark, d):
    groups = materialise(s.group_sums(areas(spark, d), ["dep"], ["firms", "large"]), "groups")
    return rounded(s.correlation_test(groups, "large", "firms"))


# The tail of the t distribution as an integral: with t = sqrt(v) tan(a), its density is proportional to cos(a)^(v - 1).
_SIMPSON = 2000


@query(
    "corr_pvalue_by_region",
    with_areas(
        f"""SELECT reg, n, {r('rho')} AS correlation, {r('1 - 2 * area * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi())')} AS p_value
          FROM (SELECT reg, any_value(n) AS n, any_value(rho) AS rho, any_value(top) / {3 * _SIMPSON} * sum(
              CASE WHEN i IN (0, {_SIMPSON}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(cos(top * i / {_SIMPSON}), n - 3)) AS area
            FROM h, (SELECT unnest(range({_SIMPSON + 1})) AS i) GROUP BY reg)""",
        """h AS (SELECT reg, count(*) AS n, corr(rate_a_f, rate_a_o) AS rho, atan(abs(rho) / sqrt(1 - rho * rho)) AS top FROM simple
            WHERE rate_a_f IS NOT NULL AND rate_a_o IS NOT NULL GROUP BY reg)""",
    ),
)
def corr_pvalue_by_region(spark, d):
    return rounded(s.correlation_test(areas(spark, d), "rate_a_f", "rate_a_o", by=["reg"]))


@query(
    "sort_rows",
    with_areas(
        """SELECT dep, firms, CAST(row_number() OVER (ORDER BY firms DESC NULLS LAST, dep) - 1 AS BIGINT) AS place
           FROM (SELECT dep, CAST(sum(firms) AS BIGINT) AS firms FROM simple GROUP BY dep)"""
    ),
)
def sort_rows(spark, d):
    """Departments by firms, numbered in the order that sorting gives (a few rows, so in one partition)."""
    groups = s.group_sums(areas(spark, d), ["dep"], ["firms"])
    ordered = s.sort_rows(groups, "firms", ascending=False, ties=["dep"]).coalesce(1)
    return ordered.select("dep", "firms", F.monotonically_increasing_id().alias("place"))


@query(
    "corr_rank_paired",
    with_areas(
        f"""SELECT count(*) AS n, {r('corr(firms, large)')} AS correlation
            FROM (SELECT firms, row_number() OVER (ORDER BY firms) AS rk FROM g)
            JOIN (SELECT large, row_number() OVER (ORDER BY large) AS rk FROM g) USING (rk)""",
        "g AS (SELECT dep, sum(firms) AS firms, sum(large) AS large FROM simple GROUP BY dep)",
    ),
)
def corr_rank_paired(spark, d):
    groups = materialise(s.group_sums(areas(spark, d), ["dep"], ["firms", "large"]), "groups")
    return rounded(s.rank_paired_correlation(groups.select("dep", "firms"), "firms", groups.select("dep", "large"), "large"))


@query(
    "column_range",
    f"""SELECT min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max,
        {r('avg(o_totalprice)', 4)} AS o_totalprice_mean FROM orders""",
)
def column_range(spark, d):
    return rounded(s.column_range(table(spark, d, "orders"), ["o_totalprice"]), 4)


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, d):
    return s.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, ties=["o_orderkey"])


@query(
    "topk_nulls_last",
    with_areas("SELECT area, rate_r_o FROM simple ORDER BY rate_r_o ASC NULLS LAST, area LIMIT 25"),
)
def topk_nulls_last(spark, d):
    return s.top_k(areas(spark, d).select("area", "rate_r_o"), "rate_r_o", 25, ascending=True, ties=["area"])


@query(
    "union_bands",
    """SELECT o_orderkey, 'low' AS band FROM orders WHERE o_totalprice < 125000
       UNION ALL SELECT o_orderkey, 'high' AS band FROM orders WHERE o_totalprice >= 375000""",
)
def union_bands(spark, d):
    orders = table(spark, d, "orders")
    low = orders.where("o_totalprice < 125000").select("o_orderkey", F.lit("low").alias("band"))
    high = orders.where("o_totalprice >= 375000").select("o_orderkey", F.lit("high").alias("band"))
    return low.unionByName(high)


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "transpose_table",
    with_areas(
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, "
            + ", ".join(f"CAST(sum({m}) FILTER (WHERE reg = '{g}') AS BIGINT) AS \"{g}\"" for g in _REGIONS)
            + " FROM simple"
            for m in SIZES
        )
    ),
)
def transpose_table(spark, d):
    return s.transpose(s.group_sums(areas(spark, d), ["reg"], SIZES), "reg", SIZES, _REGIONS)


@query("unpivot_rates", with_areas(long_sql(RATES, "simple", "area,")))
def unpivot_rates(spark, d):
    return s.to_long(areas(spark, d), ["area"], RATES)
