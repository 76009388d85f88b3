"""Principal components and clusters."""

from pyspark.sql import functions as F

from areastats.operators import reduce as x
from areastats.operators import stats
from areastats.operators.bands import band_profile, quantile_bands
from areastats.operators.cleaning import drop_null
from areastats.plans.clusters import department_profile
from areastats.sources import materialise
from catalog.areas import RATES, areas, with_areas
from catalog.bands import PROFILE_CTES, area_rates
from catalog.registry import query, r, rounded, rsql

PAIR = ["rate_a_f", "rate_n_f"]
_PAIR_CTES = (
    "c2 AS (SELECT * FROM simple WHERE rate_a_f IS NOT NULL AND rate_n_f IS NOT NULL)",
    "rho AS (SELECT corr(rate_a_f, rate_n_f) AS rho FROM c2)",
    """z AS (SELECT area, (rate_a_f - avg(rate_a_f) OVER ()) / stddev_pop(rate_a_f) OVER () AS z1,
           (rate_n_f - avg(rate_n_f) OVER ()) / stddev_pop(rate_n_f) OVER () AS z2 FROM c2)""",
)


def _pair(spark, d):
    return materialise(drop_null(areas(spark, d).select("area", *PAIR), PAIR), "pair")


# Two standardised columns with correlation rho have the axes (1, 1) and (1, -1), both over
# sqrt(2); the one that goes with the sign of rho comes first, with eigenvalue 1 + abs(rho).


@query(
    "pca_variance_2d",
    with_areas(
        f"SELECT 1 AS axis, {r('(1 + abs(rho)) / 2')} AS explained FROM rho UNION ALL SELECT 2 AS axis, {r('(1 - abs(rho)) / 2')} AS explained FROM rho",
        *_PAIR_CTES,
    ),
)
def pca_variance_2d(spark, d):
    return rounded(x.principal_components(_pair(spark, d), PAIR).variance())


@query(
    "pca_loadings_2d",
    with_areas(
        f"""SELECT metric, axis, {r("CASE WHEN metric = 'rate_n_f' AND (axis = 2) = (rho > 0) THEN -1 ELSE 1 END / sqrt(2)")} AS loading
            FROM rho, (SELECT unnest(['rate_a_f', 'rate_n_f']) AS metric), (SELECT unnest([1, 2]) AS axis)""",
        *_PAIR_CTES,
    ),
)
def pca_loadings_2d(spark, d):
    return rounded(x.principal_components(_pair(spark, d), PAIR).loadings())


@query(
    "pca_scores_2d",
    with_areas(
        f"SELECT area, {rsql({'axis_1': '(z1 + sign(rho) * z2) / sqrt(2)', 'axis_2': '(z1 - sign(rho) * z2) / sqrt(2)'})} FROM z, rho",
        *_PAIR_CTES,
    ),
)
def pca_scores_2d(spark, d):
    return rounded(x.principal_components(_pair(spark, d), PAIR).scores(["area"]))


@query(
    "pca_circle_correlations",
    with_areas(
        " UNION ALL ".join(
            f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {r(f'corr({a}, {b})')} AS correlation FROM bp" for a in RATES for b in RATES
        ),
        *PROFILE_CTES,
    ),
)
def pca_circle_correlations(spark, d):
    """Over all axes, the products of variable-axis correlations add up to the correlation of the variables."""
    circle = x.principal_components(department_profile(area_rates(spark, d), "dep", RATES), RATES).circle()
    a = circle.withColumnsRenamed({"metric": "metric_a", "correlation": "ca"})
    b = circle.withColumnsRenamed({"metric": "metric_b", "correlation": "cb"})
    pairs = a.join(b, "axis").groupBy("metric_a", "metric_b")
    return rounded(pairs.agg(F.sum(F.col("ca") * F.col("cb")).alias("correlation")))


@query(
    "pca_score_lengths",
    with_areas(
        "SELECT dep, "
        + r(" + ".join(f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) ** 2" for c in RATES))
        + " AS length FROM bp",
        *PROFILE_CTES,
    ),
)
def pca_score_lengths(spark, d):
    """On all axes together a row is as far from the centre as on its standardised columns."""
    scores = x.principal_components(department_profile(area_rates(spark, d), "dep", RATES), RATES).scores(["dep"])
    squares = [F.pow(f"axis_{k + 1}", F.lit(2)) for k in range(len(RATES))]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return rounded(scores.select("dep", total.alias("length")))


@query("pca_two_axes")
def pca_two_axes(spark, d):
    profile = department_profile(area_rates(spark, d), "dep", RATES)
    return rounded(x.principal_components(profile, RATES, k=2).scores(["dep"]))


# -- clusters -----------------------------------------------------------------

CENTRES = [
    [1.0, 2.0, 3.0, 2.0, 2.5, 3.0],
    [2.0, 2.5, 2.5, 2.0, 2.0, 2.5],
    [3.0, 2.0, 2.0, 3.0, 2.5, 2.0],
    [4.0, 4.0, 1.0, 1.0, 2.0, 4.0],
]
_DIST = [
    "sqrt(" + " + ".join(f"power({c} - {v}, 2)" for c, v in zip(RATES, centre)) + ")" for centre in CENTRES
]


@query(
    "assign_centres",
    with_areas(
        f"""SELECT dep, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster, {r('list_min(ds)')} AS distance
            FROM (SELECT dep, [{', '.join(_DIST)}] AS ds FROM bp)""",
        *PROFILE_CTES,
    ),
)
def assign_centres(spark, d):
    profile = band_profile(quantile_bands(area_rates(spark, d), RATES), "dep", RATES)
    return rounded(x.assign_centres(profile, RATES, CENTRES).select("dep", "cluster", "distance"))


@query("distortion", with_areas(f"SELECT {r(f'avg(least({chr(44).join(_DIST)}))')} AS distortion FROM bp", *PROFILE_CTES))
def distortion(spark, d):
    profile = band_profile(quantile_bands(area_rates(spark, d), RATES), "dep", RATES)
    return rounded(x.distortion(profile, RATES, CENTRES))


# Departments on a line: the best k clusters are k runs of the sorted values. `seg` has the squared
# (ss) and absolute (ad) deviation of every run, `b<k>` the best way to cut the first j values in k runs.
_LINE = [
    "v AS (SELECT dep, avg(rate_all) AS value FROM simple GROUP BY dep)",
    "s AS (SELECT dep, value, row_number() OVER (ORDER BY value) AS rn FROM v)",
    """seg AS (SELECT i, j, sum(power(s.value - m, 2)) AS ss, sum(abs(s.value - m)) AS ad
       FROM (SELECT a.rn AS i, b.rn AS j, avg(t.value) AS m FROM s a JOIN s b ON a.rn <= b.rn JOIN s t ON t.rn BETWEEN a.rn AND b.rn GROUP BY ALL)
       JOIN s ON s.rn BETWEEN i AND j GROUP BY i, j)""",
    "b1 AS (SELECT j, ss, ad, [j] AS cuts FROM seg WHERE i = 1)",
] + [
    f"""b{k} AS (SELECT seg.j, min(b.ss + seg.ss) AS ss, arg_min(b.ad + seg.ad, b.ss + seg.ss) AS ad,
        arg_min(list_append(b.cuts, seg.j), b.ss + seg.ss) AS cuts FROM b{k - 1} b JOIN seg ON seg.i = b.j + 1 GROUP BY seg.j)"""
    for k in range(2, 7)
]


def _line(spark, d):
    return materialise(stats.group_means(areas(spark, d), ["dep"], {"rate_all": "value"}), "line")


@query(
    "elbow",
    with_areas(
        " UNION ALL ".join(
            f"SELECT {k} AS k, {r('ad / (SELECT count(*) FROM s)')} AS distortion FROM b{k} WHERE j = (SELECT count(*) FROM s)" for k in range(2, 7)
        ),
        *_LINE,
    ),
)
def elbow(spark, d):
    return rounded(x.elbow(_line(spark, d), ["value"]))


@query("elbow_all_columns")
def elbow_all_columns(spark, d):
    return rounded(x.elbow(department_profile(area_rates(spark, d), "dep", RATES), RATES))


_LABELS = """lab AS (SELECT dep, value, CAST(len(list_filter(cuts, lambda c: c < rn)) AS INTEGER) AS cluster
  FROM s, (SELECT cuts FROM b4 WHERE j = (SELECT count(*) FROM s)))"""


@query("kmeans_labels", with_areas("SELECT dep, cluster FROM lab", *_LINE, _LABELS))
def kmeans_labels(spark, d):
    return x.cluster_rows(_line(spark, d), ["value"], k=4).labels("dep")


@query("cluster_sizes", with_areas("SELECT cluster, count(*) AS n FROM lab GROUP BY cluster", *_LINE, _LABELS))
def cluster_sizes(spark, d):
    return x.cluster_rows(_line(spark, d), ["value"], k=4).sizes()


@query(
    "cluster_profile",
    with_areas(f"SELECT cluster, {r('avg(value)')} AS value FROM lab GROUP BY cluster", *_LINE, _LABELS),
)
def cluster_profile(spark, d):
    return rounded(x.cluster_rows(_line(spark, d), ["value"], k=4, scale=True).profile())


@query("department_clusters")
def department_clusters(spark, d):
    """Clusters on all band means, with the two principal axes of each department."""
    profile = department_profile(area_rates(spark, d), "dep", RATES)
    scores = x.principal_components(profile, RATES, k=2).scores(["dep"])
    return rounded(x.cluster_rows(profile, RATES, k=4).labels("dep").join(scores, "dep"))


