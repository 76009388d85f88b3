"""Regression models and their scores."""

from pyspark.sql import functions as F

from areastats.operators import features as f
from areastats.operators import models as m
from areastats.operators import stats
from areastats.operators.models import ModelSpec
from areastats.plans.leaderboard import fit_variant, model_comparison, prepare
from catalog.areas import NUMERIC, areas, areas_by_class, with_areas
from catalog.features import SPLIT_SQL
from catalog.registry import query, r, rounded, rsql, table
from catalog.tree_sql import grow_sql, leaves_sql, poisson_sql, splits_sql

_LINES = "o AS (SELECT l_extendedprice AS x, l_quantity AS q, l_extendedprice / l_quantity * (1 - l_discount) AS y FROM lineitem)"


def _lines(spark, d):
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        price.alias("x"), F.col("l_quantity").alias("q"), (price / F.col("l_quantity") * (1 - F.col("l_discount"))).alias("y")
    )


def _fit_table(data, label, cols, spec):
    scaling = f.standard_scaling(data, cols) if spec.kind == "linear" else None
    rows = f.assemble(scaling.apply(data) if scaling else data, cols)
    return rounded(m.coefficients(m.fit_model(rows, label, spec), cols, data.sparkSession, scaling))


@query(
    "ols_1d",
    f"""WITH {_LINES}, c AS (SELECT 'intercept' AS feature, regr_intercept(y, x) AS b FROM o
          UNION ALL SELECT 'x', regr_slope(y, x) FROM o)
        SELECT feature, {rsql({'coefficient': 'b', 'magnitude': 'abs(b)'})} FROM c""",
)
def ols_1d(spark, d):
    return _fit_table(_lines(spark, d), "y", ["x"], ModelSpec("linear", "linear"))


@query(
    "ols_2d",
    f"""WITH {_LINES},
        v AS (SELECT var_pop(x) AS xx, var_pop(q) AS qq, covar_pop(x, q) AS xq, covar_pop(y, x) AS yx, covar_pop(y, q) AS yq,
                avg(x) AS mx, avg(q) AS mq, avg(y) AS my FROM o),
        b AS (SELECT *, (yx * qq - yq * xq) / (xx * qq - xq * xq) AS bx, (yq * xx - yx * xq) / (xx * qq - xq * xq) AS bq FROM v),
        c AS (SELECT 'intercept' AS feature, my - bx * mx - bq * mq AS b FROM b UNION ALL SELECT 'x', bx FROM b UNION ALL SELECT 'q', bq FROM b)
        SELECT feature, {rsql({'coefficient': 'b', 'magnitude': 'abs(b)'})} FROM c""",
)
def ols_2d(spark, d):
    coefs = _fit_table(_lines(spark, d), "y", ["x", "q"], ModelSpec("linear", "linear"))
    return stats.sort_rows(coefs, "magnitude", ascending=False)


@query(
    "ridge_1d",
    f"""WITH {_LINES}, v AS (SELECT count(*) * covar_pop(y, x) / (count(*) * var_pop(x) + 1e12) AS b, avg(y) AS my, avg(x) AS mx FROM o),
        c AS (SELECT 'intercept' AS feature, my - b * mx AS b FROM v UNION ALL SELECT 'x', b FROM v)
        SELECT feature, {rsql({'coefficient': 'b', 'magnitude': 'abs(b)'})} FROM c""",
)
def ridge_1d(spark, d):
    return _fit_table(_lines(spark, d), "y", ["x"], ModelSpec("ridge", "ridge", {"alpha": 1e12}))


# One-variable regression fitted on the training rows, scored on both parts.
_FIT = [
    f"s AS (SELECT *, {SPLIT_SQL.format(key='CAST(area AS VARCHAR)')} AS split FROM simple WHERE rate_a_f IS NOT NULL)",
    "b AS (SELECT regr_slope(rate_all, rate_a_f) AS k, regr_intercept(rate_all, rate_a_f) AS c FROM s WHERE split = 'train')",
    "p AS (SELECT area, split, rate_all AS label, c + k * rate_a_f AS prediction FROM s, b)",
]
_SCORES = {
    "r2": "1 - avg(power(label - prediction, 2)) {w} / var_pop(label) {w}",
    "mae": "avg(abs(label - prediction)) {w}",
    "mse": "avg(power(label - prediction, 2)) {w}",
    "rmse": "sqrt(avg(power(label - prediction, 2)) {w})",
    "mean_prediction": "avg(prediction) {w}",
}


def _one_feature(spark, d):
    rows = prepare(areas(spark, d), ["area"], "rate_all", ["rate_a_f"])
    return fit_variant(rows, ["area"], "rate_all", ["rate_a_f"], (), [ModelSpec("linear", "linear")])


@query("prediction_table", with_areas(f"SELECT area, split, {rsql({'label': 'label', 'prediction': 'prediction'})} FROM p", *_FIT))
def prediction_table(spark, d):
    return rounded(_one_feature(spark, d).predictions.drop("model"))


@query(
    "regression_metrics",
    with_areas(
        f"SELECT split, count(*) AS n, {rsql({k: v.format(w='') for k, v in _SCORES.items()})} FROM p GROUP BY split", *_FIT
    ),
)
def regression_metrics(spark, d):
    return rounded(m.regression_metrics(_one_feature(spark, d).predictions, ["split"]))


@query(
    "leader_board_linear",
    with_areas(
        "SELECT 'linear' AS model, "
        + rsql({f"{k}_{part}": v.format(w=f"FILTER (WHERE split = '{part}')") for k, v in _SCORES.items() for part in ("train", "test")})
        + " FROM p",
        *_FIT,
    ),
)
def leader_board_linear(spark, d):
    return rounded(m.leader_board(_one_feature(spark, d).predictions))


# A tree of depth 1 on a column of few values: the cut with the largest drop in squared error.
_STUMP = """g AS (SELECT l_quantity AS q, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
  w AS (SELECT q, sum(n) OVER (ORDER BY q) AS n1, sum(s) OVER (ORDER BY q) AS s1, sum(n) OVER () AS n0, sum(s) OVER () AS s0 FROM g),
  cut AS (SELECT arg_max(q, s1 * s1 / n1 + (s0 - s1) * (s0 - s1) / (n0 - n1)) AS cut_a FROM w WHERE n1 < n0),
  leaf AS (SELECT sum(s) FILTER (WHERE q <= cut_a) / sum(n) FILTER (WHERE q <= cut_a) AS low,
             sum(s) FILTER (WHERE q > cut_a) / sum(n) FILTER (WHERE q > cut_a) AS high FROM g, cut)"""


def _stump(spark, d, spec):
    lines = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    rows = f.assemble(lines, ["l_quantity"])
    model = m.fit_model(rows, "l_extendedprice", spec)
    values = f.assemble(lines.select("l_quantity").distinct(), ["l_quantity"])
    return rounded(model.transform(values).select("l_quantity", "prediction"), 4)


@query(
    "tree_stump",
    f"WITH {_STUMP} SELECT q AS l_quantity, {r('CASE WHEN q <= cut_a THEN low ELSE high END', 4)} AS prediction FROM g, cut, leaf",
)
def tree_stump(spark, d):
    return _stump(spark, d, ModelSpec("tree", "tree", {"max_depth": 1}))


# Second-order boosting with one cut a round: gradient sums over rows plus lambda, each leaf counts step times.
def _boosted_rounds(rounds: int) -> str:
    ctes = ["e0 AS (SELECT l_quantity AS q, l_extendedprice AS y, (SELECT avg(l_extendedprice) FROM lineitem) AS p FROM lineitem)"]
    for i in range(rounds):
        ctes += [
            f"g{i} AS (SELECT q, count(*) AS n, sum(CAST(round_even((y - p) / 1e-6, 0) AS BIGINT)) AS s FROM e{i} GROUP BY 1)",
            f"w{i} AS (SELECT q, sum(n) OVER (ORDER BY q) AS n1, CAST(sum(s) OVER (ORDER BY q) AS DOUBLE) AS s1, sum(n) OVER () AS n0, CAST(sum(s) OVER () AS DOUBLE) AS s0 FROM g{i})",
            f"c{i} AS (SELECT arg_max(q, s1 * s1 / (n1 + 1) + (s0 - s1) * (s0 - s1) / (n0 - n1 + 1)) AS cut FROM w{i} WHERE n1 < n0)",
            f"""l{i} AS (SELECT cut, sum(s) FILTER (WHERE q <= cut) * 1e-6 / (sum(n) FILTER (WHERE q <= cut) + 1) AS low,
                  sum(s) FILTER (WHERE q > cut) * 1e-6 / (sum(n) FILTER (WHERE q > cut) + 1) AS high FROM g{i}, c{i} GROUP BY cut)""",
            f"e{i + 1} AS (SELECT q, y, p + 0.3 * CASE WHEN q <= cut THEN low ELSE high END AS p FROM e{i}, l{i})",
        ]
    return "WITH " + ", ".join(ctes) + f" SELECT DISTINCT q AS l_quantity, {r('p', 4)} AS prediction FROM e{rounds}"


@query("boosted_stumps", _boosted_rounds(2))
def boosted_stumps(spark, d):
    return _stump(spark, d, ModelSpec("boosted", "boosted", {"rounds": 2, "max_depth": 1, "step": 0.3}))


# -- trees on all features, against SQL that grows them level by level ------------------

_TREES = {
    "tree": ModelSpec("tree", "tree", {"max_depth": 3}, scaled=False),
    "forest": ModelSpec("forest", "forest", scaled=False),
    "boosted": ModelSpec("boosted", "boosted"),
    "small_forest": ModelSpec("small_forest", "forest", {"trees": 4, "max_depth": 4}, scaled=False),
    # Sizes of the two paths: nodes above 100 rows are split on Spark.
    "spread_forest": ModelSpec("spread_forest", "forest", {"trees": 4, "max_depth": 4, "local_rows": 100}, scaled=False),
}
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in NUMERIC)
_X = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in NUMERIC) + "]"
_ROWS = [
    f"a AS (SELECT *, {SPLIT_SQL.format(key='CAST(area AS VARCHAR)')} AS split FROM simple WHERE rate_all IS NOT NULL AND {_COMPLETE})",
    f"""u AS (SELECT area, split, rate_all AS label, {_X} AS x, CAST(split = 'train' AS BIGINT) AS trains,
          CASE WHEN split = 'train' THEN CAST(round_even(rate_all / 1e-6, 0) AS BIGINT) ELSE 0 END AS s FROM a)""",
    "single AS (SELECT 0 AS t, area AS r, trains AS w, s, x, '1' AS node FROM u)",
    f"many AS (SELECT t, area AS r, trains * ({poisson_sql('CAST(area AS VARCHAR)', 'CAST(t AS VARCHAR)')}) AS w, s, x, '1' AS node FROM u, (SELECT unnest(range(4)) AS t))",
    "names AS (SELECT unnest(range(" + str(len(NUMERIC)) + ")) AS f, unnest([" + ", ".join(f"'{c}'" for c in NUMERIC) + "]) AS feature)",
]


def _shares(p: str, depth: int) -> str:
    """Mean over the trees of each feature's share of the gain."""
    return f"""SELECT feature, {r('coalesce(share / (SELECT count(DISTINCT t) FROM won), 0)')} AS importance FROM names LEFT JOIN (
        SELECT f, sum(part) AS share FROM (SELECT t, f, sum(won) / sum(sum(won)) OVER (PARTITION BY t) AS part FROM won GROUP BY t, f) GROUP BY f) USING (f)
      """


def _area_rows(spark, d):
    return prepare(areas(spark, d), ["area"], "rate_all", NUMERIC)


def _importance(spark, d, kind):
    fitted = fit_variant(_area_rows(spark, d), ["area"], "rate_all", NUMERIC, (), [_TREES[kind]])
    table_ = m.importances(fitted.models[_TREES[kind].name], fitted.feature_names[_TREES[kind].name])
    return rounded(stats.top_k(table_, "importance", 20, ties=["feature"]))


@query("tree_importance", with_areas(_shares("k", 3), *_ROWS, *grow_sql("k", "single", 3, len(NUMERIC)), f"won AS ({splits_sql('k', 3)})"))
def tree_importance(spark, d):
    return _importance(spark, d, "tree")


_FOREST = [*_ROWS, *grow_sql("k", "many", 4, len(NUMERIC)), f"won AS ({splits_sql('k', 4)})"]


@query("small_forest_importance", with_areas(_shares("k", 4), *_FOREST))
def small_forest_importance(spark, d):
    return _importance(spark, d, "small_forest")


@query("spread_forest_importance", with_areas(_shares("k", 4), *_FOREST))
def spread_forest_importance(spark, d):
    """The same forest, its larger nodes split by Spark."""
    return _importance(spark, d, "spread_forest")


@query("forest_importance")
def forest_importance(spark, d):
    return _importance(spark, d, "forest")


@query("boosted_importance")
def boosted_importance(spark, d):
    return _importance(spark, d, "boosted")


def _scores(spark, d, *kinds):
    return fit_variant(_area_rows(spark, d), ["area"], "rate_all", NUMERIC, (), [_TREES[k] for k in kinds])


_BOARD = [
    *_FOREST,
    *grow_sql("o", "single", 3, len(NUMERIC)),
    f"""p AS (SELECT model, split, label, prediction FROM u JOIN (
          SELECT 'tree' AS model, r, value AS prediction FROM ({leaves_sql('o', 3)})
          UNION ALL SELECT 'spread_forest', r, avg(value) FROM ({leaves_sql('k', 4)}) GROUP BY r) ON area = r)""",
]


@query(
    "leader_board_trees",
    with_areas(
        "SELECT model, "
        + rsql({f"{k}_{part}": v.format(w=f"FILTER (WHERE split = '{part}')") for k, v in _SCORES.items() for part in ("train", "test")})
        + " FROM p GROUP BY model",
        *_BOARD,
    ),
)
def leader_board_trees(spark, d):
    """A board of two models."""
    return rounded(m.leader_board(_scores(spark, d, "tree", "spread_forest").predictions))


# A tree without a stated depth, on its test rows; SQL grows more levels than it has.
_DEEP = 26


@query(
    "tree_predictions",
    with_areas(
        f"SELECT area, split, {r('value')} AS prediction FROM u JOIN ({leaves_sql('o', _DEEP)}) ON area = r",
        *_ROWS,
        *grow_sql("o", "single", _DEEP, len(NUMERIC)),
    ),
)
def tree_predictions(spark, d):
    spec = ModelSpec("tree", "tree", scaled=False)
    return rounded(fit_variant(_area_rows(spark, d), ["area"], "rate_all", NUMERIC, (), [spec]).predictions.select("area", "split", "prediction"))


# Boosting on four features of few values: the cut points are all of them.
_FEW = ["micro", "small", "medium", "large"]
_FEW_X = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in _FEW) + "]"


def _boosted_sql(rounds: int, depth: int) -> list[str]:
    key = SPLIT_SQL.format(key="CAST(area AS VARCHAR)")
    ctes = [
        f"a AS (SELECT area, {key} AS split, rate_all AS label, {_FEW_X} AS x FROM simple WHERE rate_all IS NOT NULL)",
        """f0 AS (SELECT *, CAST(split = 'train' AS BIGINT) AS w,
             (SELECT CAST(sum(CAST(round_even(label / 1e-6, 0) AS BIGINT)) AS DOUBLE) / count(*) * 1e-6 FROM a WHERE split = 'train') AS p FROM a)""",
    ]
    for i in range(rounds):
        ctes.append(
            f"""h{i} AS (SELECT 0 AS t, area AS r, w, CASE WHEN w = 1 THEN CAST(round_even((label - p) / 1e-6, 0) AS BIGINT) ELSE 0 END AS s,
                  x, '1' AS node FROM f{i})"""
        )
        ctes += grow_sql(f"t{i}_", f"h{i}", depth, len(_FEW), 1.0, 0.0)
        ctes.append(
            f"f{i + 1} AS MATERIALIZED (SELECT area, split, label, x, w, p + 0.3 * value AS p FROM f{i} JOIN ({leaves_sql(f't{i}_', depth, '1e-6', 1.0)}) ON area = r)"
        )
    return ctes


@query("boosted_trees", with_areas(f"SELECT area, split, {r('p')} AS prediction FROM f3", *_boosted_sql(3, 2)))
def boosted_trees(spark, d):
    """Three rounds of boosted trees of depth 2."""
    spec = ModelSpec("boosted", "boosted", {"rounds": 3, "max_depth": 2}, scaled=False)
    rows = prepare(areas(spark, d), ["area"], "rate_all", _FEW)
    return rounded(fit_variant(rows, ["area"], "rate_all", _FEW, (), [spec]).predictions.select("area", "split", "prediction"))


def _one_hot_coefficients(spark, d, kind, cats):
    profile = areas_by_class(areas(spark, d))
    rows = prepare(profile, ["area", "class"], "rate_all", NUMERIC, cats)
    fitted = fit_variant(rows, ["area", "class"], "rate_all", NUMERIC, cats, [ModelSpec(kind, kind)])
    return rounded(stats.top_k(m.coefficients(fitted.models[kind], fitted.feature_names[kind], spark), "magnitude", 20, ties=["feature"]))


# Firms are the sum of the sizes and departments lie in regions: least squares has no single answer
# on these columns, so the figures below are one of many. `ols_within_groups` has a single one.
@query("ols_coefficients_one_hot")
def ols_coefficients_one_hot(spark, d):
    return _one_hot_coefficients(spark, d, "linear", ["class", "reg_no", "dep"])


@query("ridge_coefficients_one_hot")
def ridge_coefficients_one_hot(spark, d):
    return _one_hot_coefficients(spark, d, "ridge", ["class", "reg_no", "dep"])


# One number and one category: the slope is the one within the groups, the category columns are the
# differences of the groups' remaining means to the first group's.
_WITHIN = (
    "o AS (SELECT rate_all AS y, rate_a_f AS x, dep FROM simple WHERE rate_a_f IS NOT NULL)",
    "g AS (SELECT dep, avg(y) AS my, avg(x) AS mx, covar_pop(x, y) * count(*) AS xy, var_pop(x) * count(*) AS xx FROM o GROUP BY dep)",
    "k AS (SELECT sum(xy) / sum(xx) AS slope FROM g)",
    "i AS (SELECT dep, my - slope * mx AS level FROM g, k)",
    "z AS (SELECT arg_min(level, dep) AS base, min(dep) AS first FROM i)",
)


@query(
    "ols_within_groups",
    with_areas(
        f"""SELECT feature, {rsql({'coefficient': 'b', 'magnitude': 'abs(b)'})} FROM (
            SELECT 'rate_a_f' AS feature, slope AS b FROM k UNION ALL SELECT 'intercept', base FROM z
            UNION ALL SELECT 'dep_vec_' || dep, level - base FROM i, z WHERE dep <> first)""",
        *_WITHIN,
    ),
)
def ols_within_groups(spark, d):
    """Least squares on a number and a one-hot category."""
    rows = prepare(areas(spark, d), ["area"], "rate_all", ["rate_a_f"], ["dep"])
    data = f.assemble(f.fit_one_hot(rows, ["dep"]).vector(rows), ["rate_a_f", "dep_vec"])
    return rounded(m.coefficients(m.fit_model(data, "rate_all", ModelSpec("linear", "linear")), f.vector_names(data), spark))


@query(
    "tree_full_depth",
    f"SELECT l_quantity, {r('avg(l_extendedprice)', 4)} AS prediction FROM lineitem GROUP BY 1",
)
def tree_full_depth(spark, d):
    """A tree without a stated depth tells every value of a column apart."""
    return _stump(spark, d, ModelSpec("tree", "tree"))


@query("model_comparison")
def model_comparison_query(spark, d):
    profile = areas_by_class(areas(spark, d))
    board = model_comparison(profile, ["area", "class"], "rate_all", NUMERIC, ["class", "reg_no", "dep"])
    return rounded(board)


