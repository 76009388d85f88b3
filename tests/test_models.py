import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from areastats.operators import features as f
from areastats.operators import models as m
from areastats.operators import reduce as x
from areastats.operators.models import ModelSpec
from areastats.plans.leaderboard import fit_variant, model_comparison, prepare

RNG = np.random.default_rng(3)


# -- features -----------------------------------------------------------------


def test_scaling_is_learnt_on_train_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, same double")
    test = spark.createDataFrame([(5.0, 6.0)], "a double, same double")
    assert rows(f.standard_scaling(train, ["a", "same"]).apply(test)) == [(3.0, 1.0)]
    assert rows(f.minmax_scaling(train, ["a", "same"]).apply(test)) == [(2.0, 1.0)]
    scaled = f.standard_scaling(train, ["a"]).apply(train).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert tuple(scaled) == (0.0, 1.0)


def test_one_hot_order_and_unseen(spark):
    df = spark.createDataFrame([("2", 10), ("10", 2), ("3", 2)], "t string, n int")
    coder = f.fit_one_hot(df, ["t", "n"])
    assert coder.names() == ["t_2", "t_3", "n_10"]  # text sorts as text, numbers as numbers
    assert rows(coder.columns(df).select("t_2", "t_3", "n_10")) == [(0, 0, 0), (0, 1, 0), (1, 0, 1)]
    new = spark.createDataFrame([("9", 2)], "t string, n int")
    with pytest.raises(Exception, match="unseen category"):
        coder.columns(new).collect()
    assert rows(coder.columns(new, unknown="zero").select("t_2", "t_3", "n_10")) == [(0, 0, 0)]
    vec = f.assemble(coder.vector(df), ["t_vec", "n_vec"]).select(vector_to_array("features"))
    assert sorted(r[0] for r in vec.collect()) == [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 1.0]]
    assert f.vector_names(f.assemble(coder.vector(df), ["t_vec", "n_vec"])) == ["t_vec_2", "t_vec_3", "n_vec_10"]
    zero = f.assemble(coder.vector(new, "zero"), ["t_vec", "n_vec"]).select(vector_to_array("features"))
    assert zero.first()[0] == [0.0, 0.0, 0.0]
    with pytest.raises(Exception):
        coder.vector(new).collect()
    with pytest.raises(ValueError):
        f.fit_one_hot(df, ["t"], max_categories=2)


def test_hash_split_is_stable_and_near_its_share(spark):
    df = spark.range(4000)
    a = {r["id"]: r["split"] for r in f.hash_split(df, "id").collect()}
    b = {r["id"]: r["split"] for r in f.hash_split(df.repartition(13), "id").collect()}
    assert a == b
    assert 0.22 < sum(v == "test" for v in a.values()) / 4000 < 0.28


# -- components and clusters --------------------------------------------------


@pytest.fixture(scope="module")
def points():
    base = RNG.normal(size=(60, 2))
    noise = RNG.normal(size=60) * 0.5
    return np.c_[base[:, 0], base[:, 0] * 2 + base[:, 1] + noise, base[:, 1], RNG.normal(size=60)]


def test_components_match_numpy(spark, points):
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(pd.DataFrame(points, columns=cols).assign(id=range(60)))
    z = (points - points.mean(0)) / points.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = x.principal_components(df, cols)
    explained = [r["explained"] for r in got.variance().orderBy("axis").collect()]
    assert explained == pytest.approx(values / values.sum())
    assert sum(explained) == pytest.approx(1) and explained == sorted(explained, reverse=True)
    loads = got.loadings().toPandas().pivot(index="metric", columns="axis", values="loading").loc[cols].to_numpy()
    for k in range(4):
        sign = np.sign(vectors[:, k] @ loads[:, k])
        assert loads[:, k] == pytest.approx(sign * vectors[:, k], abs=1e-9)
        assert loads[np.argmax(np.abs(loads[:, k])), k] > 0
    scores = got.scores(["id"]).toPandas().sort_values("id").drop(columns="id").to_numpy()
    assert scores == pytest.approx(z @ loads, abs=1e-9)
    circle = got.circle().toPandas().pivot(index="metric", columns="axis", values="correlation").loc[cols].to_numpy()
    want = np.array([[np.corrcoef(z[:, i], scores[:, k])[0, 1] for k in range(4)] for i in range(4)])
    assert circle == pytest.approx(want, abs=1e-6)


def test_clusters_find_separated_groups(spark):
    centres = [(0, 0), (20, 0), (0, 20), (20, 20)]
    data = [(g * 10 + i, float(cx + RNG.normal()), float(cy + RNG.normal())) for g, (cx, cy) in enumerate(centres) for i in range(10)]
    df = spark.createDataFrame(data, "id int, x double, y double")
    got = x.cluster_rows(df, ["x", "y"], k=4, n_init=4)
    labels = {r["id"]: r["cluster"] for r in got.labels("id").collect()}
    assert all(len({labels[g * 10 + i] for i in range(10)}) == 1 for g in range(4))
    assert rows(got.sizes()) == [(c, 10) for c in range(4)]
    assert got.profile().count() == 4
    scaled = x.cluster_rows(df, ["x", "y"], k=4, n_init=4, scale=True)
    assert scaled.labelled.columns == ["id", "x", "y", "distance", "cluster"]
    curve = [r["distortion"] for r in x.elbow(df, ["x", "y"], (2, 3, 4, 5), n_init=3).orderBy("k").collect()]
    assert all(a >= b for a, b in zip(curve, curve[1:]))


def test_nearest_centre(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0), (5.0, 0.0)], "x double, y double")
    got = x.assign_centres(df, ["x", "y"], [[0, 0], [10, 0]])
    assert rows(got.select("x", "distance", "cluster"), "x") == [(0.0, 0.0, 0), (3.0, 5.0, 0), (5.0, 5.0, 0)]
    assert rows(x.distortion(df, ["x", "y"], [[0, 0], [10, 0]])) == [(pytest.approx(10 / 3),)]


# -- regression ---------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    n = 400
    a, b = RNG.normal(size=n), RNG.normal(size=n)
    g = RNG.integers(0, 3, n)
    y = 3 + 2 * a - b + np.array([0, 4, 9])[g] + 0.1 * RNG.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "a": a, "b": b, "g": g, "y": y}))


def test_linear_and_ridge_match_closed_form(spark, table):
    pdf = table.toPandas()
    X, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()
    rows_ = f.assemble(table, ["a", "b"])
    for spec, alpha in ((ModelSpec("l", "linear"), 0.0), (ModelSpec("r", "ridge", {"alpha": 50.0}), 50.0)):
        model = m.fit_model(rows_, "y", spec)
        Xc, yc = X - X.mean(0), y - y.mean()
        want = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(2), Xc.T @ yc)
        assert model.coefficients.toArray() == pytest.approx(want, rel=1e-9)
        assert model.intercept == pytest.approx(y.mean() - X.mean(0) @ want, rel=1e-9)
        got = m.coefficients(model, ["a", "b"], spark).collect()
        assert [r["feature"] for r in got] == ["intercept", "a", "b"]


def test_coefficients_in_original_units(spark):
    df = spark.createDataFrame([(1e6 + i, float(i % 7), 5 + 3 * (1e6 + i) - 2 * (i % 7)) for i in range(50)], "a double, b double, y double")
    scaling = f.standard_scaling(df, ["a", "b"])
    model = m.fit_model(f.assemble(scaling.apply(df), ["a", "b"]), "y", ModelSpec("l", "linear"))
    got = {r["feature"]: r["coefficient"] for r in m.coefficients(model, ["a", "b"], spark, scaling).collect()}
    assert got == {"intercept": pytest.approx(5, abs=1e-3), "a": pytest.approx(3), "b": pytest.approx(-2)}


def test_settings_are_checked(table):
    rows_ = f.assemble(table, ["a"])
    with pytest.raises(ValueError):
        m.fit_model(rows_, "y", ModelSpec("x", "spline"))
    with pytest.raises(ValueError):
        m.fit_model(rows_, "y", ModelSpec("x", "tree", {"leaves": 3}))


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "label double, prediction double")
    r = m.regression_metrics(df).first()
    assert (r["n"], r["mae"], r["mse"]) == (3, 1.0, pytest.approx(5 / 3))
    assert r["r2"] == pytest.approx(1 - 5 / 2)
    assert r["rmse"] == pytest.approx((5 / 3) ** 0.5) and r["mean_prediction"] == 3.0


def test_leader_board(table):
    tree = ModelSpec("tree", "tree", {"max_depth": 3})
    forest = ModelSpec("forest", "forest", {"trees": 8, "max_depth": 4})
    boosted = ModelSpec("boosted", "boosted", {"rounds": 8, "max_depth": 3})
    board = model_comparison(
        table, ["id"], "y", ["a", "b"], ["g"],
        [ModelSpec("linear", "linear"), tree, forest, boosted],
        [ModelSpec("ridge", "ridge"), tree, forest, boosted],
    )
    got = {(r["variant"], r["model"]): r for r in board.collect()}
    assert len(got) == 8
    for r in got.values():
        assert 0 <= r["r2_train"] <= 1 and r["rmse_test"] == pytest.approx(r["mse_test"] ** 0.5)
    assert got["one_hot", "ridge"]["r2_test"] > 0.99 > got["numeric", "linear"]["r2_test"]
    assert got["numeric", "linear"]["r2_train"] == max(0, got["numeric", "linear"]["r2_train"])


def test_importances_are_named_from_the_features(spark, table):
    rows_ = prepare(table, ["id"], "y", ["a", "b"], ["g"])
    fitted = fit_variant(rows_, ["id"], "y", ["a", "b"], ["g"], [ModelSpec("tree", "tree", {"max_depth": 4})])
    names = fitted.feature_names["tree"]
    assert names == ["a_scaled", "b_scaled", "g_vec_1", "g_vec_2"]
    got = {r["feature"]: r["importance"] for r in m.importances(fitted.models["tree"], names).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["g_vec_2"] > got["b_scaled"]
    assert fitted.predictions.count() == 400


def test_each_model_has_its_own_inputs(table):
    rows_ = prepare(table, ["id"], "y", ["a", "b"])
    specs = [
        ModelSpec("scaled", "tree", {"max_depth": 3}),
        ModelSpec("raw", "tree", {"max_depth": 3}, scaled=False),
        ModelSpec("no_b", "linear", without=("b",)),
    ]
    fitted = fit_variant(rows_, ["id"], "y", ["a", "b"], (), specs)
    assert fitted.feature_names == {"scaled": ["a_scaled", "b_scaled"], "raw": ["a", "b"], "no_b": ["a_scaled"]}
    got = fitted.predictions.groupBy("id").pivot("model", ["scaled", "raw"]).agg(F.max("prediction"))
    assert got.where("abs(scaled - raw) > 1e-9").count() == 0  # a tree does not mind the scale


def test_incomplete_rows_are_left_out_before_the_split(spark):
    df = spark.createDataFrame([(1, "2.5", 1.0), (2, "x", 1.0), (3, "4", None), (4, "5", 2.0)], "id int, a string, y double")
    assert rows(prepare(df, ["id"], "y", ["a"]).select("id", "a", "y")) == [(1, 2.5, 1.0), (4, 5.0, 2.0)]


def test_one_hot_of_many_categories(spark):
    df = spark.range(3000).selectExpr("concat('c', id % 400) AS t", "id")
    coder = f.fit_one_hot(df, ["t"])
    out = coder.columns(df)
    total = F.aggregate(F.array(*coder.names()), F.lit(0), lambda s, v: s + v)
    got = out.select("t", total.alias("ones")).groupBy("ones").agg(F.count_distinct("t").alias("k")).collect()
    assert {r.ones: r.k for r in got} == {1: 399, 0: 1}


def test_dictionary_of_many_categories(spark):
    """100,000 categories, one of which a third of the rows have."""
    df = spark.range(200_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'c7' ELSE concat('c', id % 100000) END AS t", "id")
    codes = f.category_codes(df, "t")
    plan = codes._jdf.queryExecution().toString()
    assert "collect_set" not in plan and codes.count() == df.select("t").distinct().count()
    order = [r[0] for r in codes.orderBy("code").collect()]
    assert order == sorted(order) and len(set(order)) == len(order) > 99_000
    at = {v: i for i, v in enumerate(order)}
    got = f.coded_vector(df, "t", codes).where("id % 997 < 3")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert r.t_vec.size == len(order) - 1 and list(r.t_vec.indices) == [i - 1 for i in [at[r.t]] if i]


def test_dictionary_vectors_agree_with_the_encoder(spark):
    df = spark.createDataFrame([("2", 10), ("10", 2), ("3", 2), ("3", 7)], "t string, n int")
    for c in ("t", "n"):
        same = f.fit_one_hot(df, [c]).vector(df).withColumnRenamed(f"{c}_vec", "want")
        both = f.coded_vector(same, c, f.category_codes(df, c)).select("want", f"{c}_vec").collect()
        assert len(both) == 4 and all(a == b for a, b in both)
    codes = f.category_codes(df, "t")
    new = spark.createDataFrame([("9",), (None,), ("3",)], "t string")
    got = f.coded_vector(new, "t", codes, unknown="zero").collect()
    assert {(r.t, tuple(r.t_vec.toArray())) for r in got} == {("9", (0, 0)), (None, (0, 0)), ("3", (0, 1))}
    with pytest.raises(Exception, match="unseen category in t"):
        f.coded_vector(new, "t", codes).collect()
    empty = f.category_codes(df.limit(0), "t")
    assert empty.count() == 0 and f.coded_vector(new, "t", empty, unknown="zero").first().t_vec.size == 0
    with pytest.raises(ValueError):
        f.fit_one_hot(df, ["t", "n"], max_categories=2)
