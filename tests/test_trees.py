"""Trees against brute force, and both ways of growing them against each other."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from areastats.operators import features as f
from areastats.operators import trees
from areastats.operators.least_squares import least_squares
from areastats.operators.trees import Growth
from areastats.sources import tables


def brute_tree(x, y, w, growth, depth=0):
    """A function from a row to its prediction, by trying every cut of every feature."""
    n, s = w.sum(), (w * y).sum()
    leaf = s * growth.unit / (n + growth.reg_lambda)
    own = y[w > 0]
    best = None
    if len(own) and (growth.gamma is not None or own.min() < own.max()) and (growth.max_depth is None or depth < growth.max_depth):
        for k in range(x.shape[1]):
            values = np.unique(x[w > 0, k])
            for a, b in zip(values, values[1:]):
                left = x[:, k] <= a
                nl, sl = (w * left).sum(), (w * y * left).sum()
                gain = sl * sl / (nl + growth.reg_lambda) + (s - sl) * (s - sl) / (n - nl + growth.reg_lambda)
                if nl >= growth.min_child and n - nl >= growth.min_child and (best is None or gain > best[0]):
                    best = (gain, k, (a + b) / 2)
    if best is None or (growth.gamma is not None and best[0] - s * s / (n + growth.reg_lambda) <= growth.gamma / growth.unit**2):
        return lambda row: leaf
    _, k, cut = best
    low, high = (brute_tree(x[m], y[m], w[m], growth, depth + 1) for m in (x[:, k] <= cut, x[:, k] > cut))
    return lambda row: low(row) if row[k] <= cut else high(row)


def tree_table(spark, x, y, trains):
    rows = [(i, f"k{i}", [float(v) for v in x[i]], float(y[i]), bool(trains[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "row long, key string, x array<double>, y double, trains boolean").repartition(3)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(12)
    x = np.c_[rng.integers(0, 9, 160), rng.normal(size=160).round(1), np.ones(160), rng.integers(0, 2, 160)].astype(float)
    y = (x[:, 0] * 3 + np.where(x[:, 1] > 0, 5, 0) + rng.normal(size=160)).round(4)
    return x, y, rng.random(160) < 0.75


@pytest.mark.parametrize("local_rows", [10**6, 40])
@pytest.mark.parametrize("growth", [Growth(max_depth=3), Growth(), Growth(max_depth=5, min_child=7.0), Growth(max_depth=4, reg_lambda=2.0, gamma=40.0)])
def test_a_tree_against_brute_force(spark, made, growth, local_rows):
    x, y, trains = made
    growth = Growth(**{**growth.__dict__, "local_rows": local_rows})
    model = brute_tree(x, np.rint(y / growth.unit), trains.astype(int), growth)
    got = {r.row: r.prediction for r in trees.predictions(trees.grow(tree_table(spark, x, y, trains), growth)).collect()}
    assert got == {i: pytest.approx(model(x[i])) for i in range(len(x))}


def test_a_forest_draws_the_same_rows_either_way(spark, made):
    x, y, trains = made
    table = tree_table(spark, x, y, trains)
    small, spread = (Growth(trees=3, bootstrap=True, max_depth=4, local_rows=n) for n in (10**6, 30))
    want = np.zeros(len(x))
    for t in range(3):
        w = trees.weights_here([f"k{i}" for i in range(len(x))], trains, t, small)
        model = brute_tree(x, np.rint(y / small.unit), w, small)
        want += [model(row) / 3 for row in x]
    for growth in (small, spread):
        grown = trees.grow(table, growth)
        assert {r.row: r.prediction for r in trees.predictions(grown).collect()} == {i: pytest.approx(v) for i, v in enumerate(want)}
    parts = [
        {r.feature: r.importance for r in trees.feature_importances(trees.grow(table, g), g, list("abcd")).collect()} for g in (small, spread)
    ]
    assert parts[0] == pytest.approx(parts[1]) and sum(parts[0].values()) == pytest.approx(1) and parts[0]["c"] == 0


@pytest.mark.parametrize("local_rows", [10**6, 50])
def test_boosting_against_brute_force(spark, made, local_rows):
    x, y, trains = made
    growth = Growth(rounds=3, max_depth=2, reg_lambda=1.0, gamma=0.0, local_rows=local_rows)
    out = np.full(len(x), np.rint(y / growth.unit)[trains].mean() * growth.unit)
    for _ in range(3):
        model = brute_tree(x, np.rint((y - out) / growth.unit), trains.astype(int), growth)
        out = out + growth.step * np.array([model(row) for row in x])
    got = {r.row: r.prediction for r in trees.predictions(trees.grow(tree_table(spark, x, y, trains), growth)).collect()}
    # Cut points are those of the training rows, so a row between two of them may fall on the other side.
    assert sum(abs(got[i] - v) < 1e-6 for i, v in enumerate(out) if trains[i]) == trains.sum()
    assert len(got) == len(x)


@pytest.mark.parametrize("growth", [Growth(max_depth=3), Growth(), Growth(max_depth=4, min_child=7.0, reg_lambda=2.0, gamma=40.0)])
def test_cells_of_many_values_against_brute_force(spark, made, growth, monkeypatch):
    monkeypatch.setattr(trees, "CELLS", 4)
    monkeypatch.setattr(trees, "BLOCK", 30)
    x, y, trains = made
    growth = Growth(**{**growth.__dict__, "local_rows": 25})
    model = brute_tree(x, np.rint(y / growth.unit), trains.astype(int), growth)
    got = {r.row: r.prediction for r in trees.predictions(trees.grow(tree_table(spark, x, y, trains), growth)).collect()}
    assert got == {i: pytest.approx(model(x[i])) for i in range(len(x))}


def test_few_cells_are_searched_and_the_best_cut_is_in_one():
    """What moves for an exact cut is a small part of a large node's values."""
    rng = np.random.default_rng(3)
    x, growth = rng.random((40000, 3)), Growth()
    s = np.rint((2000 + 30 * (x[:, 1] > 0.437) + rng.normal(0, 20, 40000)) * 1e6).astype(np.int64)
    cuts = [np.quantile(x[:, f], np.arange(1, 256) / 256) for f in range(3)]
    cells = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
    starts, centre = trees.cell_starts(cuts), round(s.mean())
    sums = trees.histograms(np.zeros(len(x), int), 1, cells, starts, np.ones(len(x), np.int64), s, np.array([centre]))
    total, open_ = trees.cells_to_search(sums[0], centre, starts, growth)
    gains = []
    for f in range(3):
        order = np.argsort(x[:, f])
        n, run = np.arange(1, len(x)), np.cumsum(s[order].astype(float))
        gain = run[:-1] ** 2 / n + (run[-1] - run[:-1]) ** 2 / (len(x) - n)
        gains.append((gain.max(), f, cells[order, f][gain.argmax()]))
    assert max(gains)[1:] in {(f, cell) for f, cell, *_ in open_} and len(open_) < 20
    assert total[0] == len(x) and total[1] * 2**trees.SHIFT + total[2] == s.sum()


@pytest.mark.parametrize("growth", [Growth(), Growth(min_child=5.0), Growth(max_depth=6, reg_lambda=2.0, gamma=3.0)])
def test_a_feature_is_sorted_once(made, growth, monkeypatch):
    x, y, trains = made
    rng = np.random.default_rng(4)
    x, s = np.c_[x, rng.normal(size=len(x)), rng.normal(size=len(x)).round(2)], np.rint(y / growth.unit)
    w, sorts, argsort = rng.poisson(1, len(x)) * trains, [], np.argsort
    coded, model = trees.Codes.of(x), brute_tree(x, s, w, growth)
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or argsort(*a, **b))
    leaf, n, sums, _ = trees.grow_here(coded, w, s, growth)
    assert len(sorts) <= x.shape[1]
    assert list((sums * growth.unit / (n + growth.reg_lambda))[leaf]) == [pytest.approx(model(row)) for row in x]


def test_no_wave_takes_more_rows_than_stated(monkeypatch):
    monkeypatch.setattr(trees, "WAVE", 1000)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 300)
    small = {(t, n): (3, 40 + 37 * (t * 7 + n) % 260) for t in range(20) for n in range(9)}
    found = trees.waves(small)
    assert sorted(key for tasks in found for task in tasks for key in task) == sorted(small) and len(found) > 10
    assert max(sum(small[key][1] for task in tasks for key in task) for tasks in found) <= 1000
    assert max(sum(small[key][1] for key in task) for tasks in found for task in tasks) <= 300


def test_a_forest_in_waves_leaves_only_its_sums(spark, made, monkeypatch, tmp_path):
    monkeypatch.setattr(trees, "WAVE", 150)
    x, y, trains = made
    x, y, trains = np.tile(x, (3, 1)), np.tile(y, 3), np.tile(trains, 3)
    growth = Growth(trees=5, bootstrap=True, local_rows=60)
    want = np.zeros(len(x))
    for t in range(5):
        model = brute_tree(x, np.rint(y / growth.unit), trees.weights_here([f"k{i}" for i in range(len(x))], trains, t, growth), growth)
        want += [model(row) / 5 for row in x]
    # Rows in several spans, some that only train.
    row = F.col("row") * 1000 - F.when(F.col("trains") & (F.col("row") % 5 == 0), 10**7).otherwise(0)
    table = tree_table(spark, x, y, trains).withColumn("row", row)
    monkeypatch.setattr(tables, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    grown = trees.grow(table, growth)
    found = {r.row: r.prediction for r in trees.predictions(grown).collect()}
    assert found == {i * 1000: pytest.approx(v) for i, v in enumerate(want) if not (trains[i] and i % 5 == 0)}
    left = [p.name for p in tmp_path.iterdir()]
    assert len(left) == 1 and left[0].startswith("tree-sums")
    assert grown.where("feature < 0").count() == len(found)  # not a row for each tree


def test_label_sums_beyond_a_long(spark):
    """The sum of the prices of a few hundred million lines, in millionths, is one."""
    rows = [(i, "k", [float(i % 2)], 4e12 + i % 2, True) for i in range(6)]
    table = spark.createDataFrame(rows, "row long, key string, x array<double>, y double, trains boolean")
    for growth in (Growth(local_rows=2), Growth(rounds=1, max_depth=1, local_rows=2)):
        got = {r.row: r.prediction for r in trees.predictions(trees.grow(table, growth)).collect()}
        assert got == {i: pytest.approx(4e12 + (i % 2 if not growth.rounds else 0.35 + 0.3 * (i % 2)), abs=0.2) for i in range(6)}


def test_large_boosted_trees_take_one_job_a_level(spark, made):
    x, y, trains = made
    growth = Growth(rounds=4, max_depth=3, reg_lambda=1.0, gamma=0.0, local_rows=50)
    table, cuts = tree_table(spark, x, y, trains), [[float(v) for v in np.unique(x[:, f])] for f in range(4)]
    spark.sparkContext.setJobGroup("boosting", "")
    try:
        trees.predictions(trees.grow(table, growth, len(x), cuts)).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) <= 4 * 3 + 10


def test_few_histograms_take_no_second_stage(spark, made, monkeypatch):
    x, y, trains = made
    growth = Growth(rounds=3, max_depth=3, reg_lambda=1.0, gamma=0.0, local_rows=50)
    table, cuts = tree_table(spark, x, y, trains), [[float(v) for v in np.unique(x[:, f])] for f in range(4)]
    found, two_stages = [], []
    for bytes_ in (trees.COLLECTED, 0):
        monkeypatch.setattr(trees, "COLLECTED", bytes_)
        spark.sparkContext.setJobGroup(f"boosting-{bytes_}", "")
        try:
            found.append({r.row: r.prediction for r in trees.predictions(trees.grow(table, growth, len(x), cuts)).collect()})
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup(f"boosting-{bytes_}")]
        two_stages.append(sum(len(j.stageIds) > 1 for j in jobs))
    assert found[0] == found[1] and len(found[0]) == len(x)
    assert two_stages[1] - two_stages[0] == 3 * 3


def test_a_level_on_few_values_is_one_pass(spark):
    """Nothing but histograms is needed where a cell holds one value."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 32, 1500).astype(float)[:, None], rng.normal(size=1500).round(3)
    table, growth = tree_table(spark, x, y, np.ones(1500, bool)), Growth(local_rows=3)
    spark.sparkContext.setJobGroup("few values", "")
    try:
        grown = trees.grow_on_spark(table.withColumn("s", F.rint(F.col("y") / growth.unit).cast("long")), growth, 1500)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few values"))
    means = pd.Series(y).groupby(x[:, 0]).mean()
    assert {r.row: r.prediction for r in trees.predictions(grown).collect()} == {i: pytest.approx(means[v]) for i, v in enumerate(x[:, 0])}
    depth = deepest(x[:, 0], np.rint(y / growth.unit), set(x[:, 0]))
    assert jobs <= depth + 12  # sizes, histograms and values in passes of their own took 3 a level


def deepest(x, y, values):
    """Levels of the tree that tells all values apart."""
    if len(values) == 1:
        return 1
    cuts = sorted(values)[:-1]
    gains = [y[x <= c].sum() ** 2 / (x <= c).sum() + y[x > c].sum() ** 2 / (x > c).sum() for c in cuts]
    cut = cuts[int(np.argmax(gains))]
    return 1 + max(deepest(x[m], y[m], set(x[m])) for m in (x <= cut, x > cut))


def test_rows_that_only_train_get_no_prediction(spark, made):
    x, y, trains = made
    table = tree_table(spark, x, y, trains)
    both = table.withColumn("row", F.when(F.col("trains"), -1 - F.col("row")).otherwise(F.col("row")))
    for growth in (Growth(max_depth=2), Growth(max_depth=3, local_rows=50), Growth(rounds=2, max_depth=2, local_rows=50), Growth(rounds=2, gamma=0.0, local_rows=50)):
        want, got = ({r.row: r.prediction for r in trees.predictions(trees.grow(t, growth)).collect()} for t in (table, both))
        assert got == {i: pytest.approx(want[i]) for i in range(len(x)) if not trains[i]}


def test_odd_tree_tables(spark):
    schema = "row long, key string, x array<double>, y double, trains boolean"
    assert trees.grow(spark.createDataFrame([], schema), Growth()).count() == 0
    same = spark.createDataFrame([(i, "k", [1.0, 2.0], float(i % 2), True) for i in range(6)], schema)
    for growth in (Growth(), Growth(local_rows=2), Growth(rounds=2, reg_lambda=1.0, gamma=0.0)):
        assert {r.prediction for r in trees.predictions(trees.grow(same, growth)).collect()} == {0.5}
        assert [r.importance for r in trees.feature_importances(trees.grow(same, growth), growth, ["a", "b"]).collect()] == [0.0, 0.0]


# -- least squares ------------------------------------------------------------


def vector_rows(spark, x, y):
    cols = [f"c{k}" for k in range(x.shape[1])]
    return f.assemble(spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(y=y)), cols)


def test_collinear_columns_have_the_shortest_answer(spark):
    rng = np.random.default_rng(7)
    a, g = rng.normal(size=(200, 2)), rng.integers(0, 4, 200)
    x = np.c_[a * [1000, 0.01], a.sum(1), a[:, 0] * 1000 + a[:, 1] * 0.01, np.ones(200), np.eye(4)[g]]
    y = a @ [2, 3] + g + rng.normal(size=200)
    fit = least_squares(vector_rows(spark, x, y), "y", "features", x.shape[1])
    centred = x - x.mean(0)
    want = np.linalg.lstsq(centred, y - y.mean(), rcond=1e-10)[0]
    assert fit.rank == 5 and fit.coefficients.toArray() == pytest.approx(want, rel=1e-6, abs=1e-8)
    got = [r.prediction for r in fit.transform(vector_rows(spark, x, y)).collect()]
    assert got == pytest.approx(y.mean() + centred @ want)


def test_ridge_on_collinear_columns(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(100, 2)) + 50
    x, y = np.c_[a, a.sum(1)], rng.normal(size=100)
    fit = least_squares(vector_rows(spark, x, y), "y", "features", 3, alpha=0.5)
    c = x - x.mean(0)
    assert fit.coefficients.toArray() == pytest.approx(np.linalg.solve(c.T @ c + 0.5 * np.eye(3), c.T @ (y - y.mean())))


# -- exact split --------------------------------------------------------------


@pytest.mark.parametrize("n, percent, want", [(0, 25, 0), (1, 25, 1), (1003, 25, 251), (500, 0, 0), (40, 100, 40)])
def test_exact_split_has_the_stated_size(spark, n, percent, want):
    df = spark.range(n).withColumn("same", F.lit("key"))
    for key in ("id", "same"):
        got = [{r.id for r in f.exact_split(d, key, percent).where("split = 'test'").collect()} for d in (df, df.repartition(7))]
        assert got[0] == got[1] and len(got[0]) == want
    assert n < 500 or percent < 1 or {r.id for r in f.exact_split(df, "id", percent, seed=1).where("split = 'test'").collect()} != got[0]


def test_exact_split_keeps_equal_rows_together(spark):
    df = spark.createDataFrame([(1, None)] * 10, "k int, v string")
    assert f.exact_split(df, "k").where("split = 'test'").count() == 0
