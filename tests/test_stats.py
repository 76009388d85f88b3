import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from areastats.functions import correlation_p_value
from areastats.operators import stats as s

CLASSES = {1: "m", 2: "w"}


@pytest.fixture(scope="module")
def groups(spark):
    data = [("g", 1, 30.0), ("g", 2, 10.0), ("g", 2, 20.0), ("h", 1, 5.0), ("n", 1, None), ("n", 2, 4.0), (None, 1, 99.0), ("z", 1, 0.0), ("z", 2, 0.0)]
    return spark.createDataFrame(data, "g string, cls int, v double")


def test_sum_of_nothing_is_zero(groups):
    got = s.scalar_sums(groups, {"all": ("v", None), "none": ("v", F.col("cls") == 7)})
    assert rows(got) == [(168.0, 0.0)]


def test_class_share_within_group(groups):
    got = {r["g"]: r for r in s.class_share(groups, "g", "cls", "v", CLASSES).collect()}
    assert set(got) == {"g", "h", "n", "z"}  # rows without a group are left out
    assert got["g"]["share_m"] == 50.0 and got["g"]["share_w"] == 50.0
    assert got["h"]["total"] is None and got["h"]["share_m"] is None  # one class is absent
    assert got["n"]["share_w"] is None
    assert got["z"]["share_m"] is None  # total of zero


def test_class_share_of_total_adds_up(groups):
    got = s.class_share(groups, "g", "cls", "v", CLASSES, of="total").collect()
    assert sum(r["share_m"] or 0 for r in got) == pytest.approx(100)
    assert sum(r["share_w"] or 0 for r in got) == pytest.approx(100)
    with pytest.raises(ValueError):
        s.class_share(groups, "g", "cls", "v", CLASSES, of="area")


def test_mean_of_shares_differs_from_overall(spark):
    df = spark.createDataFrame([("a", 1, 90.0), ("a", 2, 10.0), ("b", 1, 1.0), ("b", 2, 1.0)], "g string, cls int, v double")
    r = s.mean_of_shares(df, "g", "cls", "v", CLASSES).first()
    assert r["mean_share_m"] == 70.0
    assert r["overall_share_m"] == pytest.approx(91 / 102 * 100)


def test_collapse_takes_first_known_value(spark):
    df = spark.createDataFrame([("a", 2, 1.0, "late"), ("a", 1, 2.0, None), ("a", 3, 4.0, "later"), (None, 1, 1.0, "x")], "k string, o int, v double, t string")
    assert rows(s.collapse(df, ["k"], ["v"], ["t"], ["o"])) == [("a", 7.0, "late")]
    with pytest.raises(ValueError):
        s.collapse(df, ["k"], ["v"], ["t"], [])


def test_compare_versions(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 3.0), ("x", 2, 1.0)], "g string, cls int, v double")
    got = s.compare_versions({"a": a, "b": a.where("g = 'x'")}, "g", "cls", "v", CLASSES)
    assert rows(got) == [("x", 25.0, 100.0, 100.0, 100.0), ("y", 75.0, None, None, None)]


def test_gap(spark):
    df = spark.createDataFrame([("a", 20.0, 10.0), ("a", 40.0, 20.0), ("b", 0.0, 1.0)], "g string, h double, l double")
    assert rows(s.gap_by_group(df, "g", "h", "l")) == [("a", 30.0, 15.0, 50.0), ("b", 0.0, 1.0, None)]
    got = s.gap_by_group(df, "g", "h", "l", F.col("h") > 30, F.col("l") < 15)
    assert rows(got)[0] == ("a", 40.0, 10.0, 75.0)


def test_describe_categories_breaks_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "t string")
    assert rows(s.describe_categories(df, ["t"])) == [("t", 5, 3, "a", 2)]
    assert [tuple(r) for r in s.value_counts(df, "t").collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, id int")
    r = s.box_stats(df, ["v"]).first()
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    assert (r["q25"], r["q50"], r["q75"]) == (q1, q2, q3)
    assert (r["whisker_low"], r["whisker_high"], r["maximum"], r["n_outliers"]) == (1.0, 5.0, 100.0, 1)
    assert rows(s.outliers(df, ["v"], ["id"])) == [(5, "v", 100.0)]


def t_tail(t, v):
    """Two-sided tail of the t distribution by Simpson's rule."""
    const = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
    xs = np.linspace(0, abs(t), 200001)
    ys = const * (1 + xs**2 / v) ** (-(v + 1) / 2)
    h = xs[1] - xs[0]
    return 1 - 2 * (h / 3 * (ys[0] + ys[-1] + 4 * ys[1:-1:2].sum() + 2 * ys[2:-1:2].sum()))


def test_correlation_and_p_value(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=14)
    y = 0.4 * x + rng.normal(size=14)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    got = s.correlation_test(df, "x", "y").first()
    rho = np.corrcoef(x, y)[0, 1]
    assert got["n"] == 14 and got["correlation"] == pytest.approx(rho, rel=1e-12)
    assert got["p_value"] == pytest.approx(t_tail(rho * math.sqrt(12 / (1 - rho**2)), 12), rel=1e-9)


@pytest.mark.parametrize(
    "data, rho, p",
    [
        ([(1.0, 1.0), (1.0, 2.0), (1.0, 4.0)], None, None),
        ([(1.0, 2.0), (2.0, 3.0)], 1.0, None),
        ([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], 1.0, 0.0),
        ([(1.0, None)], None, None),
    ],
)
def test_correlation_at_the_edges(spark, data, rho, p):
    got = s.correlation_test(spark.createDataFrame(data, "x double, y double"), "x", "y").first()
    assert got["correlation"] == (None if rho is None else pytest.approx(rho))
    assert got["p_value"] == (None if p is None else pytest.approx(p, abs=1e-6))


def test_sorting_puts_missing_last(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (2, "a")], "v int, k string")
    assert [tuple(r) for r in s.sort_rows(df, "v", ties=["k"]).collect()] == [(1, "a"), (2, "a"), (2, "b"), (None, "n")]
    assert [r[0] for r in s.sort_rows(df, "v", ascending=False, ties=["k"]).collect()] == [2, 2, 1, None]
    top = s.top_k(df, "v", 2, ties=["k"])
    assert [tuple(r) for r in top.collect()] == [(2, "a"), (2, "b")]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().toString()


def test_transpose(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    assert rows(s.transpose(df, "k", ["x", "y"], ["a", "b"])) == [("x", 1, 3), ("y", 2, 4)]


def test_describe_keeps_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None, "a", None), (float("nan"), None, "a", None), (3.0, None, None, None)], "x double, y double, s string, t string")
    numbers = {r.metric: (r.n, r.mean, r.q50) for r in s.describe_numbers(df, ["x", "y"]).collect()}
    assert numbers == {"x": (2, 2.0, 2.0), "y": (0, None, None)}
    texts = {r.metric: (r.n, r.n_unique, r.top, r.freq) for r in s.describe_categories(df, ["s", "t"]).collect()}
    assert texts == {"s": (2, 1, "a", 2), "t": (0, 0, None, None)}


@pytest.mark.parametrize("n, rho", [(3, 0.5), (5, -0.95), (40, 0.01), (2000, 0.06), (100000, 0.008)])
def test_p_values_of_small_and_large_groups(spark, n, rho):
    got = spark.range(1).select(correlation_p_value(F.lit(rho), F.lit(n)).alias("p")).first().p
    assert got == pytest.approx(t_tail(rho * math.sqrt((n - 2) / (1 - rho**2)), n - 2), rel=1e-7, abs=1e-12)


def test_p_values_by_group(spark):
    rows = [("a", float(i), float((i * 7) % 5)) for i in range(9)] + [("b", 1.0, 2.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), ("c", 3.0, 3.0)]
    got = {r.g: r for r in s.correlation_test(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", by=["g"]).collect()}
    alone = s.correlation_test(spark.createDataFrame(rows[:9], "g string, x double, y double"), "x", "y").first()
    assert got["a"].p_value == alone.p_value and got["b"].p_value is None and got["c"].p_value == 0.0
