import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from areastats.functions import log_cell
from areastats.operators import bands as b
from areastats.operators.quantiles import exact_quantiles, quantile_name, rank_rows

RNG = np.random.default_rng(7)
SHAPES = {
    "normal": RNG.normal(size=3000),
    "tiny": RNG.normal(size=700) * 1e-9,
    "ties": RNG.integers(-2, 3, 900).astype(float),
    "huge": RNG.normal(size=501) * 1e200,
    "one": np.array([3.0]),
    "two": np.array([1.0, 2.0]),
    "narrow": 1.7e9 + RNG.integers(0, 100000, 2000),
    "mostly one value": np.r_[np.full(2000, 5.0), RNG.normal(5, 1e-7, 1000)],
}
PROBS = [0, 0.1, 0.25, 0.5, 0.77, 1]


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"v": values, "id": range(len(values))}))


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_are_exact(spark, shape):
    values = SHAPES[shape]
    got = exact_quantiles(frame(spark, values), ["v"], PROBS).first()
    want = np.quantile(values, PROBS)
    assert got["n"] == len(values)
    for p, w in zip(PROBS, want):
        assert got[quantile_name(p)] == pytest.approx(w, rel=1e-12, abs=0), p


@pytest.mark.parametrize("shape", ["normal", "ties", "narrow", "mostly one value"])
def test_ranks_are_complete_and_ordered(spark, shape):
    values = SHAPES[shape]
    got = rank_rows(frame(spark, values).repartition(7), "v", ["id"]).toPandas().sort_values("rank")
    assert (got["rank"].to_numpy() == np.arange(len(values))).all()
    assert got["v"].is_monotonic_increasing


def test_quantiles_by_group_and_with_gaps(spark):
    pdf = pd.DataFrame({"g": ["a"] * 5 + ["b"] * 2 + ["c"], "x": [1.0, 2, None, 4, 10, 5, 6, None], "y": range(8)})
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = {(r["g"], r["metric"]): r for r in exact_quantiles(df, ["x", "y"], [0.25, 0.5], ["g"]).collect()}
    assert ("c", "x") not in got  # no value at all
    for (g, m), r in got.items():
        v = pdf.loc[pdf.g == g, m].dropna()
        assert (r["n"], r["q25"], r["q50"]) == (len(v), v.quantile(0.25), v.quantile(0.5))


def test_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in [5.0, 6.0, 7.0, 8.0, float("nan"), float("nan"), None]], "v double")
    assert exact_quantiles(df, ["v"]).first()[1:] == (4, 5.75, 6.5, 7.25)
    assert [r["rank"] for r in rank_rows(df, "v").orderBy("v").collect()] == [0, 1, 2, 3]
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [-inf, -inf, -1.0, 0.0, 1.0, inf, inf]], "v double")
    assert exact_quantiles(df, ["v"], [0, 0.5, 1]).first()[2:] == (-inf, 0.0, inf)


def test_small_values_fall_in_many_cells(spark):
    df = frame(spark, np.r_[RNG.uniform(0, 1e-6, 20000), 9e-4, -9e-4])
    top = df.groupBy(log_cell("v")).count().agg(F.max("count")).first()[0]
    assert top < 200


def test_a_repeated_value_beside_others_is_cut(spark):
    df = frame(spark, np.r_[np.full(9990, 20000.0), np.full(10, 20001.0)])
    got = rank_rows(df, "v", ["id"])
    assert [r[0] for r in got.select("rank").orderBy("rank").collect()] == list(range(10000))
    assert got.where("v = 20001").agg(F.min("rank")).first()[0] == 9990
    parts = df.withColumn("t", F.xxhash64("id")).repartitionByRange(8, "v", "t").groupBy(F.spark_partition_id()).count()
    assert parts.agg(F.max("count")).first()[0] < 3000


def test_quantiles_do_not_depend_on_partitioning(spark):
    df = frame(spark, SHAPES["normal"])
    assert rows(exact_quantiles(df, ["v"])) == rows(exact_quantiles(df.repartition(7), ["v"]))


def test_sketch_is_close(spark):
    got = exact_quantiles(frame(spark, SHAPES["normal"]), ["v"], exact=False).first()
    assert got["q50"] == pytest.approx(np.median(SHAPES["normal"]), abs=0.01)


def test_values_are_read_twice_at_most(spark):
    df = frame(spark, SHAPES["normal"])
    query = exact_quantiles(df, ["v"])
    query.collect()
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "CartesianProduct" not in plan


def test_band_edges(spark):
    # quartiles of 1..5 are 2, 3, 4: only the lowest band leaves out its cut point
    df = spark.createDataFrame([(i, float(i), 7.0) for i in range(1, 6)] + [(6, None, 7.0)], "id int, v double, same double")
    got = b.quantile_bands(df, ["v", "same"])
    assert rows(got.select("id", "v_band", "same_band")) == [
        (1, "Q1", "Q2"), (2, "Q2", "Q2"), (3, "Q2", "Q2"), (4, "Q3", "Q2"), (5, "Q4", "Q2"), (6, None, "Q2"),
    ]
    assert b.complete_bands(got, ["v", "same"]).count() == 5


def test_band_counts_and_profile(spark):
    pdf = pd.DataFrame({"dep": [i % 3 for i in range(400)], "v": RNG.normal(size=400), "w": RNG.normal(size=400)})
    df = spark.createDataFrame(pdf)
    banded = b.quantile_bands(df, ["v", "w"])
    listed = b.band_list(banded, ["v", "w"], ["dep"]).groupBy("metric").count()
    assert rows(listed) == [("v", 400), ("w", 400)]
    cut = np.quantile(pdf.v, [0.25, 0.5, 0.75])
    number = 1 + (pdf.v >= cut[0]) + (pdf.v > cut[1]) + (pdf.v > cut[2])
    want = number.groupby(pdf.dep).mean()
    got = {r["dep"]: r["v"] for r in b.band_profile(banded, "dep", ["v", "w"]).collect()}
    assert got == pytest.approx(want.to_dict())


def test_bands_by_group_use_own_cuts(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(8)] + [("b", 100.0 + i) for i in range(8)], "g string, v double")
    got = b.quantile_bands(df, ["v"], by=["g"]).groupBy("g", "v_band").count()
    assert {r["count"] for r in got.collect()} == {2}
    assert got.count() == 8


def test_quantile_table_across(spark):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(5)], "a double, b double")
    assert rows(b.quantile_table(df, ["a", "b"], across=True)) == [("q25", 1.0, 2.0), ("q50", 2.0, 4.0), ("q75", 3.0, 6.0)]


def test_band_gap_with_own_or_stated_cuts(spark):
    df = spark.createDataFrame([("g", float(i), float(i)) for i in range(1, 6)], "g string, h double, l double")
    assert rows(b.band_gap(df, "g", "h", "l")) == [("g", 5.0, 1.0, 80.0)]
    assert rows(b.band_gap(df, "g", "h", "l", {"high": 3, "low": 3})) == [("g", 4.5, 1.5, pytest.approx(100 * 3 / 4.5))]


def test_bands_add_one_subquery(spark):
    df = frame(spark, SHAPES["normal"]).withColumn("w", F.col("v") * 2)
    plan = b.quantile_bands(df, ["v", "w"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery#") <= 2
