"""The same results when nothing is broadcast and one key holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from areastats.operators import cleaning, joins, stats
from areastats.operators.quantiles import exact_quantiles, rank_rows

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
}


@pytest.fixture(scope="module")
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed():
    """30,000 rows, every third with key 0; the others spread over 500 keys."""
    n = 30000
    rng = np.random.default_rng(5)
    key = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 500, n))
    return pd.DataFrame({"k": key, "id": np.arange(n), "v": rng.normal(size=n).round(3)})


def test_presence_join_with_a_frequent_key(shuffled, skewed):
    left = shuffled.createDataFrame(skewed[["k", "id"]]).repartition(8)
    right = shuffled.createDataFrame(pd.DataFrame({"k": range(0, 700, 2), "w": range(350)}))
    got = joins.presence_join(left, right, ["k"]).groupBy("presence").agg(F.count(F.lit(1)), F.sum("id"), F.sum("w"))
    both = skewed[skewed.k % 2 == 0]
    alone = skewed[skewed.k % 2 == 1]
    missing = [k // 2 for k in range(0, 700, 2) if k not in set(skewed.k)]
    assert rows(got, "presence") == [
        ("both", len(both), both.id.sum(), (both.k // 2).sum()),
        ("left_only", len(alone), alone.id.sum(), None),
        ("right_only", len(missing), None, sum(missing)),
    ]
    plan = joins.presence_join(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "FullOuter" not in plan


def test_lookup_and_duplicates_of_a_frequent_key(shuffled, skewed):
    df = shuffled.createDataFrame(skewed).repartition(8)
    last = skewed.sort_values("id").groupby("k").id.last()
    got = cleaning.lookup(df.select("id", "k"), df.withColumnRenamed("id", "last"), "k", "last", order=["last"])
    assert got.agg(F.count(F.lit(1)), F.sum("last")).first()[:] == (len(skewed), last.loc[skewed.k].sum())
    first = cleaning.keep_first(df, ["k"], ["v", "id"])
    want = skewed.sort_values(["v", "id"]).groupby("k").first()
    assert first.agg(F.count(F.lit(1)), F.sum("id")).first()[:] == (len(want), want.id.sum())


def test_quantiles_with_a_frequent_group(shuffled, skewed):
    got = exact_quantiles(shuffled.createDataFrame(skewed).repartition(8), ["v"], [0.1, 0.5], ["k"]).toPandas().set_index("k")
    want = skewed.groupby("k").v.quantile([0.1, 0.5]).unstack()
    assert np.allclose(got.loc[want.index, ["q10", "q50"]], want, rtol=1e-12)


def test_ranks_with_a_frequent_value(shuffled, skewed):
    df = shuffled.createDataFrame(skewed).withColumn("x", F.when(F.col("k") == 0, 7.0).otherwise(F.col("v"))).repartition(8)
    got = rank_rows(df, "x", ["id"]).select("rank", "x").toPandas().sort_values("rank")
    assert (got["rank"].to_numpy() == np.arange(len(skewed))).all() and got.x.is_monotonic_increasing


def test_shares_with_a_frequent_group(shuffled, skewed):
    df = shuffled.createDataFrame(skewed.assign(c=skewed.id % 2, w=1.0)).repartition(8)
    got = stats.class_share(df, "k", "c", "w", {0: "a", 1: "b"}, of="total").agg(F.sum("share_a"), F.sum("share_b")).first()
    assert got[:] == (pytest.approx(100), pytest.approx(100))
