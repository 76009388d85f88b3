import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from areastats import functions as fn


def one(spark, expr, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(expr.alias("x")).first()[0]


def test_negated_filters_keep_missing_values(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(df.where(fn.not_in("k", [1]))) == [(2,), (None,)]
    assert rows(df.where(fn.not_in("k", [1], drop_null=True))) == [(2,)]
    assert rows(df.where(fn.differs("k", 2))) == [(1,), (None,)]
    assert rows(df.where(fn.differs("k", 2, drop_null=True))) == [(1,)]


def test_range_is_half_open(spark):
    df = spark.createDataFrame([(14,), (15,), (64,), (65,)], "age int")
    assert rows(df.where(fn.in_range("age", 15, 65))) == [(15,), (64,)]


def test_map_values_does_not_chain(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    got = df.select(fn.map_values("k", {1: 2, 2: 3}).alias("a"), fn.map_values("k", {1: 2, 2: 3}, "null").alias("b"))
    assert rows(got) == [(2, 2), (3, 3), (3, None), (None, None)]
    with pytest.raises(ValueError):
        fn.map_values("k", {}, "other")


def test_text_to_number(spark):
    df = spark.createDataFrame([("2,35",), ("-",), (None,), ("-1.5",), ("1,234,5",)], "t string")
    assert [r[0] for r in df.select(fn.decimal_comma("t")).collect()] == [2.35, None, None, -1.5, None]


def test_codes(spark):
    assert one(spark, fn.replace_text("c", {"2A": "20", "2B": "20"}), c="2A004") == "20004"
    assert one(spark, fn.code_prefix_fill("d", "c", 2), d=None, c="01001") == "01"
    assert one(spark, fn.code_prefix_fill("d", "c", 2), d="99", c="01001") == "99"
    assert one(spark, fn.pad_code("n", 2), n=1) == "01"
    assert one(spark, fn.pad_code("n", 2), n=123) == "123"


def test_percent_of_nothing_is_missing(spark):
    assert one(spark, fn.percent("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, fn.percent("a", "b"), a=1.0, b=4.0) == 25.0
    assert one(spark, fn.gap_percent("a", "b"), a=20.0, b=15.0) == 25.0


def test_rounding_modes(spark):
    assert one(spark, fn.round_to("a", 1), a=0.25) == 0.2
    assert one(spark, fn.round_to("a", 1, "half_up"), a=0.25) == 0.3
    with pytest.raises(ValueError):
        fn.round_to("a", 1, "down")


def test_row_sum_misses_with_its_parts(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(fn.row_sum(["a", "b"])).collect()] == [3, None]


def test_mercator(spark):
    x, y = 2.35 * 20037508.34 / 180, math.log(math.tan((90 + 48.85) * math.pi / 360)) / (math.pi / 180) * 20037508.34 / 180
    assert one(spark, fn.mercator_x("lon"), lon=2.35) == pytest.approx(x, rel=1e-12)
    assert one(spark, fn.mercator_y("lat"), lat=48.85) == pytest.approx(y, rel=1e-12)


def test_log_cell_keeps_order(spark):
    values = sorted([-1e300, -5.0, -1e-9, 0.0, 1e-9, 0.5, 0.5000001, 1.0, 7.0, 1e6, 1e6 + 1, 1e300])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cells = {r[0]: r[1] for r in df.select("v", fn.log_cell("v")).collect()}
    assert [cells[v] for v in values] == sorted(cells[v] for v in values)
