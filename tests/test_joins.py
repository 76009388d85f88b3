import pytest
from conftest import rows

from areastats.operators import joins as j


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([("b", 20), ("c", 30), (None, 40)], "k string, v int")


def test_equi_join_names_shared_columns(left, right):
    got = j.equi_join(left, right, ["k"])
    assert got.columns == ["k", "v_x", "v_y"]
    assert rows(got) == [("b", 2, 20), ("b", 3, 20)]
    assert (None, 4, None) in rows(j.equi_join(left, right, ["k"], "left"))
    with pytest.raises(ValueError):
        j.equi_join(left, right, ["k"], "cross")


def test_null_keys_match_on_request(left, right):
    got = j.equi_join(left, right, ["k"], null_safe=True)
    assert (None, 4, 40) in rows(got) and got.count() == 3
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_presence_join_accounts_for_all_rows(left, right):
    got = j.presence_join(left, right, ["k"])
    assert rows(got) == sorted(
        [
            ("a", 1, None, "left_only"),
            ("b", 2, 20, "both"),
            ("b", 3, 20, "both"),
            (None, 4, None, "left_only"),
            ("c", None, 30, "right_only"),
            (None, None, 40, "right_only"),
        ],
        key=str,
    )


def test_unmatched(left, right):
    assert rows(j.unmatched(left, right, ["k"])) == sorted(
        [("a", 1, "left_only"), (None, 4, "left_only"), ("c", 30, "right_only"), (None, 40, "right_only")], key=str
    )


def test_intersect_and_align(spark, left, right):
    third = spark.createDataFrame([("b", "z")], "k string, w string")
    assert rows(j.intersect_all([left, right, third], ["k"])) == [("b", 2, 20, "z"), ("b", 3, 20, "z")]
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    b = spark.createDataFrame([("b", 5), ("c", 6)], "k string, y int")
    assert rows(j.align(a, b, ["k"])) == [("a", 1, None), ("b", 2, 5), ("c", None, 6)]


def test_pair_by_rank(spark):
    a = spark.createDataFrame([("p", 30), ("q", 10), ("r", 20)], "k string, x int")
    b = spark.createDataFrame([("p", 1), ("q", 3), ("r", 2)], "k string, y int")
    assert rows(j.pair_by_rank(a, "x", b, "y"), "rank") == [(0, 10, 1), (1, 20, 2), (2, 30, 3)]


def test_null_keys_match_only_when_asked(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "d"), (None, "e"), (4, "f")], "k int, y string")
    safe = {(r.k, r.x, r.y, r.presence) for r in j.presence_join(a, b, ["k"], null_safe=True).collect()}
    assert safe == {(1, "a", "d", "both"), (None, "b", "e", "both"), (3, "c", None, "left_only"), (4, None, "f", "right_only")}
    assert {r.k for r in j.unmatched(a, b, ["k"], null_safe=True).collect()} == {3, 4}
    assert {r.k for r in j.unmatched(a, b, ["k"]).collect()} == {3, 4, None}
    assert {r.k for r in j.intersect_all([a, b], ["k"], null_safe=True).collect()} == {1, None}
    assert {tuple(r) for r in j.align(a, b, ["k"], null_safe=True).collect()} == {
        (1, "a", "d"), (None, "b", "e"), (3, "c", None), (4, None, "f")
    }
