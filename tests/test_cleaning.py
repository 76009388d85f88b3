import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from areastats.operators import cleaning as c
from areastats.sources import materialise, read_features, read_table, write_table


def test_drop_and_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert c.drop_columns(df, ["b", "zz"]).columns == ["a", "c"]
    with pytest.raises(ValueError):
        c.drop_columns(df, ["zz"], strict=True)
    assert c.rename_columns(df, {"a": "x"}).columns == ["x", "b", "c"]
    assert c.rename_columns(df, ["x", "y", "z"]).columns == ["x", "y", "z"]
    assert c.present_columns(df, ["c", "a", "q"]) == ["a", "c"]


def test_recode_and_inverse(spark):
    df = spark.createDataFrame([("Q1", "Q4"), ("Q2", None)], "a string, b string")
    got = c.recode(df, ["a", "b"], {"Q1": 1, "Q2": 2, "Q4": 4}, "null", cast="int")
    assert rows(got) == [(1, 4), (2, None)]
    assert c.invert_mapping({"a": 1, "b": 2}) == {1: "a", 2: "b"}
    with pytest.raises(ValueError):
        c.invert_mapping({"a": 1, "b": 1})


def test_lookup_takes_the_last_row_of_a_key(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    ref = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), (None, 3, "no")], "k string, at int, name string")
    assert rows(c.lookup(df, ref, "k", "name", order=["at"]), "v") == [("x", 1, "new"), ("y", 2, None), (None, 3, None)]
    with pytest.raises(ValueError):
        c.lookup(df, ref.withColumnRenamed("name", "v"), "k", "v", order=["at"])


def test_override_ignores_unknown_conditions(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "n string, v int")
    got = c.override(df, [(F.col("n") == "a", "v", 9), (F.col("n") == "b", "v", 8)])
    assert rows(got, "v") == [(None, 2), ("b", 8), ("a", 9)]


def test_coerce_and_drop(spark):
    df = spark.createDataFrame([("1", "2"), ("x", "3"), (None, "4")], "a string, b string")
    assert rows(c.coerce_numeric(df, ["a", "b"])) == [(1.0, 2.0)]
    assert c.coerce_numeric(df, ["a", "b"], drop_bad=False).count() == 3
    df = spark.createDataFrame([(49,), (50,), (None,)], "v int")
    assert rows(c.drop_where(df, F.col("v") >= 50)) == [(49,), (None,)]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), (None, 5, "p"), (None, 4, "q")], "k string, o int, v string")
    assert rows(c.keep_first(df, ["k"], ["o"]), "o") == [("a", 1, None), (None, 4, "q")]
    assert rows(c.keep_last(df, ["k"], ["o"]), "o") == [("a", 2, "x"), (None, 5, "p")]
    with pytest.raises(ValueError):
        c.keep_first(df, ["k"], [])


def test_one_frequent_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    got = c.keep_first(df, ["k"], ["o"])
    assert rows(got) == [("hot", 0)]
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def test_quality_counts(spark):
    df = spark.createDataFrame([("-", None), ("1", "a"), ("-", "a")], "lon string, n string")
    got = c.quality_counts(df, {"dash": F.col("lon") == "-", "missing": F.col("n").isNull()}, {"names": "n"})
    assert rows(got) == [(3, 2, 1, 1)]


def test_csv_by_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b,code,extra\n1.5,01,x\n,2A,y\n")
    got = read_table(spark, str(path), "code string, b double")
    assert rows(got) == [("01", 1.5), ("2A", None)]
    with pytest.raises(ValueError):
        read_table(spark, str(path))


def test_csv_missing_markers_and_differing_headers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("code,b\nNA,NaN\n02,N/A\n03,1.5\n")
    assert rows(read_table(spark, str(tmp_path / "m.csv"), "code string, b double")) == [("02", None), ("03", 1.5), (None, None)]
    kept = read_table(spark, str(tmp_path / "m.csv"), "code string", missing=())
    assert rows(kept) == [("02",), ("03",), ("NA",)]
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("code,area\n01,X\n")
    (folder / "b.csv").write_text("area,code\nY,02\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(folder), "code string, area string").collect()


def test_write_and_materialise(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for fmt in ("csv", "parquet", "json"):
        path = str(tmp_path / fmt)
        write_table(df, path, fmt)
        assert rows(read_table(spark, path, "k int, v string", fmt)) == rows(df)
    write_table(df, str(tmp_path / "parts"), partition_by=["k"])
    assert rows(spark.read.parquet(str(tmp_path / "parts")).where("k = 1").select("v")) == [("a",)]
    assert rows(materialise(df, "t")) == rows(df)


FEATURES = [
    '{"type":"Feature","properties":{"code":"01"},"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4],[1,2]]]}}',
    '{"type":"Feature","properties":{"code":"2A"},"geometry":{"type":"MultiPolygon","coordinates":[[[[1,2],[3,4],[1,2]]]]}}',
]


def test_features_as_document_and_as_lines(spark, tmp_path):
    (tmp_path / "doc.geojson").write_text('{"type":"FeatureCollection","features":[' + ",\n".join(FEATURES) + "]}")
    (tmp_path / "lines.geojson").write_text("\n".join(FEATURES))
    doc = read_features(spark, str(tmp_path / "doc.geojson"), ["code"])
    lines = read_features(spark, str(tmp_path / "lines.geojson"), ["code"], lines=True)
    assert rows(doc) == rows(lines) == [
        ("01", "Polygon", "[[[1,2],[3,4],[1,2]]]"),
        ("2A", "MultiPolygon", "[[[[1,2],[3,4],[1,2]]]]"),
    ]


TRICKY = """{"type":"FeatureCollection", "name":"a \\"} {b\\\\", "crs":{"type":"name","properties":{"name":"urn{}}"}}, "features":[
 {"type":"Feature","properties":{"code":"01","note":"}}{{ \\" ] {"},"geometry":{"type":"Point","coordinates":[1, 2]}},
 {"geometry":{"coordinates":[[[[0,0],[1,1],[1,0],[0,0]]]],"type":"MultiPolygon"},"properties":{"code":"é😀\\\\"},"type":"Feature"},
 {"type":"Feature","properties":null,"geometry":null},
 {"type":"Feature","properties":{"code":"","in":{"a":[{},{"b":{}}]}},"geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[3,4]}]}}
], "about":{"by":{"x":"{"}}}
"""


@pytest.mark.parametrize("size", ["13", "60", "128MB"])
def test_one_document_in_splits_of_any_size(spark, tmp_path, size):
    """Cuts fall inside strings, escapes, characters and nested brackets."""
    (tmp_path / "a.geojson").write_text(TRICKY, encoding="utf-8")
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    many = [{"type": "Feature", "properties": {"code": f"{i}{'{' * (i % 3)}", "note": "}"}, "geometry": None} for i in range(20)]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": many}))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
        assert tasks > 20 if size != "128MB" else tasks <= 8
        features = read_features(spark, str(tmp_path), ["code", "note"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted(features.collect(), key=str)
    want = []
    for feature in json.loads(TRICKY)["features"] + many:
        props, geometry = feature["properties"] or {}, feature["geometry"] or {}
        want.append((props.get("code"), props.get("note"), geometry.get("type"), geometry.get("coordinates")))
    assert [(r.code, r.note, r.geometry_type, r.coordinates and json.loads(r.coordinates)) for r in got] == sorted(
        want, key=lambda w: str(next(r for r in got if (r.code, r.note, r.geometry_type) == w[:3]))
    )
