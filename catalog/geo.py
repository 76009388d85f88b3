"""Coordinates, point layers, map layers."""

from pyspark.sql import functions as F

from areastats.functions import decimal_comma
from areastats.operators import geo as g
from areastats.operators import stats
from areastats.sources import FEATURE_SCHEMA, explode_features, read_features, scratch_path
from catalog.areas import SIZES, areas, with_areas
from catalog.registry import query, r, rounded, table

# Places get coordinates from their key: longitude -10..9.9, latitude 35..64.9.


@query(
    "mercator",
    f"""SELECT c_custkey, {r('lon * 20037508.34 / 180', 4)} AS x,
        {r('ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * 20037508.34 / 180', 4)} AS y
        FROM (SELECT c_custkey, CAST(c_custkey % 199 AS DOUBLE) / 10 - 10 AS lon, 35 + CAST(c_custkey % 299 AS DOUBLE) / 10 AS lat
              FROM customer)""",
)
def mercator(spark, d):
    lon = (F.col("c_custkey") % 199).cast("double") / 10 - 10
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.replace(lon.cast("string"), F.lit("."), F.lit(",")).alias("lon"),
        (35 + (F.col("c_custkey") % 299).cast("double") / 10).alias("lat"),
    )
    rows = rows.withColumn("lon", decimal_comma("lon"))
    return rounded(g.to_mercator(rows, "lon", "lat").select("c_custkey", "x", "y"), 4)


@query(
    "size_layers",
    with_areas(" UNION ALL ".join(f"SELECT area, reg, '{s}' AS layer, {s} AS n FROM simple WHERE {s} >= 1" for s in SIZES)),
)
def size_layers(spark, d):
    return g.size_layers(areas(spark, d), SIZES, ["area", "reg"])


def _feature(spark, d):
    """One GeoJSON feature text per nation; every third is a multi-polygon."""
    key = F.col("n_nationkey")
    x, y = key.cast("string"), (key + 1).cast("string")
    ring = F.concat(F.lit("[[["), x, F.lit(","), x, F.lit("],["), y, F.lit(","), x, F.lit("],["), y, F.lit(","), y, F.lit("],["), x, F.lit(","), x, F.lit("]]]"))
    multi = key % 3 == 0
    code = F.when(key == 20, "2A").when(key == 21, "2B").otherwise(key.cast("string"))
    return table(spark, d, "nation").select(
        F.concat(
            F.lit('{"type":"Feature","properties":{"code":"'), code, F.lit('","name":"'), F.col("n_name"),
            F.lit('"},"geometry":{"type":"'), F.when(multi, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'),
            F.when(multi, F.concat(F.lit("["), ring, F.lit("]"))).otherwise(ring), F.lit("}}"),
        ).alias("value")
    )


_FEATURES_SQL = """features AS (SELECT CASE n_nationkey WHEN 20 THEN '2A' WHEN 21 THEN '2B' ELSE CAST(n_nationkey AS VARCHAR) END AS code,
  n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type,
  '[[[' || n_nationkey || ',' || n_nationkey || '],[' || n_nationkey + 1 || ',' || n_nationkey || '],[' || n_nationkey + 1 || ',' ||
    n_nationkey + 1 || '],[' || n_nationkey || ',' || n_nationkey || ']]]' AS ring,
  CASE WHEN n_nationkey % 3 = 0 THEN '[' || ring || ']' ELSE ring END AS coordinates FROM nation)"""


@query("feature_rows", f"WITH {_FEATURES_SQL} SELECT * EXCLUDE (ring) FROM features")
def feature_rows(spark, d):
    path = scratch_path(spark, "features")
    _feature(spark, d).write.text(path)
    return read_features(spark, path, ["code", "name"], lines=True)


@query(
    "feature_collections",
    """SELECT CAST(c_custkey AS VARCHAR) AS code, c_name || ' {"' || c_mktsegment || '\\}"' AS name,
       CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS part, 'Point' AS geometry_type,
       '[' || c_custkey || ',' || c_nationkey || ']' AS coordinates FROM customer""",
)
def feature_collections(spark, d):
    """A point per customer, one FeatureCollection file per market segment, read in splits."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    name = F.concat("c_name", F.lit(' {"'), "c_mktsegment", F.lit('\\}"'))
    # The outer "name" and the last property of some features are no features themselves.
    part = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(',"part":"'), nation, F.lit('","in":{"a":[{}]}'))).otherwise("")
    body = F.concat(
        F.lit('{"type": "Feature", "properties": {"name":'), F.substring(F.to_json(F.array(name)), 2, 1 << 20), F.lit(',"code":"'), key,
        F.lit('"'), part, F.lit('},\n "geometry": {"type":"Point","coordinates":['), key, F.lit(","), nation, F.lit("]}}"),
    )
    body = F.replace(body, F.lit('],"code"'), F.lit(',"code"'))
    customers = table(spark, d, "customer")
    head = '{"type":"FeatureCollection","name":"a {\\"b","crs":{"type":"name","properties":{"name":"}"}},"features":['
    segments = customers.select("c_mktsegment").distinct()
    ranked = customers.join(customers.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first")), "c_mktsegment")
    texts = (
        ranked.select("c_mktsegment", (F.col("c_custkey") * 2).alias("at"), F.concat(F.when(F.col("c_custkey") != F.col("first"), ",").otherwise(""), body).alias("value"))
        .unionByName(segments.select("c_mktsegment", F.lit(-(1 << 62)).alias("at"), F.lit(head).alias("value")))
        .unionByName(segments.select("c_mktsegment", F.lit(1 << 62).alias("at"), F.lit("]}").alias("value")))
    )
    path = scratch_path(spark, "collections")
    # A document is written by one task, row by row; no row of the table holds more than one feature.
    texts.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "at").drop("at").write.partitionBy("c_mktsegment").text(path)
    return read_features(spark, path, ["code", "name", "part"])


@query(
    "map_layer",
    with_areas(
        """SELECT CASE code WHEN '2A' THEN '20' WHEN '2B' THEN '96' ELSE code END AS dep, name, geometry_type, firms FROM features
           LEFT JOIN (SELECT CAST(dep AS VARCHAR) AS code, CAST(sum(firms) AS BIGINT) AS firms FROM simple WHERE dep % 4 <> 1 GROUP BY dep) v
           ON v.code = CASE features.code WHEN '2A' THEN '20' WHEN '2B' THEN '96' ELSE features.code END""",
        _FEATURES_SQL,
    ).replace("CASE code WHEN", "CASE features.code WHEN").replace("ELSE code END AS dep", "ELSE features.code END AS dep"),
)
def map_layer(spark, d):
    parsed = _feature(spark, d).select(F.from_json("value", FEATURE_SCHEMA).alias("f"))
    features = explode_features(parsed, "f", ["code", "name"]).drop("coordinates").withColumnRenamed("code", "dep")
    values = stats.group_sums(areas(spark, d).where("dep % 4 <> 1"), ["dep"], ["firms"]).withColumn("dep", F.col("dep").cast("string"))
    return g.map_layer(features, values, "dep", {"2A": "20", "2B": "96"})


