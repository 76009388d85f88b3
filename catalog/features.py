"""Scaling, one-hot columns, train/test split."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from areastats.operators import features as f
from catalog.areas import RATES, SIZES, areas, with_areas
from catalog.registry import query, rounded, rsql, table

SPLIT_SQL = "CASE WHEN CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 100 < 25 THEN 'test' ELSE 'train' END"


@query("hash_split", f"SELECT o_orderkey, o_custkey, {SPLIT_SQL.format(key='CAST(o_orderkey AS VARCHAR)')} AS split FROM orders")
def hash_split(spark, d):
    return f.hash_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(
    "exact_split",
    """SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)))
         <= ceil((SELECT count(*) FROM orders) / 4.0) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def exact_split(spark, d):
    return f.exact_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(
    "standardise",
    with_areas(
        "SELECT area, split, "
        + rsql({c: f"({c} - avg({c}) FILTER (WHERE split = 'train') OVER ()) / stddev_pop({c}) FILTER (WHERE split = 'train') OVER ()" for c in RATES})
        + ", constant FROM s",
        f"s AS (SELECT *, {SPLIT_SQL.format(key='CAST(area AS VARCHAR)')} AS split, CAST(0 AS DOUBLE) AS constant FROM simple)",
    ),
)
def standardise(spark, d):
    rows = f.hash_split(areas(spark, d).withColumn("constant", F.lit(5.0)), "area")
    cols = [*RATES, "constant"]
    scaled = f.standard_scaling(rows.where(F.col("split") == "train"), cols).apply(rows)
    return rounded(scaled.select("area", "split", *cols))


@query(
    "minmax",
    with_areas(
        "SELECT area, "
        + rsql({c: f"(CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())" for c in [*RATES, *SIZES]})
        + ", CAST(0 AS DOUBLE) AS constant FROM simple"
    ),
)
def minmax(spark, d):
    rows = areas(spark, d).withColumn("constant", F.lit(5.0))
    cols = [*RATES, *SIZES, "constant"]
    return rounded(f.minmax_scaling(rows, cols).apply(rows).select("area", *cols))


_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"c_mktsegment_{s}\"" for s in _SEGMENTS)
    + ", "
    + ", ".join(f"CAST(c_nationkey = {k} AS INTEGER) AS c_nationkey_{k}" for k in range(1, 25))
    + " FROM customer",
)
def one_hot(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    coded = f.fit_one_hot(rows, ["c_mktsegment", "c_nationkey"]).columns(rows)
    return coded.drop("c_mktsegment", "c_nationkey")


@query(
    "one_hot_names",
    """SELECT 'c_mktsegment_' || c_mktsegment AS name FROM customer GROUP BY c_mktsegment
         HAVING c_mktsegment > (SELECT min(c_mktsegment) FROM customer)
       UNION ALL SELECT 'c_nationkey_' || c_nationkey AS name FROM customer GROUP BY c_nationkey
         HAVING c_nationkey > (SELECT min(c_nationkey) FROM customer)""",
)
def one_hot_names(spark, d):
    coder = f.fit_one_hot(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])
    return spark.createDataFrame([(n,) for n in coder.names()], "name string")


@query(
    "one_hot_vector",
    with_areas(
        """SELECT area, CAST(CAST(dep > 0 AS INTEGER) + CAST(reg_no > 0 AS INTEGER) AS DOUBLE) AS ones, CAST(28 AS INTEGER) AS width FROM simple"""
    ),
)
def one_hot_vector(spark, d):
    rows = areas(spark, d).select("area", "dep", "reg_no")
    coded = f.assemble(f.fit_one_hot(rows, ["dep", "reg_no"]).vector(rows), ["dep_vec", "reg_no_vec"])
    flags = coded.select("area", vector_to_array("features").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return flags.select("area", total.alias("ones"), F.size("v").alias("width"))


@query(
    "category_codes",
    """SELECT l_linenumber, p_name, code, CAST(max(code) OVER () AS INTEGER) AS width, CASE WHEN code > 0 THEN code - 1 END AS at, n
       FROM (SELECT l_linenumber, p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code, count(*) AS n
             FROM lineitem JOIN (SELECT p_partkey, p_name || ' ' || p_partkey AS p_name FROM part) ON l_partkey = p_partkey GROUP BY l_linenumber, p_name)""",
)
def category_codes(spark, d):
    """Lines by the name of their part, one category per part: codes, and the place of the one in the vector."""
    name = F.concat_ws(" ", "p_name", "p_partkey").alias("p_name")
    parts = table(spark, d, "part").select("p_partkey", name)
    lines = table(spark, d, "lineitem").select("l_partkey", "l_linenumber").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy("l_linenumber", "p_name").agg(F.count(F.lit(1)).alias("n"))
    codes = f.category_codes(lines, "p_name")
    coded = f.coded_vector(f.code_column(lines, "p_name", codes, "code"), "p_name", codes)
    # Read back from the vector: a dense form would be as wide as the list of parts.
    shown = F.from_json(F.to_json(F.struct("p_name_vec")), "p_name_vec struct<type tinyint, size int, indices array<int>, values array<double>>")
    part = shown["p_name_vec"]
    return coded.select("l_linenumber", "p_name", "code", part["size"].alias("width"), F.get(part["indices"], 0).alias("at"), "n")
