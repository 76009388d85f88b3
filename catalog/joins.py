"""Joins on keys."""

from pyspark.sql import functions as F

from areastats.operators import joins as j
from areastats.operators.cleaning import keep_first
from catalog.areas import areas, areas_by_class, with_areas
from catalog.registry import query, table

# Two overlapping sets of places: areas with many large orders, and areas with many small ones.
_SETS = """many AS (SELECT o_custkey AS area, o_orderstatus AS st, count(*) AS n FROM orders
             WHERE o_totalprice >= 375000 GROUP BY ALL HAVING count(*) >= 2),
           few AS (SELECT o_custkey AS area, o_orderstatus AS st, count(*) AS n FROM orders
             WHERE o_totalprice < 125000 GROUP BY ALL HAVING count(*) >= 2)"""


def _sets(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("area"), F.col("o_orderstatus").alias("st"), "o_totalprice")

    def group(cond):
        return orders.where(cond).groupBy("area", "st").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)

    return group(F.col("o_totalprice") >= 375000), group(F.col("o_totalprice") < 125000)


@query(
    "left_join",
    """SELECT s_suppkey, s_nationkey, n_name FROM supplier
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey""",
)
def left_join(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return j.equi_join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), nations, ["s_nationkey"], "left")


@query(
    "multi_key_inner",
    with_areas(
        """SELECT a.area, a.dep, a.reg, a.pop AS pop_x, b.pop AS pop_y FROM profile a JOIN profile b
           ON a.area = b.area AND a.dep = b.dep AND a.reg = b.reg WHERE a.class = 'F' AND b.class = 'O'"""
    ),
)
def multi_key_inner(spark, d):
    rows = areas_by_class(areas(spark, d)).select("area", "dep", "reg", "class", "pop")
    first, second = (rows.where(F.col("class") == k).drop("class") for k in ("F", "O"))
    return j.equi_join(first, second, ["area", "dep", "reg"])


@query(
    "null_safe_join",
    """WITH a AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey AS dep, count(*) AS n FROM customer GROUP BY ALL),
            b AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey AS dep, max(c_acctbal) AS top FROM customer
                  WHERE c_acctbal > 5000 GROUP BY ALL)
       SELECT a.seg, a.dep, n, top FROM a JOIN b ON a.seg IS NOT DISTINCT FROM b.seg AND a.dep = b.dep""",
)
def null_safe_join(spark, d):
    rows = table(spark, d, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.col("c_nationkey").alias("dep"), "c_acctbal"
    )
    a = rows.groupBy("seg", "dep").agg(F.count(F.lit(1)).alias("n"))
    b = rows.where("c_acctbal > 5000").groupBy("seg", "dep").agg(F.max("c_acctbal").alias("top"))
    return j.equi_join(a, b, ["seg", "dep"], null_safe=True)


_NULL_SETS = """many AS (SELECT nullif(o_orderstatus, 'F') AS st, nullif(o_orderpriority, '1-URGENT') AS pr, count(*) AS n
             FROM orders WHERE o_totalprice >= 375000 GROUP BY ALL),
           few AS (SELECT nullif(o_orderstatus, 'F') AS st, nullif(o_orderpriority, '1-URGENT') AS pr, count(*) AS m
             FROM orders WHERE o_totalprice < 125000 AND o_orderpriority <> '5-LOW' GROUP BY ALL)"""


def _null_sets(spark, d):
    orders = table(spark, d, "orders")
    keys = [F.nullif("o_orderstatus", F.lit("F")).alias("st"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("pr")]
    many, few = orders.where("o_totalprice >= 375000"), orders.where("o_totalprice < 125000 AND o_orderpriority <> '5-LOW'")
    return many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), few.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))


_NULL_SAFE = "many.st IS NOT DISTINCT FROM few.st AND many.pr IS NOT DISTINCT FROM few.pr"
_PRESENCE = "CASE WHEN m IS NULL THEN 'left_only' WHEN n IS NULL THEN 'right_only' ELSE 'both' END"


@query(
    "presence_join_null_safe",
    f"""WITH {_NULL_SETS} SELECT coalesce(many.st, few.st) AS st, coalesce(many.pr, few.pr) AS pr, n, m, {_PRESENCE} AS presence
        FROM many FULL JOIN few ON {_NULL_SAFE}""",
)
def presence_join_null_safe(spark, d):
    return j.presence_join(*_null_sets(spark, d), ["st", "pr"], null_safe=True)


@query(
    "unmatched_null_safe",
    f"""WITH {_NULL_SETS} SELECT * FROM (
          SELECT coalesce(many.st, few.st) AS st, coalesce(many.pr, few.pr) AS pr, n, m, {_PRESENCE} AS presence
          FROM many FULL JOIN few ON {_NULL_SAFE}) WHERE presence <> 'both'""",
)
def unmatched_null_safe(spark, d):
    return j.unmatched(*_null_sets(spark, d), ["st", "pr"], null_safe=True)


@query(
    "align_null_safe",
    f"""WITH {_NULL_SETS} SELECT coalesce(many.st, few.st) AS st, coalesce(many.pr, few.pr) AS pr, n, m
        FROM many FULL JOIN few ON {_NULL_SAFE}""",
)
def align_null_safe(spark, d):
    return j.align(*_null_sets(spark, d), ["st", "pr"], null_safe=True)


@query(
    "presence_join",
    f"""WITH {_SETS} SELECT area, st, many.n AS n_x, few.n AS n_y,
        CASE WHEN few.n IS NULL THEN 'left_only' WHEN many.n IS NULL THEN 'right_only' ELSE 'both' END AS presence
        FROM many FULL JOIN few USING (area, st)""",
)
def presence_join(spark, d):
    return j.presence_join(*_sets(spark, d), ["area", "st"])


@query(
    "unmatched",
    f"""WITH {_SETS} SELECT *, 'left_only' AS presence FROM many ANTI JOIN few USING (area, st)
        UNION ALL SELECT *, 'right_only' AS presence FROM few ANTI JOIN many USING (area, st)""",
)
def unmatched(spark, d):
    return j.unmatched(*_sets(spark, d), ["area", "st"])


@query(
    "unmatched_count",
    f"""WITH {_SETS}, m AS (SELECT many.n AS a, few.n AS b FROM many FULL JOIN few USING (area, st))
        SELECT CASE WHEN b IS NULL THEN 'left_only' ELSE 'right_only' END AS presence, count(*) AS n
        FROM m WHERE a IS NULL OR b IS NULL GROUP BY ALL""",
)
def unmatched_count(spark, d):
    both = j.presence_join(*_sets(spark, d), ["area", "st"])
    return both.where(F.col("presence").isin("left_only", "right_only")).groupBy("presence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "intersect_all",
    """SELECT o_custkey AS area, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1
       HAVING n_f > 0 AND n_o > 0 AND n_p > 0""",
)
def intersect_all(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("area"), "o_orderstatus")
    frames = [
        orders.where(F.col("o_orderstatus") == s).groupBy("area").agg(F.count(F.lit(1)).alias(f"n_{s.lower()}")) for s in "FOP"
    ]
    return j.intersect_all(frames, ["area"])


@query(
    "align_groups",
    """WITH a AS (SELECT o_custkey AS area, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
            b AS (SELECT o_custkey AS area, count(*) AS n_low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)
       SELECT area, n_urgent, n_low, n_urgent + n_low AS n_both FROM a FULL JOIN b USING (area)""",
)
def align_groups(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("area"), "o_orderpriority")

    def count(priority, name):
        return orders.where(F.col("o_orderpriority") == priority).groupBy("area").agg(F.count(F.lit(1)).alias(name))

    pair = j.align(count("1-URGENT", "n_urgent"), count("5-LOW", "n_low"), ["area"])
    return pair.withColumn("n_both", F.col("n_urgent") + F.col("n_low"))


@query(
    "first_line_join",
    """WITH l AS (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey, l_suppkey FROM lineitem
                  ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber)
       SELECT o_orderkey, o_custkey, l_partkey, l_suppkey FROM orders JOIN l ON o_orderkey = l_orderkey""",
)
def first_line_join(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    first = keep_first(lines, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"]).drop("l_linenumber")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return j.equi_join(orders, first.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])
