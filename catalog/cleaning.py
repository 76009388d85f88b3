"""Cleaning: filters, recodes, lookups, duplicates, column shapes."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from areastats.functions import code_prefix_fill, decimal_comma, differs, in_range, map_values, not_in, pad_code, percent, replace_text, round_to
from areastats.operators import cleaning as c
from areastats.operators import stats
from areastats.sources import read_table, scratch_path, write_table
from catalog.areas import SIZES, areas, with_areas
from catalog.registry import query, r, table

# Mappings used on both sides.
NATION_RECODES = {1: 2, 2: 3, 7: 20, 9: 20, 11: 24}
SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "MACHINERY": 4}


def _case(col: str, mapping: dict, default: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {' '.join(f'WHEN {col} = {lit(k)} THEN {lit(v)}' for k, v in mapping.items())} ELSE {default} END"


@query(
    "filter_exclude_codes",
    """SELECT c_custkey, seg, c_nationkey, c_acctbal FROM
       (SELECT *, nullif(c_mktsegment, 'MACHINERY') AS seg FROM customer)
       WHERE c_nationkey NOT IN (1, 2, 3, 4, 5, 6) AND (seg <> 'BUILDING' OR seg IS NULL)
         AND c_acctbal >= 15 AND c_acctbal < 6500""",
)
def filter_exclude_codes(spark, d):
    seg = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    rows = table(spark, d, "customer").withColumn("seg", seg)
    kept = rows.where(not_in("c_nationkey", [1, 2, 3, 4, 5, 6]) & differs("seg", "BUILDING") & in_range("c_acctbal", 15, 6500))
    return kept.select("c_custkey", "seg", "c_nationkey", "c_acctbal")


@query(
    "recode_regions",
    f"""SELECT c_custkey, CAST({_case('c_nationkey', NATION_RECODES, 'c_nationkey')} AS INTEGER) AS c_nationkey,
        {_case('c_mktsegment', {'BUILDING': '20', 'MACHINERY': '96'}, 'c_mktsegment')} AS c_mktsegment FROM customer""",
)
def recode_regions(spark, d):
    rows = c.recode(table(spark, d, "customer"), "c_nationkey", NATION_RECODES, cast="int")
    rows = c.recode(rows, "c_mktsegment", {"BUILDING": "20", "MACHINERY": "96"})
    return rows.select("c_custkey", "c_nationkey", "c_mktsegment")


@query(
    "recode_columns",
    """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS INTEGER) AS status,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders""",
)
def recode_columns(spark, d):
    labels = {"F": 1, "O": 2, "P": 3, "1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return c.recode(rows, ["status", "priority"], labels, default="null", cast="int")


@query(
    "map_or_null",
    f"""SELECT c_custkey, CAST({_case('c_mktsegment', SEGMENT_CODES, 'NULL')} AS INTEGER) AS seg_no,
        {_case('c_nationkey', {1: 'one', 2: 'two'}, 'NULL')} AS name FROM customer""",
)
def map_or_null(spark, d):
    names = {"one": 1, "two": 2}
    rows = c.recode(table(spark, d, "customer"), "c_mktsegment", SEGMENT_CODES, "null", cast="int", into="seg_no")
    return rows.select("c_custkey", "seg_no", map_values("c_nationkey", c.invert_mapping(names), "null").alias("name"))


@query(
    "lookup_enrich",
    """SELECT s_suppkey, s_nationkey, n_name, r_name FROM supplier
       LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 0) ON s_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def lookup_enrich(spark, d):
    nations = table(spark, d, "nation").where(F.col("n_nationkey") % 6 != 0)
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = c.lookup(rows, nations, "s_nationkey", {"n_name": "n_name", "n_regionkey": "reg"}, ref_key="n_nationkey")
    return c.lookup(rows, table(spark, d, "region"), "reg", "r_name", ref_key="r_regionkey").drop("reg")


@query(
    "lookup_last_wins",
    """SELECT c_custkey, o_orderstatus AS last_status, o_totalprice AS last_price FROM customer LEFT JOIN
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
       ON c_custkey = o_custkey AND rn = 1""",
)
def lookup_last_wins(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    new = {"o_orderstatus": "last_status", "o_totalprice": "last_price"}
    people = table(spark, d, "customer").select("c_custkey")
    return c.lookup(people, orders, "c_custkey", new, order=["o_orderdate", "o_orderkey"], ref_key="o_custkey")


@query(
    "override_fill_prefix",
    """SELECT c_custkey,
         CASE WHEN c_name = 'Customer#000000007' THEN 52 WHEN c_name = 'Customer#000000011' THEN 44
              WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END AS reg,
         coalesce(CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END,
                  substr(replace(replace(code, '2A', '20'), '2B', '20'), 1, 2)) AS dep,
         replace(replace(code, '2A', '20'), '2B', '20') AS code
       FROM (SELECT *, CASE WHEN c_nationkey = 20 THEN '2A' WHEN c_nationkey = 15 THEN '2B'
                       ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code
             FROM customer)""",
)
def override_fill_prefix(spark, d):
    nation = F.col("c_nationkey")
    area_code = F.concat(
        F.when(nation == 20, "2A").when(nation == 15, "2B").otherwise(pad_code("c_nationkey", 2)), pad_code("c_custkey", 9)
    )
    known = nation % 5 != 0
    rows = table(spark, d, "customer").select(
        "c_custkey",
        "c_name",
        F.when(known, nation).alias("reg"),
        F.when(known, pad_code("c_nationkey", 2)).alias("dep"),
        replace_text(area_code, {"2A": "20", "2B": "20"}).alias("code"),
    )
    rows = c.override(
        rows,
        [(F.col("c_name") == "Customer#000000007", "reg", 52), (F.col("c_name") == "Customer#000000011", "reg", 44)],
    )
    return rows.withColumn("dep", code_prefix_fill("dep", "code", 2)).drop("c_name")


_LON = "CASE WHEN c_custkey % 13 = 0 THEN '-' ELSE replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '.', ',') END"


def _texts(spark, d):
    money = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    return table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 13 == 0, "-").otherwise(F.replace(money, F.lit("."), F.lit(","))).alias("lon"),
        F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(money).alias("lat"),
    )


@query(
    "text_to_number",
    f"""SELECT c_custkey, try_cast(replace({_LON}, ',', '.') AS DOUBLE) AS lon, c_acctbal AS lat
        FROM customer WHERE c_custkey % 7 <> 0""",
)
def text_to_number(spark, d):
    rows = _texts(spark, d).withColumn("lon", decimal_comma("lon"))
    return c.coerce_numeric(rows, ["lat"])


@query(
    "quality_counts",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE lon = '-') AS n_sentinel,
        count(*) FILTER (WHERE c_custkey % 7 = 0) AS n_bad_lat, count(DISTINCT lon) AS n_lon
        FROM (SELECT c_custkey, {_LON} AS lon FROM customer)""",
)
def quality_counts(spark, d):
    rules = {"n_sentinel": F.col("lon") == "-", "n_bad_lat": F.col("lat").try_cast("double").isNull()}
    return c.quality_counts(_texts(spark, d), rules, {"n_lon": "lon"})


@query(
    "dedupe_first",
    """SELECT * EXCLUDE (rn) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_first(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    return c.keep_first(table(spark, d, "lineitem").select(*cols), cols[:2], cols[2:])


@query(
    "size_bands",
    """SELECT o_custkey, e1 + e2 AS small_orders, e3 + e4 AS large_orders, e1 + e2 + e3 + e4 AS all_orders FROM
       (SELECT o_custkey, count(*) FILTER (WHERE o_totalprice < 125000) AS e1,
          count(*) FILTER (WHERE o_totalprice >= 125000 AND o_totalprice < 250000) AS e2,
          count(*) FILTER (WHERE o_totalprice >= 250000 AND o_totalprice < 375000) AS e3,
          count(*) FILTER (WHERE o_totalprice >= 375000) AS e4 FROM orders GROUP BY o_custkey)""",
)
def size_bands(spark, d):
    price = F.col("o_totalprice")
    fine = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count_if(price < 125000).alias("e1"),
        F.count_if(in_range(price, 125000, 250000)).alias("e2"),
        F.count_if(in_range(price, 250000, 375000)).alias("e3"),
        F.count_if(price >= 375000).alias("e4"),
    )
    rows = c.sum_columns(fine, {"small_orders": ["e1", "e2"], "large_orders": ["e3", "e4"]}, drop=True)
    return c.sum_columns(rows, {"all_orders": ["small_orders", "large_orders"]})


@query(
    "rollup_population",
    """SELECT l_linestatus, l_returnflag, l_suppkey, sum(l_quantity) AS l_quantity FROM lineitem
       WHERE l_linenumber >= 2 AND l_linenumber < 6 AND l_discount <> 0 GROUP BY ALL""",
)
def rollup_population(spark, d):
    rows = table(spark, d, "lineitem").where(in_range("l_linenumber", 2, 6) & differs("l_discount", 0))
    rows = c.drop_columns(rows, ["l_linenumber", "l_discount"], strict=True)
    return stats.group_sums(rows, ["l_linestatus", "l_returnflag", "l_suppkey"], ["l_quantity"])


@query(
    "shape_columns",
    "SELECT p_partkey AS part, p_type AS kind, p_size AS size FROM part",
)
def shape_columns(spark, d):
    rows = c.drop_columns(table(spark, d, "part"), ["p_name", "p_retailprice", "not_there"])
    rows = c.rename_columns(rows, {"p_partkey": "part"})
    rows = rows.select(*c.present_columns(rows, ["part", "p_size", "p_type", "other"]))
    return c.rename_columns(rows, ["part", "kind", "size"])


@query(
    "ratio_rounding",
    f"""SELECT o_orderkey, {r('CASE WHEN p = 0 THEN NULL ELSE q / p END * 100', 4)} AS pct,
        abs(CAST(o_totalprice AS DOUBLE) - 250000) AS off FROM
        (SELECT o_orderkey, o_totalprice, o_custkey % 7 AS p, o_orderkey % 11 AS q FROM orders)""",
)
def ratio_rounding(spark, d):
    rows = table(spark, d, "orders")
    pct = percent(F.col("o_orderkey") % 11, F.col("o_custkey") % 7)
    return rows.select("o_orderkey", round_to(pct, 4, "half_up").alias("pct"), F.abs(F.col("o_totalprice") - 250000).alias("off"))


@query(
    "half_even_rounding",
    """SELECT o_orderkey, round_even(CAST(o_custkey % 1000 AS DOUBLE) / 8, 2) AS even,
        CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE round_even(CAST(o_orderkey % 16 AS DOUBLE) / 32 * 100, 1) END AS pct FROM orders""",
)
def half_even_rounding(spark, d):
    """Eighths and thirty-seconds: every tie is exact, and goes to the even digit."""
    pct = F.when(F.col("o_custkey") % 7 != 0, round_to(percent(F.col("o_orderkey") % 16, F.lit(32)), 1))
    return table(spark, d, "orders").select("o_orderkey", round_to((F.col("o_custkey") % 1000) / 8).alias("even"), pct.alias("pct"))


@query("distinct_values", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_values(spark, d):
    return c.distinct_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "outlier_filter",
    with_areas("SELECT area, rate_a_f FROM simple WHERE rate_a_f < 1500 OR rate_a_f IS NULL"),
)
def outlier_filter(spark, d):
    return c.drop_where(areas(spark, d), F.col("rate_a_f") >= 1500).select("area", "rate_a_f")


@query(
    "drop_null_rows",
    with_areas("SELECT area, rate_a_f, rate_a_o FROM simple WHERE rate_a_f IS NOT NULL AND rate_a_o IS NOT NULL"),
)
def drop_null_rows(spark, d):
    return c.drop_null(areas(spark, d).select("area", "rate_a_f", "rate_a_o"), ["rate_a_f", "rate_a_o"])


@query(
    "outlier_listing",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_totalprice >= 400000) WHERE rn = 1""",
)
def outlier_listing(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_totalprice") >= 400000)
    rows = rows.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return c.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_CSV_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("seg", T.StringType()),
        T.StructField("balance", T.DoubleType()),
    ]
)


@query(
    "csv_round_trip",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code, c_name AS name,
       nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal AS balance FROM customer""",
)
def csv_round_trip(spark, d):
    rows = table(spark, d, "customer").select(
        pad_code("c_custkey", 9).alias("code"),
        F.col("c_name").alias("name"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"),
        F.col("c_acctbal").alias("balance"),
    )
    path = scratch_path(spark, "csv")
    write_table(rows, path, "csv")
    return read_table(spark, path, _CSV_SCHEMA)


@query(
    "csv_missing_markers",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS seg,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer""",
)
def csv_missing_markers(spark, d):
    """Texts such as NA and NaN in a file stand for missing fields, in text and number columns."""
    rows = table(spark, d, "customer").select(
        pad_code("c_custkey", 9).alias("code"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "N/A").otherwise(F.col("c_mktsegment")).alias("seg"),
        F.when(F.col("c_acctbal") < -500, "NA").when(F.col("c_acctbal") < 0, "NaN")
        .otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
    )
    path = scratch_path(spark, "csv")
    write_table(rows, path, "csv")
    return read_table(spark, path, _CSV_SCHEMA)


@query(
    "size_totals_by_region",
    with_areas(f"SELECT reg, {', '.join(f'CAST(sum({s}) AS BIGINT) AS {s}' for s in SIZES)} FROM simple GROUP BY reg"),
)
def size_totals_by_region(spark, d):
    return stats.group_sums(areas(spark, d), ["reg"], SIZES)


