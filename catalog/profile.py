"""The whole preparation: four sources cleaned, enriched and fused to area profiles."""

from pyspark.sql import functions as F

from areastats.functions import in_range, pad_code
from areastats.plans.profile import ProfileRules, build_profile, collapse_profile
from areastats.sources import materialise
from catalog.registry import query, table

FINE = [f"e{i}" for i in range(1, 9)]
EDGES = [0, 60000, 125000, 190000, 250000, 310000, 375000, 440000, 10**12]
WAGES = {"w_f": "rate_f", "w_o": "rate_o", "w_all": "rate_all"}
RULES = ProfileRules(
    sizes={"micro": FINE[0:2], "small": FINE[2:4], "medium": FINE[4:6], "large": FINE[6:8]},
    rates=WAGES,
    region_names={100: "North", 105: "East", 110: "South", 115: "West", 120: "Centre"},
    excluded_regions=[104],
    region_recodes={100 + k: 100 + 5 * (k // 5) for k in range(25) if k % 5},
    dep_recodes={"2A": "20", "2B": "96"},
    code_replacements={"2A": "20", "2B": "20"},
    region_fixes=[("area", "Town 53", 110)],
    dep_fixes=[("area", "Town 53", "55")],
)


def _places(spark, d):
    """Town name, codes and old region number of every customer; every tenth shares its name with the one before."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    dep = F.when(nation == 20, "2A").when(nation == 21, "2B").otherwise(pad_code("c_nationkey", 2))
    return table(spark, d, "customer").select(
        key.alias("key"),
        F.concat(F.lit("Town "), (key - F.when(key % 10 == 9, 1).otherwise(0)).cast("string")).alias("area"),
        dep.alias("dep"),
        F.concat(dep, pad_code("c_custkey", 9)).alias("code"),
        (nation + 100).alias("reg"),
    )


def sources(spark, d):
    """(population, geography, establishments, wages) in the shape the preparation expects."""
    places = _places(spark, d)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    # Lines are summed before they are joined: a few rows per order go into the shuffle.
    lines = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey", "l_linestatus", "l_linenumber")
        .agg(F.sum("l_quantity").alias("n"), F.sum(cents).alias("cents"))
        .join(orders.drop("o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_linestatus", "l_linenumber")
        .agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    )
    lines = materialise(lines, "lines")
    firms = orders.groupBy("o_custkey").agg(
        *[F.count_if(in_range("o_totalprice", lo, hi)).alias(e) for e, lo, hi in zip(FINE, EDGES, EDGES[1:])]
    )
    key = F.col("key")

    population = lines.join(places, F.col("o_custkey") == key).select(
        "code",
        "area",
        (F.col("l_linenumber") * 10).alias("age"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("class"),
        "n",
    )
    lon = ((key % 199).cast("double") / 10 - 10).cast("string")
    geography = places.select(
        "area",
        "dep",
        "reg",
        (35 + (key % 299).cast("double") / 10).alias("latitude"),
        F.when(key % 97 == 0, "-").when(key % 89 != 0, F.replace(lon, F.lit("."), F.lit(","))).alias("longitude"),
    )
    establishments = firms.join(places, F.col("o_custkey") == key).where(key % 53 != 0)
    establishments = establishments.select("code", "area", F.when(key % 41 != 0, F.col("dep")).alias("dep"), "reg", *FINE)

    def rate(cond=None):
        pick = (lambda c: F.col(c)) if cond is None else (lambda c: F.when(cond, F.col(c)))
        return F.sum(pick("cents")).cast("double") / (F.sum(pick("n")) * 100)

    status = F.col("l_linestatus")
    rates = lines.groupBy("o_custkey").agg(rate(status == "F").alias("w_f"), rate(status == "O").alias("w_o"), rate().alias("w_all"))
    wages = rates.join(places, F.col("o_custkey") == key).where(key % 31 != 0).select("code", "area", *WAGES)
    return population, geography, establishments, wages


def _reg(c: str) -> str:
    return f"CASE WHEN {c} BETWEEN 100 AND 124 THEN 100 + 5 * (({c} - 100) // 5) ELSE {c} END"


_CODE = "replace(replace({c}, '2A', '20'), '2B', '20')"
_DEP = "CASE {c} WHEN '2A' THEN '20' WHEN '2B' THEN '96' ELSE {c} END"
_FINE_SQL = ", ".join(
    f"count(*) FILTER (WHERE o_totalprice >= {lo} AND o_totalprice < {hi}) AS {e}" for e, lo, hi in zip(FINE, EDGES, EDGES[1:])
)
PROFILE_SQL = f"""WITH
places AS (SELECT c_custkey AS key, 'Town ' || (c_custkey - CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END) AS area,
    CASE c_nationkey WHEN 20 THEN '2A' WHEN 21 THEN '2B' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS dep,
    dep || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code, c_nationkey + 100 AS reg FROM customer),
lines AS (SELECT o_custkey AS key, l_linestatus AS st, l_linenumber * 10 AS age, l_quantity AS q,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
est AS (SELECT code, area, CASE WHEN key % 41 <> 0 THEN dep END AS dep, {_reg('reg')} AS reg, f.* EXCLUDE (o_custkey)
    FROM (SELECT o_custkey, {_FINE_SQL} FROM orders GROUP BY 1) f JOIN places ON key = o_custkey WHERE key % 53 <> 0 AND reg <> 104),
geo AS (SELECT area, {_DEP.format(c='dep')} AS dep, {_reg('reg')} AS reg, 35 + CAST(key % 299 AS DOUBLE) / 10 AS latitude,
    CASE WHEN key % 89 <> 0 THEN CAST(key % 199 AS DOUBLE) / 10 - 10 END AS longitude
    FROM places WHERE key % 97 <> 0 AND reg <> 104),
pop AS (SELECT p.area, CASE WHEN st = 'O' THEN 1 ELSE 2 END AS class, {_CODE.format(c='p.code')} AS code, est.reg,
    {_DEP.format(c='est.dep')} AS dep, sum(q) AS pop
    FROM lines JOIN places p USING (key) JOIN est ON est.code = p.code WHERE age >= 15 AND age < 65 AND est.dep IS NOT NULL GROUP BY ALL),
wages AS (SELECT {_CODE.format(c='p.code')} AS code, p.area, est.reg,
    coalesce({_DEP.format(c='est.dep')}, substr({_CODE.format(c='p.code')}, 1, 2)) AS dep, rate_f, rate_o, rate_all
    FROM (SELECT key, CAST(sum(cents) FILTER (WHERE st = 'F') AS DOUBLE) / (sum(q) FILTER (WHERE st = 'F') * 100) AS rate_f,
            CAST(sum(cents) FILTER (WHERE st = 'O') AS DOUBLE) / (sum(q) FILTER (WHERE st = 'O') * 100) AS rate_o,
            CAST(sum(cents) AS DOUBLE) / (sum(q) * 100) AS rate_all FROM lines GROUP BY key)
    JOIN places p USING (key) JOIN est ON est.code = p.code WHERE key % 31 <> 0),
firms AS (SELECT {_CODE.format(c='code')} AS code, area, {_DEP.format(c='dep')} AS dep, reg, e1 + e2 AS micro, e3 + e4 AS small,
    e5 + e6 AS medium, e7 + e8 AS large, e1 + e2 + e3 + e4 + e5 + e6 + e7 + e8 AS firms FROM est),
fused AS (SELECT pop.area, pop.class, pop.reg, pop.dep, pop.pop, rate_f, rate_o, rate_all, micro, small, medium, large, firms,
    latitude, longitude, CASE pop.reg WHEN 100 THEN 'North' WHEN 105 THEN 'East' WHEN 110 THEN 'South' WHEN 115 THEN 'West'
      WHEN 120 THEN 'Centre' END AS reg_name,
    row_number() OVER (PARTITION BY pop.area, pop.class ORDER BY pop.code, pop.dep, pop.reg, latitude, longitude NULLS FIRST) AS rn
    FROM pop JOIN wages USING (code, area, reg, dep) JOIN firms USING (code, area, reg, dep) JOIN geo USING (area, dep, reg)),
full_profile AS (SELECT * EXCLUDE (rn) FROM fused WHERE rn = 1)
"""


@query("profile_full", PROFILE_SQL + "SELECT * FROM full_profile")
def profile_full(spark, d):
    return build_profile(*sources(spark, d), RULES)


@query(
    "profile_collapsed",
    PROFILE_SQL
    + """SELECT area, sum(pop) AS pop, """
    + ", ".join(
        f"arg_min({c}, class) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ["reg", "reg_name", "dep", *WAGES.values(), "micro", "small", "medium", "large", "firms"]
    )
    + " FROM full_profile GROUP BY area",
)
def profile_collapsed(spark, d):
    return collapse_profile(build_profile(*sources(spark, d), RULES), RULES)


