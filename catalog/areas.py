"""The given tables read as area tables.

area = customer, department = nation, region = region, class = line status,
population = quantity ordered, rates = money per unit by return flag and line
status, firm sizes = orders by price band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table

FLAGS = ("A", "N", "R")
CLASSES = {"F": "f", "O": "o"}
RATES = [f"rate_{fl.lower()}_{c}" for c in CLASSES.values() for fl in FLAGS]
SIZES = ["micro", "small", "medium", "large"]
EDGES = [125000, 250000, 375000]
NUMERIC = ["pop", *RATES, *SIZES, "firms"]


# Every return flag and line status: name and condition, the same in Spark and in the checking SQL.
CELLS = {
    f"{flag.lower()}_{c}": f"l_returnflag = '{flag}' AND l_linestatus = '{status}'" for status, c in CLASSES.items() for flag in FLAGS
}
BANDS = {
    "micro": f"o_totalprice < {EDGES[0]}",
    "small": f"o_totalprice >= {EDGES[0]} AND o_totalprice < {EDGES[1]}",
    "medium": f"o_totalprice >= {EDGES[1]} AND o_totalprice < {EDGES[2]}",
    "large": f"o_totalprice >= {EDGES[2]}",
}


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per area.

    Lines are summed per order before they meet the orders, so the join carries one
    row per order on either side. Money is summed in whole cents, which is exact.
    """
    sums = {"m_all": "sum(cents)", "q_all": "sum(l_quantity)"}
    for name, cond in CELLS.items():
        sums[f"m_{name}"] = f"sum(cents) FILTER (WHERE {cond})"
        sums[f"q_{name}"] = f"sum(l_quantity) FILTER (WHERE {cond})"
    for status, c in CLASSES.items():
        sums[f"pop_{c}"] = f"sum(l_quantity) FILTER (WHERE l_linestatus = '{status}')"
    lines = (
        table(spark, sf_dir, "lineitem")
        .withColumn("cents", F.expr("cast(round(l_extendedprice * 100) as bigint)"))
        .groupBy("l_orderkey")
        .agg(*[F.expr(f"{e} AS {n}") for n, e in sums.items()])
    )
    per_area = (
        table(spark, sf_dir, "orders")
        .join(lines, F.expr("o_orderkey = l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            *[F.expr(f"sum({n}) AS {n}") for n in sums],
            *[F.expr(f"count_if({cond}) AS {n}") for n, cond in BANDS.items()],
            F.expr("count(*) AS firms"),
        )
        .where("q_all IS NOT NULL")
    )
    places = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return places.join(per_area, F.expr("c_custkey = o_custkey")).selectExpr(
        "c_custkey AS area",
        "c_name AS area_name",
        "c_nationkey AS dep",
        "r_regionkey AS reg_no",
        "r_name AS reg",
        "q_all AS pop",
        *[f"pop_{c}" for c in CLASSES.values()],
        *[f"cast(m_{n} as double) / (q_{n} * 100) AS rate_{n}" for n in ("all", *CELLS)],
        *SIZES,
        "firms",
    )


def areas_by_class(df: DataFrame) -> DataFrame:
    """One row per area and class: `class`, and the class's own `pop`."""
    keep = [c for c in df.columns if c not in ("pop", "pop_f", "pop_o")]
    pairs = ", ".join(f"'{k}', pop_{n}" for k, n in CLASSES.items())
    long = df.selectExpr(*keep, f"stack({len(CLASSES)}, {pairs}) AS (class, pop)")
    return long.where("pop IS NOT NULL")


_RATES_SQL = ", ".join(
    f"CAST(sum(cents) FILTER (WHERE {cond}) AS DOUBLE) / (sum(l_quantity) FILTER (WHERE {cond}) * 100) AS rate_{n}"
    for n, cond in CELLS.items()
)

# Common table expressions `simple` (one row per area) and `profile` (area and class).
AREAS_SQL = f"""
lines AS (
  SELECT o_custkey, l_returnflag, l_linestatus, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rates AS (
  SELECT o_custkey AS area, sum(l_quantity) AS pop,
    sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS pop_f,
    sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS pop_o,
    CAST(sum(cents) AS DOUBLE) / (sum(l_quantity) * 100) AS rate_all, {_RATES_SQL}
  FROM lines GROUP BY o_custkey),
sizes AS (
  SELECT o_custkey AS area,
    {", ".join(f"count(*) FILTER (WHERE {cond}) AS {n}" for n, cond in BANDS.items())},
    count(*) AS firms
  FROM orders GROUP BY o_custkey),
simple AS (
  SELECT c_custkey AS area, c_name AS area_name, c_nationkey AS dep, r_regionkey AS reg_no, r_name AS reg,
    rates.* EXCLUDE (area), sizes.* EXCLUDE (area)
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN rates ON rates.area = c_custkey JOIN sizes ON sizes.area = c_custkey),
profile AS (
  SELECT * EXCLUDE (pop, pop_f, pop_o), 'F' AS class, pop_f AS pop FROM simple WHERE pop_f IS NOT NULL
  UNION ALL
  SELECT * EXCLUDE (pop, pop_f, pop_o), 'O' AS class, pop_o AS pop FROM simple WHERE pop_o IS NOT NULL)
"""


def with_areas(select: str, *ctes: str) -> str:
    return "WITH " + ", ".join([AREAS_SQL, *ctes]) + " " + select
