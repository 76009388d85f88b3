"""Compare registered queries with their SQL: python tests/check.py [name ...]"""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def compare(spark_df, con, sql):
    """None if both sides agree in columns, types, rows and values; else what differs."""
    cols = sorted(spark_df.columns)
    got = sorted(([_clean(v) for v in r] for r in spark_df.select(*cols).collect()), key=_key)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean", "DOUBLE": "double", "VARCHAR": "string"}
    theirs = {c: kinds.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    ours = dict(spark_df.dtypes)
    if ours != theirs:
        return f"types differ: { {c: (ours[c], theirs[c]) for c in cols if ours[c] != theirs[c]} }"
    want = rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()
    want = sorted(([_clean(v) for v in r] for r in want), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if list(g) != list(w)]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]} (columns {cols})" if bad else None


def main(names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck()
    queries, oracles = e.queries(), e.oracle_sql()
    failed = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, DATA)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "equal" if problem is None else f"DIFFERS: {problem}"
            else:
                problem, note = None, f"rows only: {len(df.collect())}"
        except Exception as ex:  # noqa: BLE001
            problem = note = f"ERROR {type(ex).__name__}: {str(ex)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - t:6.2f}s  {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
