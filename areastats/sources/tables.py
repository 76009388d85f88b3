"""Delimited and columnar tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("csv", "parquet", "json")
# Texts that stand for a missing field.
MISSING = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    fmt: str = "csv",
    missing: Sequence[str] = MISSING,
    **options,
) -> DataFrame:
    """Read a table with a stated schema.

    CSV needs the schema: an inferred one costs a pass over the data and turns codes
    such as '01' into numbers. CSV columns are found by their header, whatever their
    order; columns not in the schema are left unread. An empty field and a text of
    `missing` are NULL. The files of one folder must have the same header: a file with
    another one is an error, never a mix-up of columns.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.options(**options)
    if fmt != "csv":
        return (reader.schema(schema) if schema is not None else reader).format(fmt).load(path)
    if schema is None:
        raise ValueError("a CSV table needs a schema")
    fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields
    texts = reader.option("header", True).option("enforceSchema", False).csv(path)

    def known(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(~c.isin(*missing), c) if missing else c

    return texts.select(*[known(f.name).cast(f.dataType).alias(f.name) for f in fields])


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a result table; `partition_by` lets later readers skip whole folders."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table, in the folder the cluster shares.

    A local session without such a folder gets a temporary one; a cluster session
    must name it, because executors cannot see the driver's own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="areastats-")
    return f"{base.rstrip('/')}/areastats/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back.

    For results that several later steps scan: the written table is not recomputed
    when an executor is lost, and each step reads only the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what `materialise` has written, once nothing reads it any more."""
    for df in tables:
        drop_path(df.sparkSession, df._scratch)
