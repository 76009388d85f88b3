"""Features for models: scaling, one-hot columns, train/test split."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areastats.operators.cleaning import with_constants
from areastats.sources import materialise

#: Most categories a column may have to become columns of its own, or names in a model.
MAX_CATEGORIES = 65536


def hash_split(df: DataFrame, key: str | Sequence[str], test_percent: int = 25, into: str = "split") -> DataFrame:
    """Label rows 'train' or 'test' by a hash of their key.

    The same row gets the same label in every run, however the data is partitioned.
    """
    keys = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    slot = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn(into, F.when(slot < test_percent, "test").otherwise("train"))


def exact_split(df: DataFrame, key: str | Sequence[str], test_percent: float = 25, seed: int = 42, into: str = "split") -> DataFrame:
    """Label exactly ceil(n * test_percent / 100) rows 'test', the others 'train', by a seeded hash of their key.

    The rows with the smallest hashes are the test rows; rows that share a key are told apart by a hash of their
    content. The hash at the cut is an exact order statistic, found digit by digit from counts of prefixes.
    Rows equal in all columns stay together: if the cut falls among them, they are 'train'.
    """
    keys = [key] if isinstance(key, str) else list(key)
    text = lambda cols: [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    by_key = F.md5(F.concat_ws("|", F.lit(str(seed)), *text(keys)))
    mark = F.concat(by_key, F.md5(F.to_json(F.struct(*df.columns))))
    hashes = df.select(mark.alias("h"))
    wanted = math.ceil(hashes.count() * test_percent / 100)
    cut, before = "", 0
    # Three hex digits a step: at most 4,096 counts come to the driver.
    while before < wanted and len(cut) < 64:
        width = min(len(cut) + 3, 64)
        counts = hashes.where(F.col("h").startswith(cut)).groupBy(F.substring("h", 1, width).alias("p")).count()
        for row in counts.orderBy("p").collect():
            cut = row["p"]
            if before + row["count"] > wanted:
                break
            before += row["count"]
        else:
            cut = "g"  # above every hash: all rows
    return df.withColumn(into, F.when(mark < cut, "test").otherwise("train"))


# -- scaling ------------------------------------------------------------------


@dataclass(frozen=True)
class Scaling:
    """Scaling learnt from a table: value -> (value - offset) / width.

    The figures live in the plan as a scalar subquery, computed once per query.
    """

    cols: tuple[str, ...]
    figures: DataFrame

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return with_constants(
            df,
            self.figures.scalar(),
            lambda row: {f"{c}{suffix}": (F.col(c) - row[f"{c}_offset"]) / row[f"{c}_width"] for c in self.cols},
        )


def _scaling(df: DataFrame, cols: Sequence[str], offset, width) -> Scaling:
    parts = []
    for c in cols:
        w = width(c)
        parts.append(offset(c).cast("double").alias(f"{c}_offset"))
        # A constant column is only shifted, so it becomes 0.
        parts.append(F.when(w == 0, F.lit(1.0)).otherwise(w.cast("double")).alias(f"{c}_width"))
    return Scaling(tuple(cols), df.agg(F.struct(*parts).alias("figures")))


def standard_scaling(df: DataFrame, cols: Sequence[str]) -> Scaling:
    """Mean 0 and population standard deviation 1 on the table it is learnt from."""
    return _scaling(df, cols, F.avg, F.stddev_pop)


def minmax_scaling(df: DataFrame, cols: Sequence[str]) -> Scaling:
    """Smallest value 0, largest 1."""
    return _scaling(df, cols, F.min, lambda c: F.max(c) - F.min(c))


# -- one-hot ------------------------------------------------------------------


@dataclass(frozen=True)
class OneHot:
    """Categories per column, in ascending order; the first has no column of its own."""

    categories: dict[str, list]

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.categories.items() for v in values[1:]]

    def columns(self, df: DataFrame, unknown: str = "error") -> DataFrame:
        """Add one 0/1 column per category. An unseen value is an error, or all zeros with "zero"."""
        # Whether a value is known is asked once per column, not once per category.
        seen = {}
        for c, values in self.categories.items():
            known = F.when(F.coalesce(F.col(c).isin(values), F.lit(False)), F.col(c))
            if unknown == "error":
                known = known.otherwise(F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.col(c).cast("string"))))
            seen[f"_known_{c}"] = known
        flags = {
            f"{c}_{v}": F.coalesce((F.col(f"_known_{c}") == F.lit(v)).cast("int"), F.lit(0))
            for c, values in self.categories.items()
            for v in values[1:]
        }
        return df.withColumns(seen).withColumns(flags).drop(*seen)

    def vector(self, df: DataFrame, unknown: str = "error") -> DataFrame:
        """Add a sparse vector `<column>_vec` per column, for columns of many categories."""
        for c, values in self.categories.items():
            text = F.col(c).cast("string")
            texts = [str(v) for v in values]
            if unknown != "error":  # the first category is the one encoded as all zeros
                text = F.when(text.isin(texts), text).otherwise(texts[0])
            index = StringIndexerModel.from_labels(
                texts[1:] + texts[:1],  # the encoder drops the last label
                inputCol=f"_{c}_text",
                outputCol=f"_{c}_index",
                handleInvalid="error",
            )
            df = index.transform(df.withColumn(f"_{c}_text", text))
            encoder = OneHotEncoder(inputCol=f"_{c}_index", outputCol=f"{c}_vec", dropLast=True).fit(df)
            df = encoder.transform(df).drop(f"_{c}_text", f"_{c}_index")
        return df


def fit_one_hot(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_CATEGORIES) -> OneHot:
    """Learn the categories of all columns in one pass; they are collected, as part of the model.

    A column with more than `max_categories` is an error, not cut short: no more than that many
    a column, and one, ever come to the driver. For longer lists there is `category_codes`.
    """
    if not cols:
        return OneHot({})
    tagged = [F.struct(F.lit(i).alias("at"), *[(F.col(c) if c == own else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{j}") for j, c in enumerate(cols)]) for i, own in enumerate(cols)]
    # Equal values are dropped before the shuffle, so it carries a column's categories and not its rows.
    values = df.select(F.explode(F.array(*tagged)).alias("t")).select("t.*").distinct()
    values = values.where(F.coalesce(*[F.col(f"v{j}").cast("string") for j in range(len(cols))]).isNotNull())
    found: dict[str, list] = {c: [] for c in cols}
    for row in values.limit(len(cols) * max_categories + 1).collect():
        found[cols[row["at"]]].append(row[f"v{row['at']}"])
    for c, seen in found.items():
        if len(seen) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories")
    return OneHot({c: sorted(seen) for c, seen in found.items()})


# -- columns of very many categories ------------------------------------------


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """Dictionary of a column: (value, code), numbered from 0 in ascending order, written once.

    NULL is no category. The distinct values are cut into ranges, each is numbered by itself and gets
    the counts of the ranges before it, so no task and no driver holds all of them.
    """
    values = df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = values.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id())
    ranges = materialise(ranges, "categories")
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # Unpartitioned, but over one row per range.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    numbered = ranges.withColumn("at", inside).join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    return materialise(numbered.select("value", (F.col("before") + F.col("at")).cast("int").alias("code")), "categories")


def code_column(df: DataFrame, col: str, codes: DataFrame, into: str, unknown: str = "error") -> DataFrame:
    """Add the code of each row's value; an unseen or missing value is an error, or NULL with "zero"."""
    names = {"value": "_value", "code": into}
    found = df.join(codes.withColumnsRenamed(names), F.col(col) == F.col("_value"), "left").drop("_value")
    if unknown != "error":
        return found
    text = F.coalesce(F.col(col).cast("string"), F.lit("no value"))
    unseen = F.raise_error(F.concat(F.lit(f"unseen category in {col}: "), text)).cast("int")
    return found.withColumn(into, F.coalesce(into, unseen))


def coded_vector(df: DataFrame, col: str, codes: DataFrame, into: str | None = None, unknown: str = "error") -> DataFrame:
    """Add the sparse vector of a column by its dictionary: `<column>_vec`, as `OneHot.vector` gives it.

    The first category, and an unseen value with "zero", have no one in it. The vector carries no
    names; the part at i stands for code i + 1.
    """
    into = into or f"{col}_vec"
    coded = code_column(df, col, codes, "_code", unknown)
    width = codes.agg(F.greatest(F.coalesce(F.max("code"), F.lit(0)), F.lit(0)).cast("int")).scalar()
    one = F.col("_code") > 0
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        width.alias("size"),
        F.when(one, F.array(F.col("_code") - 1)).otherwise(F.array().cast("array<int>")).alias("indices"),
        F.when(one, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"),
    )
    # Spark has no cast from the parts of a sparse vector to the vector, but reads them as one.
    read = F.from_json(F.to_json(F.struct(vector.alias("v"))), StructType().add("v", VectorUDT()))
    return coded.withColumn(into, read["v"]).drop("_code")


def assemble(df: DataFrame, cols: Sequence[str], into: str = "features") -> DataFrame:
    """Gather feature columns in one vector; a missing value is an error."""
    return VectorAssembler(inputCols=list(cols), outputCol=into, handleInvalid="error").transform(df)


def vector_names(df: DataFrame, col: str = "features") -> list[str]:
    """Names of the parts of an assembled vector, from its metadata."""
    attrs = df.schema[col].metadata["ml_attr"]["attrs"]
    parts = [(a["idx"], a["name"]) for kind in attrs.values() for a in kind]
    return [name for _, name in sorted(parts)]
