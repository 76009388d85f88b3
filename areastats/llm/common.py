"""What several operators share: word splitting, written intermediates, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areastats.sources.tables import scratch_path

#: Separators between words: space and the ASCII control characters from tab to return.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"


def split_words(text: Column) -> Column:
    """Words of a text as an array; a NULL or blank text has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR_RUN, -1))


def byte_words(text: str | None) -> list[bytes]:
    """The same words, as lower-cased bytes (A-Z only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written to the folder that the cluster shares, and removed when no longer needed.

    A written table replaces the lineage behind it: losing an executor costs no recomputation.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table once and read it back; `drop` removes it."""
        path = scratch_path(self.spark, f"llm-{name}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest member of the connected component of every node that has an edge.

    Returns (node, component). Alternating large and small stars: every round hangs each
    node's larger neighbours, then its smaller ones, on its smallest neighbour. Rounds
    grow with the logarithm of the longest path. A node's neighbours are never collected:
    each round takes minima, which tasks combine before the shuffle, and joins them back.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    current = scratch.store(edges.select(high, low).where("u > v").distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    mark = print_of(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(low, "u").select(ends.alias("e")).select("e.u", "e.v").where("u > v").distinct()
        following = scratch.store(small, "edges")
        scratch.drop(current)
        current, before, mark = following, mark, print_of(following)
        if mark == before:
            break
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
