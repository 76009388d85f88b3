"""Geographic feature files (GeoJSON)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from areastats.sources.tables import materialise

# `coordinates` is kept as text, so polygons and multi-polygons share one schema.
FEATURE_SCHEMA = StructType(
    [
        StructField("properties", MapType(StringType(), StringType())),
        StructField(
            "geometry",
            StructType([StructField("type", StringType()), StructField("coordinates", StringType())]),
        ),
    ]
)


def explode_features(features: DataFrame, column: str, props: Sequence[str]) -> DataFrame:
    """One row per feature: the wanted properties, geometry type and raw coordinates.

    `column` holds a parsed feature (see FEATURE_SCHEMA).
    """
    feature = F.col(column)
    return features.select(
        *[feature["properties"][p].alias(p) for p in props],
        feature["geometry"]["type"].alias("geometry_type"),
        feature["geometry"]["coordinates"].alias("coordinates"),
    )


def read_features(
    spark: SparkSession, path: str, props: Sequence[str], lines: bool = False
) -> DataFrame:
    """Read features to rows.

    With `lines=True` the file has one feature per line, otherwise it is one
    FeatureCollection document. Both are read in splits of any size. A feature without
    a property gives NULL there, a collection without features no row.
    """
    if lines:
        rows = spark.read.schema(FEATURE_SCHEMA).json(path)
        return explode_features(rows.select(F.struct("properties", "geometry").alias("f")), "f", props)
    schema = StructType().add("type", StringType())
    for field in FEATURE_SCHEMA:
        schema.add(field)
    parsed = feature_texts(spark, path).select(F.from_json("value", schema).alias("f"))
    return explode_features(parsed.where("f.type = 'Feature'"), "f", props)


# -- one document in many splits ----------------------------------------------
#
# A split in the middle of a document does not know whether it starts inside a string, nor at
# which depth. Lines that end at every closing brace are fragments Spark's text reader cuts
# out by itself; a fragment is counted for both cases, and running sums over the few blocks of a
# file say which of them holds.

#: Text up to the next brace that opens an object, strings passed over as a whole.
_TO_BRACE = r'''^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'''
_BLOCK = ("file", "block")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of text between closing braces in file order, with what they count.

    `quotes` is the number of quotes that start or end a string; `opened` has the opening
    braces outside strings, for a fragment that starts outside a string and for one that starts
    inside. Brace, quote and backslash are single bytes in UTF-8, and no escape holds a brace, so a fragment
    never starts within a character or an escape.
    """
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    braces = lambda x: F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))

    def opened(inside: int):
        return F.aggregate(
            F.filter("parts", lambda x, i: (i + inside) % 2 == 0), F.lit(0), lambda n, x: n + braces(x)
        )

    return (
        spark.read.option("lineSep", "}")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),  # ascending inside a block
            "value",
            parts.alias("parts"),
        )
        .select(*_BLOCK, "row", "value", (F.size("parts") - 1).alias("quotes"), F.array(opened(0), opened(1)).alias("opened"))
    )


def _before(blocks: DataFrame, total: Column) -> Column:
    """Sum over the earlier blocks of the file: one row per block of the read."""
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(order), F.lit(0))


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text of every object of the second level (`value`) in JSON documents, one document per file.

    The fragments are written once and a block's fragments are walked through in one task, so a
    task never sees more than a split of the file; an object cut by a split is put together at the end.
    """
    fragments = materialise(_fragments(spark, path), "fragments")
    walk = Window.partitionBy(*_BLOCK).orderBy("row")
    upto = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = walk.rowsBetween(Window.unboundedPreceding, -1)

    # Whether a block starts inside a string.
    blocks = fragments.groupBy(*_BLOCK).agg(F.sum("quotes").alias("quotes"))
    blocks = blocks.select(*_BLOCK, (_before(blocks, F.col("quotes")) % 2).alias("inside"))

    def depths(rows: DataFrame) -> DataFrame:
        quotes = F.col("inside") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))
        rows = rows.join(blocks, list(_BLOCK)).withColumn("at", (quotes % 2).cast("int"))
        # The brace that ends the fragment counts unless it stands in a string.
        closed = F.when((F.col("at") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
        return rows.withColumn("closed", closed).withColumn("step", F.col("opened")[F.col("at")] - F.col("closed"))

    # The depth at which it starts.
    narrow = depths(fragments.drop("value"))
    levels = narrow.groupBy(*_BLOCK).agg(F.sum("step").alias("step"))
    levels = levels.select(*_BLOCK, _before(levels, F.col("step")).alias("level"))

    def ends(rows: DataFrame) -> DataFrame:
        rows = rows.join(levels, list(_BLOCK)).withColumn("depth", F.col("level") + F.sum("step").over(upto))
        return rows.withColumn("ends", F.when((F.col("closed") == 1) & (F.col("depth") == 1), 1).otherwise(0))

    # How many objects ended in the blocks before.
    numbers = ends(narrow).groupBy(*_BLOCK).agg(F.sum("ends").alias("ends"))
    numbers = numbers.select(*_BLOCK, _before(numbers, F.col("ends")).alias("passed"))
    rows = ends(depths(fragments)).join(numbers, list(_BLOCK))
    rows = rows.withColumn("object", F.col("passed") + F.coalesce(F.sum("ends").over(earlier), F.lit(0)))

    grouped = rows.groupBy("file", "object").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "value"))).alias("pieces"), F.max("ends").alias("whole")
    )
    text = F.concat(F.array_join(F.col("pieces.value"), "}"), F.lit("}"))
    # The first object stands behind the brace that opens the document.
    outer = F.regexp_replace(F.regexp_replace(text, _TO_BRACE, ""), r"^\{", "")
    text = F.when(F.col("object") == 0, outer).otherwise(text)
    return grouped.where("whole = 1").select(F.regexp_replace(text, _TO_BRACE, "").alias("value"))
