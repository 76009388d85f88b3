"""Map-ready tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.functions import mercator_x, mercator_y
from areastats.operators.cleaning import recode


def to_mercator(df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y") -> DataFrame:
    """Add web-map coordinates in metres."""
    return df.withColumns({x: mercator_x(lon), y: mercator_y(lat)})


def size_layers(df: DataFrame, sizes: Sequence[str], ids: Sequence[str], at_least: float = 1) -> DataFrame:
    """One point per row and size class present there: ids, layer, n."""
    long = df.unpivot(list(ids), list(sizes), "layer", "n")
    return long.where(F.col("n") >= at_least)


def map_layer(features: DataFrame, values: DataFrame, key: str, recodes: Mapping | None = None) -> DataFrame:
    """Attach values to map features by key; features without a value stay, with NULL."""
    if recodes:
        features = recode(features, key, recodes)
    return features.join(values, key, "left")
