"""Model comparison: numeric features alone, and with one-hot categories."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.operators import cleaning, features, models
from areastats.operators.models import ModelSpec
from areastats.sources import materialise

# Every configuration has its own name. Trees grow until their leaves are pure where "depth_3" does not say otherwise.
NUMERIC_MODELS = (
    ModelSpec("linear", "linear"),
    ModelSpec("tree_depth_3", "tree", {"max_depth": 3}, scaled=False, without=("pop",)),
    ModelSpec("tree", "tree", scaled=False),
    ModelSpec("forest", "forest", scaled=False),
    ModelSpec("forest_scaled", "forest"),
    ModelSpec("boosted", "boosted"),
)
ONE_HOT_MODELS = (
    ModelSpec("linear", "linear"),
    ModelSpec("ridge", "ridge", {"alpha": 1e-4}),
    ModelSpec("tree", "tree", scaled=False),
    ModelSpec("forest", "forest"),
    ModelSpec("boosted_depth_3", "boosted", {"max_depth": 3}),
    ModelSpec("boosted", "boosted"),
)


@dataclass(frozen=True)
class Variant:
    """One set of features with the models fitted on it."""

    predictions: DataFrame
    models: dict[str, Model | models.GrownTrees]
    feature_names: dict[str, list[str]]


def prepare(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    numeric: Sequence[str],
    categories: Sequence[str] = (),
    test_percent: int = 25,
) -> DataFrame:
    """Rows complete in label and features, split into train and test by their key, written once."""
    wanted = df.select(*dict.fromkeys([*key, label, *numeric, *categories]))
    rows = cleaning.coerce_numeric(wanted, [label, *numeric])
    rows = cleaning.drop_null(rows, list(categories)) if categories else rows
    return materialise(features.hash_split(rows, list(key), test_percent), "model-rows")


def fit_variant(
    rows: DataFrame,
    key: Sequence[str],
    label: str,
    numeric: Sequence[str],
    categories: Sequence[str],
    specs: Sequence[ModelSpec],
    unknown: str = "error",
) -> Variant:
    """Scale and encode on what the training rows show, then fit and predict."""
    train = rows.where(F.col("split") == "train")
    out = rows
    if any(spec.scaled for spec in specs):
        out = features.standard_scaling(train, numeric).apply(out, models.SCALED)
    encoded = []
    if categories:
        out = features.fit_one_hot(train, categories).vector(out, unknown)
        encoded = [f"{c}_vec" for c in categories]
    inputs = {
        spec.name: [f"{c}{models.SCALED}" if spec.scaled else c for c in numeric if c not in spec.without]
        + [v for c, v in zip(categories, encoded) if c not in spec.without]
        for spec in specs
    }
    return Variant(*models.compare_models(out, label, inputs, specs, key))


def model_comparison(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    numeric: Sequence[str],
    categories: Sequence[str],
    numeric_specs: Sequence[ModelSpec] = NUMERIC_MODELS,
    one_hot_specs: Sequence[ModelSpec] = ONE_HOT_MODELS,
) -> DataFrame:
    """Leader-board over both variants: variant, model, and scores on train and test rows."""
    rows = prepare(df, key, label, numeric, categories)
    # Boosting waits for short jobs most of the time, so both variants are fitted at once.
    with ThreadPoolExecutor(2) as pool:
        fitting = [pool.submit(fit_variant, rows, key, label, numeric, *v) for v in (((), numeric_specs), (categories, one_hot_specs))]
        plain, coded = (f.result() for f in fitting)
    both = plain.predictions.withColumn("variant", F.lit("numeric")).unionByName(
        coded.predictions.withColumn("variant", F.lit("one_hot"))
    )
    return models.leader_board(both, ["variant", "model"])
