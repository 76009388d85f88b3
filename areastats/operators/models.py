"""Regression models, their coefficients and importances, and their scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.operators import trees
from areastats.operators.features import Scaling, assemble, vector_names
from areastats.operators.least_squares import LinearFit, least_squares
from areastats.operators.trees import Growth
from areastats.sources import materialise

# The normal equations need a features x features matrix on the driver.
NORMAL_SOLVER_LIMIT = 4096
#: Tree models of a comparison that grow at the same time.
GROWING = 4
#: Ending of the names of scaled columns.
SCALED = "_scaled"


@dataclass(frozen=True)
class ModelSpec:
    """One row of a leader-board: a name, a kind of model and its settings.

    Kinds: linear (solver), ridge (alpha, solver), tree (max_depth), forest (trees, max_depth),
    boosted (rounds, max_depth, step, reg_lambda, gamma, min_child, bins). Trees and forests grow until
    their leaves are pure unless `max_depth` says otherwise; tree kinds also take `unit` and `local_rows` (see
    `trees`). `solver` is "normal" (exact, at most 4096 features) unless "l-bfgs" is asked for.
    `scaled` asks for standardised inputs, `without` leaves columns out.
    """

    name: str
    kind: str
    settings: Mapping = field(default_factory=dict)
    scaled: bool = True
    without: tuple[str, ...] = ()


def _ridge_penalty(train: DataFrame, label: str, alpha: float) -> float:
    """The penalty Spark needs so that the minimised sum is ||y - Xb||^2 + alpha * ||b||^2.

    Spark averages over rows and divides the label by its standard deviation first.
    """
    n, spread = train.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    return alpha * (spread or 0.0) / n


def tree_growth(spec: ModelSpec) -> Growth:
    """How the trees of a specification grow."""
    given = {
        "tree": {},
        "forest": {"trees": 100, "bootstrap": True},
        "boosted": {"rounds": 100, "max_depth": 6, "reg_lambda": 1.0, "gamma": 0.0},
    }[spec.kind]
    known = {"max_depth", "unit", "local_rows"}
    known |= {"forest": {"trees"}, "boosted": {"rounds", "step", "reg_lambda", "gamma", "min_child", "bins"}}.get(spec.kind, set())
    if set(spec.settings) - known:
        raise ValueError(f"unknown settings for {spec.kind}: {sorted(set(spec.settings) - known)}")
    return Growth(**(given | dict(spec.settings)))


@dataclass(frozen=True)
class TreeModel:
    """Trees of a training table. They are grown again for each use, always the same, beside the rows to predict."""

    rows: DataFrame  # row, key, x, y, trains
    growth: Growth
    features: str = "features"

    @classmethod
    def of(cls, train: DataFrame, label: str, growth: Growth, features: str) -> TreeModel:
        x = vector_to_array(features)
        key = F.xxhash64(x, F.col(label)).cast("string") if growth.bootstrap else F.lit("")
        number = -1 - F.monotonically_increasing_id()  # below those of the rows to predict
        rows = train.select(number.alias("row"), key.alias("key"), x.alias("x"), F.col(label).cast("double").alias("y"), F.lit(True).alias("trains"))
        return cls(materialise(rows, "tree-rows"), growth, features)

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows of a table with a `prediction`."""
        given = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "tree-given")
        new = given.select(
            F.col("_row").alias("row"), F.lit("").alias("key"), vector_to_array(self.features).alias("x"), F.lit(0.0).alias("y"), F.lit(False).alias("trains")
        )
        found = trees.predictions(trees.grow(self.rows.unionByName(new), self.growth))
        return given.join(found, F.col("_row") == F.col("row")).drop("_row", "row")

    def importances(self, names: Sequence[str]) -> DataFrame:
        return trees.feature_importances(trees.grow(self.rows, self.growth), self.growth, names)


@dataclass(frozen=True)
class GrownTrees:
    """What has been grown for one model of a comparison."""

    grown: DataFrame
    growth: Growth

    def importances(self, names: Sequence[str]) -> DataFrame:
        return trees.feature_importances(self.grown, self.growth, names)


def fit_model(train: DataFrame, label: str, spec: ModelSpec, features: str = "features") -> Model | LinearFit | TreeModel:
    """Fit one model on a table with a feature vector."""
    if spec.kind in ("tree", "forest", "boosted"):
        return TreeModel.of(train, label, tree_growth(spec), features)
    if spec.kind not in ("linear", "ridge"):
        raise ValueError(f"unknown kind of model {spec.kind!r}")
    s = dict(spec.settings)
    alpha = s.pop("alpha", 1e-4) if spec.kind == "ridge" else 0.0
    solver = s.pop("solver", "normal")
    if s:
        raise ValueError(f"unknown settings for {spec.kind}: {sorted(s)}")
    n_features = len(vector_names(train, features))
    if solver == "normal":
        if n_features > NORMAL_SOLVER_LIMIT:
            raise ValueError(f"{n_features} features: the normal solver takes {NORMAL_SOLVER_LIMIT}, set solver to 'l-bfgs'")
        return least_squares(train, label, features, n_features, alpha)
    penalty = _ridge_penalty(train, label, alpha) if alpha else 0.0
    est = LinearRegression(labelCol=label, solver=solver, standardization=False, regParam=penalty, elasticNetParam=0.0)
    return est.setFeaturesCol(features).fit(train)


def predict(model: Model | LinearFit | TreeModel, df: DataFrame, keep: Sequence[str], label: str) -> DataFrame:
    """Prediction beside the true value: keep..., label, prediction."""
    return model.transform(df).select(*keep, F.col(label).alias("label"), "prediction")


# -- what a model says --------------------------------------------------------


def coefficients(model: Model | LinearFit, names: Sequence[str], spark, scaling: Scaling | None = None) -> DataFrame:
    """Intercept and one coefficient per feature, with its size regardless of sign.

    Fitting on scaled columns is numerically safer; with their `scaling` the
    coefficients are given in the units of the columns before it.
    """
    values = [float(v) for v in model.coefficients.toArray()]
    intercept = float(model.intercept)
    if scaling is not None:
        row = scaling.figures.first()[0]
        for i, c in enumerate(scaling.cols):
            values[i] /= row[f"{c}_width"]
            intercept -= values[i] * row[f"{c}_offset"]
    rows = [("intercept", intercept), *zip(names, values, strict=True)]
    table = spark.createDataFrame(rows, "feature string, coefficient double")
    return table.withColumn("magnitude", F.abs("coefficient"))


def importances(model: TreeModel | GrownTrees, names: Sequence[str]) -> DataFrame:
    """Importance of every feature of a tree model; features never used have 0."""
    return model.importances(names)


# -- scores -------------------------------------------------------------------


def regression_metrics(
    predictions: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """R2, MAE, MSE, RMSE and the mean prediction, all from one pass."""
    y, p = F.col(label), F.col(prediction)
    error = y - p
    table = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.avg(p).alias("mean_prediction"),
        F.var_pop(y).alias("_spread"),
    )
    return table.select(
        *by,
        "n",
        (1 - F.try_divide(F.col("mse"), F.col("_spread"))).alias("r2"),
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mean_prediction",
    )


def compare_models(
    df: DataFrame,
    label: str,
    inputs: Mapping[str, Sequence[str]],
    specs: Sequence[ModelSpec],
    keep: Sequence[str] = (),
    split: str = "split",
) -> tuple[DataFrame, dict[str, Model | LinearFit | GrownTrees], dict[str, list[str]]]:
    """Fit each model once on the training rows and predict all rows.

    `inputs` names the feature columns of each model; models with the same ones
    share a vector. `keep` is the key of the rows. Tree models grow side by side and predict the other
    rows as they go. Returns the predictions (keep..., model, split, label,
    prediction), the models and their feature names in vector order.
    """
    vectors: dict[tuple[str, ...], str] = {}
    for spec in specs:
        vectors.setdefault(tuple(inputs[spec.name]), f"_v{len(vectors)}")
    data = df
    for cols, vector in vectors.items():
        data = assemble(data, cols, vector)
    data = data.select(*keep, split, F.col(label).cast("double").alias("label"), *vectors.values())
    used = {spec.name: vectors[tuple(inputs[spec.name])] for spec in specs}
    names = {spec.name: vector_names(data, used[spec.name]) for spec in specs}
    data = materialise(data.withColumn("_row", F.monotonically_increasing_id()), "model-vectors")

    train = data.where(F.col(split) == "train")
    models: dict[str, Model | LinearFit | GrownTrees] = {}
    parts, n = [], data.count()
    # Trees do not mind the scale of their inputs: models that differ in nothing else share their trees.
    share: dict[tuple, list[str]] = {}
    for spec in specs:
        if spec.kind in ("tree", "forest", "boosted"):
            plain = tuple(c.removesuffix(SCALED) for c in inputs[spec.name])
            share.setdefault((tree_growth(spec), plain), []).append(spec.name)
    grows = [spec for spec in specs if any(spec.name == g[0] for g in share.values())]
    tables = {
        vector: data.select(
            F.col("_row").alias("row"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keep]).alias("key"),
            vector_to_array(vector).alias("x"),
            F.col("label").alias("y"),
            (F.col(split) == "train").alias("trains"),
        )
        for vector in {used[spec.name] for spec in grows}
    }
    cuts: dict[tuple[str, int], list[list[float]]] = {}
    for spec in grows:
        growth = tree_growth(spec)
        if growth.rounds and (used[spec.name], growth.bins) not in cuts:
            cuts[used[spec.name], growth.bins] = trees.cut_points(tables[used[spec.name]], growth.bins)

    def grown_as(spec: ModelSpec) -> DataFrame:
        growth, vector = tree_growth(spec), used[spec.name]
        return materialise(trees.grow(tables[vector], growth, n, cuts.get((vector, growth.bins))), "grown-trees")

    # Levels of large trees are many short jobs: models grow side by side, each from a thread of the driver, and one model's
    # small nodes are finished between the levels of another.
    with ThreadPoolExecutor(GROWING) as pool:
        grown = dict(zip([spec.name for spec in grows], pool.map(grown_as, grows)))
    for spec in specs:
        if spec.kind not in ("tree", "forest", "boosted"):
            models[spec.name] = fit_model(train, "label", spec, used[spec.name])
            scored = models[spec.name].transform(data).withColumn("model", F.lit(spec.name))
            parts.append(scored.select(*keep, "model", "prediction", split, "label"))
    for same in share.values():
        values = trees.predictions(grown[same[0]]).withColumn("model", F.explode(F.array(*[F.lit(name) for name in same])))
        parts.append(data.join(values, F.col("_row") == F.col("row")).select(*keep, "model", "prediction", split, "label"))
        for spec in specs:
            if spec.name in same:
                models[spec.name] = GrownTrees(grown[same[0]], tree_growth(spec))
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    return predictions, models, names


def leader_board(predictions: DataFrame, by: Sequence[str] = ("model",), split: str = "split") -> DataFrame:
    """One row per model with its scores on the training and the test rows side by side."""
    scores = regression_metrics(predictions, [*by, split])
    measures = ("r2", "mae", "mse", "rmse", "mean_prediction")
    return scores.groupBy(*by).agg(
        *[
            F.max(F.when(F.col(split) == part, F.col(m))).alias(f"{m}_{part}")
            for m in measures
            for part in ("train", "test")
        ]
    )
