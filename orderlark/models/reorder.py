"""Reorder likelihood and quantity models over the pair features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlark.functions.scoring import ensemble
from orderlark.operators.evaluate import binary_metrics, long_metrics, regression_metrics, roc_auc
from orderlark.operators.pair_features import feature_columns
from orderlark.operators.splits import time_based_split
from orderlark.session import shared_root, stored


@dataclass(frozen=True)
class Boosting:
    """Boosted trees; training stops early once the validation rows gain nothing."""

    # The sizes of the full fit.
    rounds: int = 1000
    depth: int = 7
    rate: float = 0.05
    row_share: float = 0.8
    min_rows: int = 20
    tolerance: float = 0.0005
    seed: int = 42


@dataclass(frozen=True)
class Dense:
    hidden: tuple[int, ...] = (256, 128, 64, 32)
    rounds: int = 100
    seed: int = 42


def scaling(features: Sequence[str], output: str = "features") -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="_assembled"),
        StandardScaler(inputCol="_assembled", outputCol=output, withMean=True, withStd=True),
    ]


def standardise(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scaled features as an array column."""
    model = Pipeline(stages=scaling(features, "_scaled")).fit(df)
    return model.transform(df).withColumn("scaled", vector_to_array("_scaled")).drop("_assembled", "_scaled")


def boosted_classifier(p: Boosting, label: str, name: str, validation: str | None = None) -> GBTClassifier:
    gbt = GBTClassifier(
        labelCol=label,
        featuresCol="features",
        predictionCol=f"_{name}_class",
        maxIter=p.rounds,
        maxDepth=p.depth,
        stepSize=p.rate,
        subsamplingRate=p.row_share,
        minInstancesPerNode=p.min_rows,
        featureSubsetStrategy="0.8",
        validationTol=p.tolerance,
        seed=p.seed,
    )
    gbt = gbt.setProbabilityCol(f"_{name}_p").setRawPredictionCol(f"_{name}_raw")
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def boosted_regressor(p: Boosting, label: str, output: str, validation: str | None = None) -> GBTRegressor:
    gbt = GBTRegressor(
        labelCol=label,
        featuresCol="features",
        predictionCol=output,
        maxIter=p.rounds,
        maxDepth=p.depth,
        stepSize=p.rate,
        subsamplingRate=p.row_share,
        minInstancesPerNode=p.min_rows,
        featureSubsetStrategy="0.8",
        validationTol=p.tolerance,
        seed=p.seed,
    )
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def dense_classifier(p: Dense, n_inputs: int, n_classes: int, label: str, name: str) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        layers=[n_inputs, *p.hidden, n_classes],
        labelCol=label,
        featuresCol="features",
        predictionCol=f"_{name}_class",
        probabilityCol=f"_{name}_p",
        rawPredictionCol=f"_{name}_raw",
        maxIter=p.rounds,
        seed=p.seed,
    )


def robust_regressor(label: str, output: str, rounds: int) -> LinearRegression:
    return LinearRegression(labelCol=label, featuresCol="features", predictionCol=output, loss="huber", maxIter=rounds)


@dataclass
class ReorderModels:
    """Fitted members of the two ensembles, and what they were trained for."""

    horizon: int
    reorder: dict[str, PipelineModel] = field(default_factory=dict)
    quantity: dict[str, PipelineModel] = field(default_factory=dict)

    def features(self) -> list[str]:
        return feature_columns(self.horizon)

    def score(self, df: DataFrame) -> DataFrame:
        """All members side by side plus the ensembles; a member that is missing leaves
        its weight to the other."""
        out = df
        for name, model in self.reorder.items():
            out = model.transform(out).withColumn(f"reorder_{name}", vector_to_array(f"_{name}_p")[1])
            out = out.drop("features", "_assembled", f"_{name}_p", f"_{name}_raw", f"_{name}_class")
        for name, model in self.quantity.items():
            out = model.transform(out).drop("features", "_assembled")
            # The network's output unit cannot go below zero.
            out = out.withColumn(f"quantity_{name}", F.greatest(F.col(f"quantity_{name}"), F.lit(0.0)))
        for kind, members in (("reorder", self.reorder), ("quantity", self.quantity)):
            if members:
                scores = {m: F.col(f"{kind}_{m}") for m in members}
                out = out.withColumn(f"{kind}_ensemble", ensemble(scores))
        return out

    def predict(self, df: DataFrame, member: str = "ensemble") -> DataFrame:
        """Scores of one member under the names that ranking expects."""
        return self.score(df).withColumns(
            {"reorder_probability": F.col(f"reorder_{member}"), "predicted_quantity": F.col(f"quantity_{member}")}
        )

    def save(self, spark: SparkSession, path: str) -> None:
        places = {}
        for kind, members in (("reorder", self.reorder), ("quantity", self.quantity)):
            for name, model in members.items():
                places[kind, name] = f"{kind}/{name}"
                model.write().overwrite().save(f"{path}/{places[kind, name]}")
        self.save_listing(spark, path, places)

    def save_listing(self, spark: SparkSession, path: str, places: dict[tuple[str, str], str]) -> None:
        """What the models were trained for, and where below `path` each member lies."""
        listed = [(self.horizon, *({m: places[kind, m] for m in members} for kind, members in (("reorder", self.reorder), ("quantity", self.quantity))), self.features())]
        meta = spark.createDataFrame(listed, "horizon int, reorder map<string, string>, quantity map<string, string>, features array<string>")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ReorderModels:
        meta = spark.read.parquet(f"{path}/meta").first()
        models = ReorderModels(meta["horizon"])
        models.reorder = {m: PipelineModel.load(f"{path}/{place}") for m, place in sorted(meta["reorder"].items())}
        models.quantity = {m: PipelineModel.load(f"{path}/{place}") for m, place in sorted(meta["quantity"].items())}
        return models


def split_for_training(features: DataFrame, horizon: int, ties: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """Time split with a gap of one horizon, so that no training label looks into the test
    period."""
    return time_based_split(features, test_size=test_size, val_size=0.2, gap_days=horizon, ties=ties)


def _fit(rows: DataFrame, features: Sequence[str], estimator, with_validation: bool) -> PipelineModel:
    """Scaler from the training rows; boosted trees also see the validation rows, as such."""
    scaler = Pipeline(stages=scaling(features)).fit(rows.where("split = 'train'"))
    fitted_on = rows.where("split IN ('train', 'val')") if with_validation else rows.where("split = 'train'")
    return PipelineModel([*scaler.stages, estimator.fit(scaler.transform(fitted_on))])


def fit_reorder(
    split: DataFrame, horizon: int, boosting: Boosting | None = Boosting(), dense: Dense | None = Dense()
) -> dict[str, PipelineModel]:
    """Members for the likelihood: a dense network and boosted trees; None leaves one out."""
    shared_root(split.sparkSession)
    features = feature_columns(horizon)
    rows = split.withColumn("_val", F.col("split") == "val")
    out = {}
    if dense is not None:
        out["dense"] = _fit(rows, features, dense_classifier(dense, len(features), 2, "will_reorder", "dense"), False)
    if boosting is not None:
        out["boosted"] = _fit(rows, features, boosted_classifier(boosting, "will_reorder", "boosted", "_val"), True)
    return out


def fit_quantity(
    split: DataFrame, horizon: int, boosting: Boosting | None = Boosting(), robust_rounds: int | None = 200
) -> dict[str, PipelineModel]:
    """Members for the quantity, fitted on rows that do reorder: a robust linear model in
    the network's place (Spark has no network regressor) and boosted trees."""
    shared_root(split.sparkSession)
    features = feature_columns(horizon)
    rows = split.withColumn("_val", F.col("split") == "val")
    out = {}
    if robust_rounds is not None:
        robust = robust_regressor("next_order_quantity", "quantity_dense", robust_rounds)
        out["dense"] = _fit(rows, features, robust, False)
    if boosting is not None:
        boosted = boosted_regressor(boosting, "next_order_quantity", "quantity_boosted", "_val")
        out["boosted"] = _fit(rows, features, boosted, True)
    return out


def evaluate_models(models: ReorderModels, reorder_split: DataFrame, quantity_split: DataFrame | None = None) -> DataFrame:
    """Test metrics of all members and ensembles as (component, model, metric, value)."""
    out = None

    def add(rows: DataFrame) -> None:
        nonlocal out
        out = rows if out is None else out.unionByName(rows)

    # Every metric reads the scores again, so they are written once.
    columns = [f"reorder_{m}" for m in [*models.reorder, "ensemble"]]
    test = models.score(reorder_split.where("split = 'test'")).select("will_reorder", *columns)
    test = stored(test, "scored")
    for name in [*models.reorder, "ensemble"]:
        add(long_metrics(roc_auc(test, f"reorder_{name}", "will_reorder"), "reorder", name))
        add(long_metrics(binary_metrics(test, f"reorder_{name}", "will_reorder"), "reorder", name))
    if quantity_split is not None:
        columns = [f"quantity_{m}" for m in [*models.quantity, "ensemble"]]
        held = models.score(quantity_split.where("split = 'test'")).select("next_order_quantity", *columns)
        held = stored(held, "scored")
        for name in [*models.quantity, "ensemble"]:
            add(long_metrics(regression_metrics(held, f"quantity_{name}", "next_order_quantity"), "quantity", name))
    return out


def feature_importance(model: PipelineModel, top: int = 20) -> DataFrame:
    """Named importances of a tree model, greatest first."""
    names = model.stages[0].getInputCols()
    trees = model.stages[-1]
    pairs = [(n, float(v)) for n, v in zip(names, trees.featureImportances.toArray())]
    spark = SparkSession.active()
    rows = spark.createDataFrame(pairs, "feature string, importance double")
    return rows.orderBy(F.col("importance").desc(), "feature").limit(top)


def probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]
