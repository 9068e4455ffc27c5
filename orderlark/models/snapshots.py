"""Models of the first generation: calibrated likelihood and quantity quantiles, and what is
recommended from them (time to the next order: `hazards`, the ranker: `lambda_rank`)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GeneralizedLinearRegression,
    IsotonicRegression,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.models.boosting import BoostedTrees, Growth, Pinball, fit_boosted
from orderlark.models.lambda_rank import LambdaRanker
from orderlark.models.reorder import scaling
from orderlark.operators.rank import recommend_by_value, top_per
from orderlark.operators.snapshots import SNAPSHOT_FEATURES
from orderlark.operators.splits import fold_of
from orderlark.session import shared_root

QUANTITY_FEATURES = [*SNAPSHOT_FEATURES, "qty"]
# The features by their names.
RANK_FEATURES = [
    "p_reorder",
    "qty_p50",
    "qty_p90",
    "margin_proxy",
    "on_hand",
    "lead_time",
    "stockout_flag",
    "dow",
    "is_weekend",
]


@dataclass
class CalibratedModel:
    """One boosted model and one isotonic curve per fold; the mean of all is the score."""

    scaler: PipelineModel
    members: list

    def score(self, df: DataFrame, output: str = "p_reorder") -> DataFrame:
        out = self.scaler.transform(df)
        for i, (booster, curve) in enumerate(self.members):
            out = booster.transform(out).withColumn("_score", vector_to_array("probability")[1])
            out = curve.transform(out).withColumnRenamed("_calibrated", f"_cal_{i}")
            out = out.drop("probability", "rawPrediction", "prediction", "_score")
        cal = [f"_cal_{i}" for i in range(len(self.members))]
        mean = sum((F.col(c) for c in cal), F.lit(0.0)) / len(cal)
        return out.withColumn(output, mean).drop(*cal, "features", "_assembled")


def fit_calibrated(
    train: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 3, rounds: int = 100, depth: int = 3, seed: int = 42
) -> CalibratedModel:
    """Boosting per fold on the other folds, isotonic curve on the held-out scores. The rows are
    worked out once, with their folds; later passes read what was written."""
    shared_root(train.sparkSession)
    slim = train.select(*features, label, fold_of(key, folds).alias("_fold"))
    # A checkpoint keeps partitions and their order, from which Spark's boosting draws its bins.
    slim = slim.checkpoint()
    scaler = Pipeline(stages=scaling(features)).fit(slim)
    rows = scaler.transform(slim).select("features", label, "_fold")
    members = []
    for f in range(folds):
        booster = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
        fitted = booster.fit(rows.where(F.col("_fold") != f))
        held = fitted.transform(rows.where(F.col("_fold") == f)).select(
            vector_to_array("probability")[1].alias("_score"), F.col(label).cast("double").alias("_y")
        )
        curve = IsotonicRegression(featuresCol="_score", labelCol="_y", predictionCol="_calibrated")
        members.append((fitted, curve.fit(held)))
    return CalibratedModel(scaler, members)


@dataclass
class QuantityModel:
    """Mean from a Tweedie GLM, quantiles from boosted trees, one series per quantile."""

    glm: PipelineModel
    quantiles: BoostedTrees

    def score(self, df: DataFrame) -> DataFrame:
        """Adds qty_mean and one qty_pNN per quantile, without a shuffle. The series are fitted
        apart; a higher quantile is raised to the lower ones where it falls below them."""
        out = self.quantiles.score(self.glm.transform(df).drop("features"))
        names = [o.name for o in self.quantiles.outputs]
        return out.withColumns({n: F.greatest(*names[: i + 1]) for i, n in enumerate(names) if i})


def quantile_name(q: float) -> str:
    return f"qty_p{round(q * 100)}"


def fit_quantity(
    train: DataFrame, features: Sequence[str], target: str, quantiles: tuple[float, ...] = (0.5, 0.9), growth: Growth = Growth()
) -> QuantityModel:
    """Tweedie GLM (power 1.5, log link), and trees boosted on the pinball loss, whose leaves
    hold quantiles of the residuals."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    # Targets of zero or less have no Tweedie likelihood.
    rows = train.where(F.col(target) >= 0)
    glm = GeneralizedLinearRegression(
        family="tweedie", variancePower=1.5, linkPower=0.0, regParam=0.1, labelCol=target, predictionCol="qty_mean"
    )
    glm_model = Pipeline(stages=[assembler, glm]).fit(rows)
    losses = {quantile_name(q): Pinball(q) for q in sorted(quantiles)}
    return QuantityModel(glm_model, fit_boosted(rows, features, target, losses, growth))


def score_snapshot(latest: DataFrame, likelihood: CalibratedModel, quantity: QuantityModel) -> DataFrame:
    """The columns behind the three entry points: likelihood, quantities and the ranker's
    inputs, for all customers at once; filter on customer_id for one."""
    filled = latest.fillna(0.0, subset=[*SNAPSHOT_FEATURES, "qty"])
    scored = quantity.score(likelihood.score(filled))
    return scored.withColumn("margin_proxy", 1 - F.coalesce("discount_pct", F.lit(0.0)))


def recommend(scored: DataFrame, k: int = 10, ranker: LambdaRanker | None = None) -> DataFrame:
    """Top products per customer by the ranker if there is one, else by expected value."""
    if ranker is None:
        return recommend_by_value(scored, k)
    ranked = ranker.score(scored)
    top = top_per(ranked, "customer_id", "score", "sku_id", k)
    return top.withColumn("suggested_qty", F.greatest(F.bround("qty_p50", 0), F.lit(1.0)).cast("bigint"))
