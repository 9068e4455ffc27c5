"""Training from sales to saved models and metrics, with resume member by member."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from orderlark.models.reorder import (
    Boosting,
    Dense,
    ReorderModels,
    evaluate_models,
    fit_quantity,
    fit_reorder,
    split_for_training,
)
from orderlark.operators.pair_features import build_features, feature_columns
from orderlark.session import stored
from orderlark.sources.tables import load_features, load_metrics, save_features, save_metrics


def cached_features(sales: DataFrame, store: str, horizon: int, ties: Sequence[str], resume: bool) -> DataFrame:
    """Feature table of a horizon from the store; built and saved first where it is
    missing or a fresh start is asked for. All fits read this one table."""
    spark = sales.sparkSession
    if resume:
        try:
            return load_features(spark, store, horizon)
        except FileNotFoundError:
            pass
    save_features(build_features(sales, horizon, ties=ties), store, horizon)
    return load_features(spark, store, horizon)


def address(*parts) -> str:
    """A folder name that is equal only where everything that went into a fit is."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the marker stands that is written after all else."""
    try:
        return spark.read.parquet(f"{path}/complete").count() == 1
    except AnalysisException:
        return False


def mark_complete(spark: SparkSession, path: str) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/complete")


def kept_member(spark: SparkSession, path: str, resume: bool, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """A member from its folder; fitted and saved first where the folder is not complete or
    a fresh start is asked for. A run that is lost while it saves leaves no marker."""
    if not (resume and is_complete(spark, path)):
        fit().write().overwrite().save(f"{path}/model")
        mark_complete(spark, path)
    return PipelineModel.load(f"{path}/model")


def train_all(
    sales: DataFrame,
    store: str,
    horizon: int = 30,
    ties: Sequence[str] = (),
    test_size: float = 0.2,
    resume: bool = False,
    boosting: Boosting = Boosting(),
    dense: Dense | None = Dense(),
    robust_rounds: int | None = 200,
) -> tuple[ReorderModels, DataFrame]:
    """Fit both ensembles, save them with their horizon, and save the test metrics.

    Each member lies in a folder of its own, named after features, horizon, split and sizes.
    With `resume`, features, members and metrics that the store already has are loaded; a
    member that is missing, was not saved to its end, or had other sizes is fitted anew, and
    it alone.
    """
    spark = sales.sparkSession
    features = cached_features(sales, store, horizon, ties, resume)
    folder = f"{store.rstrip('/')}/models/h={horizon}"
    common = (feature_columns(horizon), horizon, test_size, list(ties))

    # The splits are made only if a fit or the metrics need them.
    @cache
    def rows() -> DataFrame:
        return stored(split_for_training(features, horizon, ties, test_size), "split")

    @cache
    def quantities() -> DataFrame:
        # Quantity models see the reordering rows only, split on those rows' own dates.
        wanted = features.where("next_order_quantity IS NOT NULL")
        return stored(split_for_training(wanted, horizon, ties, test_size), "split")

    wanted = {
        ("reorder", "dense"): (dense, lambda: fit_reorder(rows(), horizon, None, dense)["dense"]),
        ("reorder", "boosted"): (boosting, lambda: fit_reorder(rows(), horizon, boosting, None)["boosted"]),
        ("quantity", "dense"): (robust_rounds, lambda: fit_quantity(quantities(), horizon, None, robust_rounds)["dense"]),
        ("quantity", "boosted"): (boosting, lambda: fit_quantity(quantities(), horizon, boosting, None)["boosted"]),
    }
    models, places = ReorderModels(horizon), {}
    for (kind, name), (sizes, fit) in wanted.items():
        if sizes is not None:
            place = f"{kind}/{name}-{address(kind, name, sizes, common)}"
            places[kind, name] = f"{place}/model"
            getattr(models, kind)[name] = kept_member(spark, f"{folder}/{place}", resume, fit)
    models.save_listing(spark, folder, places)
    measured = f"{folder}/metrics-{address(sorted(places.values()))}"
    if not (resume and is_complete(spark, measured)):
        save_metrics(evaluate_models(models, rows(), quantities() if models.quantity else None), f"{measured}/values")
        mark_complete(spark, measured)
    return models, load_metrics(spark, f"{measured}/values")
