"""Metrics of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.operators.rank import top_per
from orderlark.operators.skew import carried, cut_blocks, null_safe_join


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row with the area under the ROC curve; equal scores count half.

    Rows are first counted per distinct score. These counts are cut into ordered ranges
    of even size, whatever the spread of the scores; negatives are then accumulated over
    the ranges and inside each.
    """
    positive = F.col(label) == 1
    per_score = df.groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("_pos"), F.sum(F.when(positive, 0).otherwise(1)).alias("_neg")
    )
    ranges = cut_blocks(per_score, [], ["_s"])
    below = carried(ranges, [], {"_below": F.col("_neg")})
    inside = Window.partitionBy("_block").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counted = null_safe_join(ranges.withColumn("_inside", F.coalesce(F.sum("_neg").over(inside), F.lit(0))), below, ["_block"])
    wins = F.col("_pos") * (F.col("_below") + F.col("_inside") + 0.5 * F.col("_neg"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return counted.agg(F.try_divide(F.sum(wins), pairs).alias("roc_auc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall and F1 of `score > threshold`."""
    hit, true = F.col(score) > threshold, F.col(label) == 1

    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))

    counts = df.agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}
    )


def regression_metrics(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """MAE, RMSE and R2 from one aggregation."""
    error = F.col(target) - F.col(prediction)
    total = F.var_pop(target) * F.count(target)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), total)).alias("r2"),
    )


def class_report(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, from confusion counts."""
    confusion = df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("_n"))
    # Each confusion cell counts for its true class and for its predicted class.
    sides = confusion.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col(label).alias("class"),
                    F.col("_n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col(label) == F.col(prediction), F.col("_n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col(prediction).alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("_n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    hits = F.col("hits")
    return sums.withColumns(
        {
            "precision": _ratio(hits, F.col("predicted")),
            "recall": _ratio(hits, F.col("support")),
            "f1": _ratio(2 * hits, F.col("predicted") + F.col("support")),
        }
    ).drop("predicted", "hits")


def weighted_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; one row per `by`."""
    report = class_report(df, label, prediction, by)
    weight = F.sum("support")

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("support")), weight)

    return report.groupBy(*by).agg(
        # Recall weighted by support is the share of correct rows.
        weighted("recall").alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1"),
    )


def best_model(metrics: DataFrame, metric: str = "f1", model: str = "model") -> DataFrame:
    """The model with the best metric; ties go to the first name."""
    return metrics.orderBy(F.col(metric).desc(), model).limit(1)


def ndcg(df: DataFrame, entity: str, score: str, label: str, tie: str, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Mean NDCG@k of binary labels over the entities that have a positive. Needs only the
    top rows and the number of positives per entity."""
    deepest = max(ks)
    top = top_per(df, entity, score, tie, deepest, rank="_rank")
    gain = F.col(label) / F.log2(F.col("_rank") + 1)
    found = top.groupBy(entity).agg(*[F.sum(F.when(F.col("_rank") <= k, gain)).alias(f"_dcg_{k}") for k in ks])
    positives = df.groupBy(entity).agg(F.sum(label).cast("int").alias("_positives")).where("_positives > 0")

    def ideal(k: int) -> Column:
        ranks = F.sequence(F.lit(1), F.least(F.col("_positives"), F.lit(k)))
        return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1))

    both = found.join(positives, entity)
    return both.agg(
        F.count(F.lit(1)).alias("n_groups"), *[F.avg(F.col(f"_dcg_{k}") / ideal(k)).alias(f"ndcg_at_{k}") for k in ks]
    )


def long_metrics(df: DataFrame, component: str, model: str) -> DataFrame:
    """A one-row metric table as (component, model, metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
    return df.select(F.lit(component).alias("component"), F.lit(model).alias("model"), F.explode(pairs).alias("m")).select(
        "component", "model", "m.metric", "m.value"
    )
