"""From scores to ranked recommendations and a stock plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlark.functions.scoring import (
    finite_or_zero,
    heuristic_score,
    priority,
    suggested_quantity,
    whole_quantity,
)
from orderlark.operators.lookup import STOCK_DEFAULTS, with_lookup
from orderlark.operators.prepare import manufacturer_like
from orderlark.operators.skew import attach
from orderlark.session import stored

CUSTOMER_SHARE = 0.6
PRODUCT_SHARE = 0.7


def top_per(df: DataFrame, entity: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per entity. The row_number filter becomes a window group limit, which
    keeps k rows per entity and task already before the shuffle."""
    w = Window.partitionBy(entity).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def with_priority(scores: DataFrame, entity: str, share: float, min_probability: float = 0.5) -> DataFrame:
    """Rows at or above the probability gate, with whole quantities and a priority that
    relates the quantity to the entity's largest one after the gate.

    The gated rows are read for their entity sizes, the largest quantities and the
    ranking; they are written once, so that the scores behind them are computed once.
    """
    gated = scores.where(F.col("reorder_probability") >= min_probability).withColumn(
        "predicted_quantity", whole_quantity(F.col("predicted_quantity"))
    )
    gated = stored(gated, "gated")
    most = gated.groupBy(entity).agg(F.max("predicted_quantity").alias("_most"))
    score = priority(F.col("reorder_probability"), F.col("predicted_quantity"), F.col("_most"), share)
    return attach(gated, most, [entity]).withColumn("priority_score", score).drop("_most")


def recommend_products(scores: DataFrame, top_k: int = 20, min_probability: float = 0.5) -> DataFrame:
    """Top products of every customer in one job; filter on customer_id for one."""
    ranked = with_priority(scores, "customer_id", CUSTOMER_SHARE, min_probability)
    return top_per(ranked, "customer_id", "priority_score", "product_id", top_k)


def recommend_customers(scores: DataFrame, top_k: int = 20, min_probability: float = 0.5) -> DataFrame:
    """Top customers of every product."""
    ranked = with_priority(scores, "product_id", PRODUCT_SHARE, min_probability)
    return top_per(ranked, "product_id", "priority_score", "customer_id", top_k)


def stock_plan(
    scores: DataFrame,
    raw: DataFrame,
    columns: Mapping[str, str],
    order: Sequence[str],
    raw_key: str,
    min_probability: float = 0.5,
    limit: int = 50,
    manufacturer: str | None = None,
) -> DataFrame:
    """Expected demand per product over the likely orders, largest first.

    Demand is summed per product before names are joined, so the join has one row per
    product on both sides. `manufacturer` keeps products whose maker matches a pattern.
    """
    likely = scores.where(F.col("reorder_probability") >= min_probability)
    demand = likely.groupBy("product_id").agg(
        F.round(F.sum("predicted_quantity"), 6).alias("total_qty"),
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("reorder_probability").alias("avg_confidence"),
    )
    plan = with_lookup(demand, raw, "product_id", columns, order, STOCK_DEFAULTS, raw_key, heavy=[])
    if manufacturer is not None:
        plan = manufacturer_like(plan, manufacturer)
    return plan.orderBy(F.col("total_qty").desc(), "product_id").limit(limit)


def recommend_by_value(df: DataFrame, k: int = 10, entity: str = "customer_id", item: str = "sku_id") -> DataFrame:
    """Expected-value score from likelihood, quantity quantiles, margin and stock."""
    score = heuristic_score(*[F.col(c) for c in ("p_reorder", "qty_p50", "qty_p90", "discount_pct", "stockout_flag")])
    scored = df.withColumn("score", F.round(score, 9)).withColumn("suggested_qty", suggested_quantity(F.col("qty_p50")))
    return top_per(scored, entity, "score", item, k)


def compare_models(predictions: DataFrame, models: list[str], k: int = 10) -> DataFrame:
    """Predictions of all models side by side, best ensemble probability first, k per
    customer; missing or non-finite values as 0."""
    columns = [f"{kind}_{m}" for kind in ("reorder", "quantity") for m in models]
    clean = predictions.withColumns({c: finite_or_zero(F.col(c)) for c in columns})
    return top_per(clean.select("customer_id", "product_id", *columns), "customer_id", "reorder_ensemble", "product_id", k)
