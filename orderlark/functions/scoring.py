"""Score and label expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# How an operator's answer is labelled.
GOOD_SERVICE = "Operator tərəfindən yaxşı cavablandırıldı"
POOR_SERVICE = "Operator tərəfindən pis cavablandırıldı"


def ensemble(members: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of the members that are there; a null member hands its weight on."""
    weights = weights or {name: 1.0 / len(members) for name in members}
    total = weight = F.lit(0.0)
    for name, score in members.items():
        total = total + F.coalesce(score * weights[name], F.lit(0.0))
        weight = weight + F.when(score.isNull(), 0.0).otherwise(weights[name])
    return F.try_divide(total, weight)


def whole_quantity(quantity: Column) -> Column:
    """Never negative, halves to even."""
    return F.greatest(F.bround(quantity, 0), F.lit(0.0)).cast("bigint")


def priority(probability: Column, quantity: Column, most: Column, share: float) -> Column:
    """Probability and relative quantity, weighted share to 1 - share. Rounded, so that the
    last bits of a sum never decide a rank."""
    return F.round(probability * share + quantity / (most + 1) * (1 - share), 9)


def heuristic_score(p: Column, q50: Column, q90: Column, discount: Column, stockout: Column) -> Column:
    margin = 1 - F.coalesce(discount, F.lit(0.0))
    return p * (0.7 * q50 + 0.3 * q90) * (0.5 + 0.5 * margin) * (1 - 0.9 * stockout)


def suggested_quantity(q50: Column) -> Column:
    return F.greatest(F.bround(q50, 0), F.lit(1.0)).cast("bigint")


def discount_shopper(avg_discount: Column, inclusive: bool = True) -> Column:
    """Customer pages count 0.01 itself, product pages do not."""
    over = avg_discount >= 0.01 if inclusive else avg_discount > 0.01
    return F.when(over, True).otherwise(False)


def service_label(score: Column) -> Column:
    return F.when(F.coalesce(score, F.lit(0)) >= 4, GOOD_SERVICE).otherwise(POOR_SERVICE)


def finite_or_zero(score: Column) -> Column:
    value = F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(F.abs(value) == float("inf"), 0.0).otherwise(value)
