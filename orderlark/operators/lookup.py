"""Names and other details joined onto predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.operators.prepare import first_per_key
from orderlark.operators.skew import attach

PRODUCT_DEFAULTS = {"product_name": "Unknown Product", "manufacturer": ""}
CUSTOMER_DEFAULTS = {"customer_name": "Unknown Customer", "salesman_name": "N/A"}
STOCK_DEFAULTS = {"product_name": "Unknown Product", "manufacturer": "Unknown"}


def with_lookup(
    predictions: DataFrame,
    raw: DataFrame,
    key: str,
    columns: Mapping[str, str],
    order: Sequence[str],
    defaults: Mapping[str, str],
    raw_key: str | None = None,
    heavy: Sequence[int] | None = None,
) -> DataFrame:
    """Left join of the first raw row per key, keys compared as text.

    `columns` maps raw names to output names; those the raw table lacks become their
    default, as do nulls.
    """
    raw_key = raw_key or key
    present = {src: dst for src, dst in columns.items() if src in raw.columns}
    slim = raw.select(
        F.col(raw_key).cast("string").alias(key), *[F.col(s).alias(d) for s, d in present.items()], *order
    )
    first = first_per_key(slim, [key], order).select(key, *present.values())
    left = predictions.drop(*columns.values()).withColumn(key, F.col(key).cast("string"))
    out = attach(left, first, [key], heavy)
    for name in columns.values():
        fallback = F.lit(defaults.get(name))
        out = out.withColumn(name, F.coalesce(F.col(name), fallback) if name in out.columns else fallback)
    return out
