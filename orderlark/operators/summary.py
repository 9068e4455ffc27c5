"""Overviews of sales and feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlark.operators.prepare import first_per_key
from orderlark.operators.selection import exact_quantiles


def data_summary(sales: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: size, date span, distinct customers and products, and totals."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return sales.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        F.datediff(F.max("date"), F.min("date")).cast("bigint").alias("date_days"),
        distinct("customer_id").alias("total_customers"),
        distinct("product_id").alias("total_products"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("sales_value").alias("total_value"),
        F.avg("quantity").alias("avg_order_qty"),
    )


def top_values(df: DataFrame, column: str, n: int | None = None, count: str = "order_count") -> DataFrame:
    """Rows per value, most frequent first; ties by value."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias(count))
    counted = counted.where(F.col(column).isNotNull())
    return counted if n is None else counted.orderBy(F.col(count).desc(), column).limit(n)


def top_products(sales: DataFrame, n: int, order: Sequence[str], name: str, category: str | None = None) -> DataFrame:
    """Most ordered products with the name and category of their first row."""
    rows = sales if category is None else sales.where(F.col("category_h1") == category)
    top = top_values(rows, "product_id", n)
    # n rows at most, so the rows behind them are found by a broadcast semi join.
    details = rows.join(F.broadcast(top.select("product_id")), "product_id", "left_semi")
    details = first_per_key(
        details.select("product_id", F.col(name).alias("product_name"), "category_h1", *order),
        ["product_id"],
        order,
    )
    return top.join(details.select("product_id", "product_name", "category_h1"), "product_id", "left")


def categories(sales: DataFrame) -> DataFrame:
    """Rows and distinct products per category."""
    return sales.groupBy("category_h1").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("product_id").alias("product_count")
    )


def mean_target(df: DataFrame, by: str, target: str, name: str = "mean_target") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(target).alias(name))


def reorder_rate_by_weekday(features: DataFrame) -> DataFrame:
    """Reorder rate per weekday, and overall under weekday -1."""
    days = features.select("day_of_week", "will_reorder")
    both = days.unionByName(days.withColumn("day_of_week", F.lit(-1)))
    return mean_target(both, "day_of_week", "will_reorder", "reorder_rate")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the least and greatest value; the last bin is closed.
    Empty bins are kept."""
    found = df.select(F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    start, width = _bin_edges(F.min("_v"), F.max("_v"), bins)
    edges = found.agg(F.struct(start.alias("low"), width.alias("width"))).scalar()
    position = F.least(F.floor((F.col("_v") - F.col("_e.low")) / F.col("_e.width")), F.lit(bins - 1)).cast("int")
    counts = found.withColumn("_e", edges).groupBy(position.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), edges.alias("_e"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (F.col("_e.low") + F.col("bin") * F.col("_e.width")).alias("bin_start"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def _bin_edges(low: Column, high: Column, bins: int) -> tuple[Column, Column]:
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    return start, F.when(flat, F.lit(1.0)).otherwise(high - low) / bins


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs (a <= b by position) from one aggregation, in long form."""
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(columns[i]).alias("a"),
                    F.lit(columns[j]).alias("b"),
                    F.corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias("correlation"),
                )
                for i, j in pairs
            ]
        ).alias("pairs")
    )
    return row.select(F.explode("pairs").alias("p")).select("p.*")


def describe(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per column, in long form.

    Quartiles are interpolated exactly, by selection in a few passes over `df`; give
    `accuracy` to take them from a sketch, in the one pass of the other figures.
    """
    quarters = (0.25, 0.5, 0.75)
    exact = exact_quantiles(df, columns, quarters) if accuracy is None else {}

    def quartile(c: str, q: float) -> Column:
        if accuracy is None:
            return F.lit(exact[c][quarters.index(q)]).cast("double")
        return F.percentile_approx(F.col(c), q, accuracy).cast("double")

    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"),
                    F.min(F.col(c).cast("double")).alias("min"),
                    quartile(c, 0.25).alias("q25"),
                    quartile(c, 0.5).alias("q50"),
                    quartile(c, 0.75).alias("q75"),
                    F.max(F.col(c).cast("double")).alias("max"),
                )
                for c in columns
            ]
        ).alias("all")
    )
    return row.select(F.explode("all").alias("s")).select("s.*")
