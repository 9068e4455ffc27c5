"""Business questions over customers, orders and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.operators.skew import attach


def orders_with_reviews(customers: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per reviewed order. Reviews are summed per order first, so a join never
    multiplies orders; many-order customers are spread by the salted join."""
    per_order = reviews.groupBy("order_id").agg(F.sum("score").alias("score_sum"), F.count("score").alias("n_reviews"))
    who = customers.select(F.col("id").alias("customer_id"), "name", "city")
    named = attach(orders, who, ["customer_id"]).where(F.col("name").isNotNull())
    return named.join(per_order, named["id"] == per_order["order_id"]).drop("order_id")


def top_cities(customers: DataFrame, orders: DataFrame, n: int = 3) -> DataFrame:
    """Orders are counted per customer before they meet the customer table."""
    counts = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    cities = customers.join(counts, customers["id"] == counts["customer_id"]).groupBy("city").agg(F.sum("_n").alias("order_count"))
    return cities.orderBy(F.col("order_count").desc(), "city").limit(n)


def average_review_by_city(customers: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    joined = orders_with_reviews(customers, orders, reviews)
    return joined.groupBy("city").agg((F.sum("score_sum") / F.sum("n_reviews")).alias("avg_review"))


def most_used_payment(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy("payment_type").agg(F.count(F.lit(1)).alias("order_count"))
    return counts.orderBy(F.col("order_count").desc(), "payment_type").limit(1)


def payment_by_city(customers: DataFrame, orders: DataFrame) -> DataFrame:
    spent = orders.groupBy("customer_id").agg(F.sum("amount").alias("_amount"))
    return customers.join(spent, customers["id"] == spent["customer_id"]).groupBy("city").agg(F.sum("_amount").alias("total_payment"))


def bar_heights(df: DataFrame, value: str, tallest: int = 140) -> DataFrame:
    """Whole pixel heights relative to the greatest value, halves up; a missing value is
    drawn as 0 and counts 1 towards the greatest."""
    most = df.agg(F.max(F.coalesce(F.col(value).cast("double"), F.lit(1.0)))).scalar()
    ratio = F.try_divide(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), most)
    return df.withColumn("height", F.floor(ratio * tallest + 0.5))
