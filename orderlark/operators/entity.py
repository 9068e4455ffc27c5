"""Statistics of customers, products and places, attached to the sales rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.operators.skew import attach, heavy_hashes
from orderlark.session import stored


def entity_features(sales: DataFrame) -> DataFrame:
    """Breadth and volume of the row's customer, product, category, manufacturer,
    settlement and district. Each entity is aggregated first and joined back. The sales are
    written once, as seven passes read a few columns of them each."""
    sales = stored(sales, "sales")
    stats = {
        "customer_id": [
            F.count_distinct("product_id").alias("customer_total_products"),
            F.count("date").alias("customer_total_orders"),
        ],
        "product_id": [
            F.count_distinct("customer_id").alias("product_total_customers"),
            F.sum("quantity").alias("product_popularity"),
        ],
        "category_h1": [F.sum("quantity").alias("category_h1_volume")],
        "manufacturer": [F.sum("quantity").alias("manufacturer_volume")],
        "settlement": [F.count_distinct("customer_id").alias("settlement_customer_count")],
        "district": [F.count("date").alias("district_order_count")],
    }
    heavy = heavy_hashes(sales, *[[k] for k in stats])
    out = sales
    for (key, aggregates), hot in zip(stats.items(), heavy):
        out = attach(out, sales.groupBy(key).agg(*aggregates), [key], hot)
    return out


def interaction_features(sales: DataFrame) -> DataFrame:
    """Share of the customer's spend that day, product concentration, and quantity
    against the product's mean."""
    sales = stored(sales, "sales")
    heavy = heavy_hashes(sales, ["customer_id", "date"], ["customer_id"], ["product_id"])
    spend = sales.groupBy("customer_id", "date").agg(F.sum("sales_value").alias("_spend"))
    breadth = sales.groupBy("customer_id").agg(F.count_distinct("product_id").alias("_breadth"))
    usual = sales.groupBy("product_id").agg(F.avg("quantity").alias("_usual"))
    out = attach(sales, spend, ["customer_id", "date"], heavy[0])
    out = attach(out, breadth, ["customer_id"], heavy[1])
    out = attach(out, usual, ["product_id"], heavy[2])
    return out.withColumns(
        {
            "share_of_wallet": F.col("sales_value") / (F.col("_spend") + 0.01),
            "customer_product_concentration": 1.0 / F.col("_breadth"),
            "relative_quantity": F.col("quantity") / (F.col("_usual") + 0.01),
        }
    ).drop("_spend", "_breadth", "_usual")
