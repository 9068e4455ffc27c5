"""Loading sales files and the first-generation tables, and caching features."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlark.operators.prepare import missing_columns
from orderlark.session import swept

# Columns and types of the sales input and of the eight order tables.
SALES_TYPES = {
    "DATE": "timestamp_ntz",
    "Partner Customer Referans Code": "string",
    "Product Code": "string",
    "NetSalesQty": "double",
    "Net Sales Value LC": "double",
    "Discount %": "double",
}
STAR_SCHEMAS = {
    "orders": "order_id string, order_dt timestamp_ntz, customer_id bigint, sku_id bigint, qty bigint, "
    "unit_price double, promo_flag int, channel string, sub_channel string",
    "customers": "customer_id bigint, name string, address string, gps_lat double, gps_lon double, "
    "segment string, channel string, sub_channel string, region string",
    "skus": "sku_id bigint, brand string, category string, pack string, shelf_life int, "
    "substitution_group string, base_price double",
    "inventory": "dt timestamp_ntz, customer_id bigint, sku_id bigint, on_hand bigint, on_order bigint, "
    "stockout_flag int, last_delivery_dt timestamp_ntz, lead_time bigint",
    "prices": "dt timestamp_ntz, sku_id bigint, customer_id bigint, list_price double, net_price double, discount_pct double",
    "calendar": "dt timestamp_ntz, dow int, holiday_flag int, season string, temp_c double",
    "campaigns": "campaign_id string, start_dt timestamp_ntz, end_dt timestamp_ntz, channel string, "
    "sub_channel string, budget double, discount double, eligibility string",
    "interactions": "customer_id bigint, session_id string, ts timestamp_ntz, event_type string, sku_id bigint",
}


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    """Sales from .csv, .parquet or .pq. A CSV's header gives its columns; types are the
    declared ones (text for the rest), so no pass over the data infers them."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        df = df.withColumns({f"{c}": F.col(f"`{c}`").cast(t) for c, t in SALES_TYPES.items() if c in df.columns})
    elif lower.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        raise ValueError("Unsupported file type. Please give a CSV or Parquet file.")
    missing = missing_columns(df)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def load_all(spark: SparkSession, directory: str, suffix: str = ".csv") -> dict[str, DataFrame]:
    """The eight order tables with declared types; dates are parsed on read."""
    read = spark.read.option("header", True)
    return {name: read.schema(schema).csv(f"{directory}/{name}{suffix}") for name, schema in STAR_SCHEMAS.items()}


def feature_path(root: str, horizon: int) -> str:
    return f"{root.rstrip('/')}/features_full/h={horizon}"


def save_features(features: DataFrame, root: str, horizon: int) -> str:
    """Typed Parquet, one folder per horizon; a new run replaces it."""
    path = feature_path(root, horizon)
    features.write.mode("overwrite").parquet(path)
    return path


def load_features(spark: SparkSession, root: str, horizon: int) -> DataFrame:
    try:
        return spark.read.parquet(feature_path(root, horizon))
    except AnalysisException as missing:
        raise FileNotFoundError(f"No features at {feature_path(root, horizon)}") from missing


# Microseconds are kept; the writer's own default cuts them to milliseconds.
CSV_CLOCK = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def save_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    with swept(df.sparkSession):
        df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", CSV_CLOCK).csv(path, compression=compression)


def save_embeddings_csv(rows: DataFrame, path: str, width: int, vector: str = "embedding", label: str = "label") -> None:
    """Wide CSV: one numbered column per vector position, then Label."""
    columns = [F.get(F.col(vector), F.lit(i)).cast("double").alias(str(i)) for i in range(width)]
    rows.select(*columns, F.col(label).alias("Label")).write.mode("overwrite").option("header", True).csv(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Long metric rows (component, model, metric, value) as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("component string, model string, metric string, value double").json(path)
