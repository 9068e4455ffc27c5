"""Cleaning of sales rows and labelled texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlark.functions.strings import SPACE_CLASS, strip
from orderlark.operators.skew import attach

# Column names of the sales input and the names used here.
SALES_COLUMNS = {
    "DATE": "date",
    "Partner Customer Referans Code": "customer_id",
    "Product Code": "product_id",
    "NetSalesQty": "quantity",
    "Net Sales Value LC": "sales_value",
    "Discount %": "discount_pct",
    "Partner Customer Settlement": "settlement",
    "Partner Customer District": "district",
    "Product Level H1": "category_h1",
    "Product Level H2": "category_h2",
    "Product Level H3": "category_h3",
    "Product Manufacturer": "manufacturer",
    "Customer Channel Current Level 1 Manager": "channel_l1",
    "Salesman Code": "salesman_id",
}
REQUIRED_SALES_COLUMNS = ["DATE", "Partner Customer Referans Code", "Product Code", "NetSalesQty"]
# The written guide of the input names the customer column this way.
SALES_ALIASES = {"Partner Customer Code": "Partner Customer Referans Code"}


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def ids_to_string(df: DataFrame, *ids: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ids})


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_SALES_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def prepare_sales(df: DataFrame) -> DataFrame:
    """Canonical names, parsed date, null measures as 0, and only rows that have ids and
    a positive quantity."""
    for alias, name in SALES_ALIASES.items():
        if alias in df.columns and name not in df.columns:
            df = df.withColumnRenamed(alias, name)
    df = df.withColumnsRenamed(SALES_COLUMNS).withColumn("date", F.col("date").cast("timestamp_ntz"))
    quantity = F.col("quantity").cast("double")
    others = [c for c in ("discount_pct", "sales_value") if c in df.columns]
    # A null quantity counts as 0 and goes; filtering before any fill lets the scan do it.
    return (
        df.where((F.col("quantity") > 0) & ~F.isnan(quantity))
        .where(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull())
        .withColumns({"quantity": quantity, **{c: F.col(c).cast("double") for c in others}})
        .fillna(0.0, subset=others)
    )


def unit_price(value: str = "sales_value", quantity: str = "quantity") -> Column:
    return F.col(value) / (F.col(quantity) + 0.01)


def fill_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(features))


def manufacturer_like(df: DataFrame, pattern: str, column: str = "manufacturer") -> DataFrame:
    """Case-insensitive pattern filter."""
    return df.where(F.lower(F.col(column)).rlike(pattern.lower()))


NOT_SPACE = rf"[^{SPACE_CLASS}]+"
WORD_CHARS = r"\p{L}\p{N}_"
SHORT_GIBBERISH = r"\A[" + WORD_CHARS + r"\s.,\-']{0,10}\z"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(NOT_SPACE))


def trim_labels(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, strip(label))


def missing_and_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: nulls per column, row count, and rows that repeat an earlier row."""
    per_row = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(
        *[
            F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"missing_{c}")
            for c in columns
        ],
        F.sum("_n").alias("n_rows"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"),
    )


def remap_labels(df: DataFrame, label: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(mapping), subset=[label])


def correct_labels(df: DataFrame, corrections: DataFrame, key: str, label: str) -> DataFrame:
    """Point updates: rows named in `corrections` (key, label) take the label given there;
    of several corrections of one key the greatest label counts."""
    fixes = corrections.groupBy(key).agg(F.max(label).alias("_fixed"))
    return df.join(fixes, key, "left").withColumn(label, F.coalesce("_fixed", label)).drop("_fixed")


def is_short_text(text: str, min_words: int = 24) -> Column:
    return (word_count(text) < min_words) | F.col(text).rlike(SHORT_GIBBERISH)


def drop_short_texts(df: DataFrame, text: str, min_words: int = 24) -> DataFrame:
    return df.where(~is_short_text(text, min_words))


def short_texts(df: DataFrame, text: str, min_words: int = 24) -> DataFrame:
    """The removed set itself, as distinct texts: too few words, or only a few plain characters."""
    too_few = df.where(word_count(text) < min_words)
    plain = df.where(F.col(text).rlike(SHORT_GIBBERISH))
    return too_few.select(text).unionByName(plain.select(text)).distinct()


def without(df: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in `removed`; a key that very many rows share is spread."""
    return attach(df, removed.select(*keys).distinct(), keys, how="left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _edge_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The last row of each key, or of it the named columns: only these move with the order."""
    return _edge_per_key(df, keys, order, F.max_by, columns)


def _edge_per_key(df, keys, order, pick, columns=None):
    # An aggregate, not a window: map-side combine keeps one row per key and task.
    rest = [c for c in (df.columns if columns is None else columns) if c not in keys]
    edge = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    out = df.groupBy(*keys).agg(edge).select(*keys, "_row.*")
    return out.select(*df.columns) if columns is None else out
