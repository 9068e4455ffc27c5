"""The heavy-key way gives the same rows as the plain way."""

from conftest import SF, rows_of
from pyspark.sql import functions as F

from orderlark.operators.pair_features import build_features, feature_columns, sequences
from orderlark.operators.skew import GROUP_ROWS_CONF, heavy_hashes, running_rank
from orderlark.plans.views import EVENT_TIES, sales_long


def test_features_equal(spark):
    long = sales_long(spark, SF)
    plain = rows_of(build_features(long, ties=EVENT_TIES))
    spark.conf.set(GROUP_ROWS_CONF, "12")
    try:
        (heavy,) = heavy_hashes(long, ["customer_id", "product_id"])
        assert len(heavy) > 100
        blocked = rows_of(build_features(long, ties=EVENT_TIES))
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert plain == blocked


def test_features_equal_daily_with_ties(spark):
    """One pair holds a third of all rows, many on the same day, with exact copies."""
    base = sales_long(spark, SF).withColumn("date", F.date_trunc("day", "date").cast("timestamp_ntz"))
    third = F.col("event_id") % 3 == 0
    base = base.withColumn("customer_id", F.when(third, F.lit(7)).otherwise(F.col("customer_id")))
    base = base.withColumn("product_id", F.when(third, F.lit("view")).otherwise(F.col("product_id")))
    base = base.withColumn("quantity", F.floor("quantity") % 5 + 1).withColumn("event_id", F.floor(F.col("event_id") / 4))
    base = base.withColumn("sales_value", F.col("quantity") * 2.0)
    ties = ["quantity", "event_id"]
    columns = ["customer_id", "product_id", "date", *feature_columns(), "will_reorder", "next_order_quantity"]
    plain = rows_of(build_features(base, ties=ties).select(*columns), 5)
    spark.conf.set(GROUP_ROWS_CONF, "100")
    try:
        blocked = rows_of(build_features(base, ties=ties).select(*columns), 5)
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert plain == blocked


def test_sequences_equal(spark, forced_skew):
    feats = build_features(sales_long(spark, SF), ties=EVENT_TIES)
    cols = ["order_count", "quantity"]
    blocked = rows_of(sequences(feats, cols, ties=EVENT_TIES))
    plain = rows_of(sequences(feats, cols, ties=EVENT_TIES, heavy=[]))
    assert blocked == plain and len(plain) > 1000


def test_running_rank(spark, forced_skew):
    long = sales_long(spark, SF)
    a = rows_of(running_rank(long, ["product_id"], ["date", "event_id"], "rn"))
    b = rows_of(running_rank(long, ["product_id"], ["date", "event_id"], "rn", heavy=[]))
    assert a == b
