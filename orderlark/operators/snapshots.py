"""First-generation order snapshots: short pair history joined to calendar, price and stock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from orderlark.functions.times import epoch_micros, whole_days
from orderlark.operators.prepare import last_per_key
from orderlark.operators.selection import exact_quantiles
from orderlark.operators.skew import attach, bounded_window, heavy_hashes
from orderlark.session import stored

SKU_PAIR = ("customer_id", "sku_id")
DAY_KEY = ("order_dt", "customer_id", "sku_id")
# The features by their names.
SNAPSHOT_FEATURES = [
    "time_since_prev",
    "qty_rolling_mean_30",
    "discount_pct",
    "on_hand",
    "stockout_flag",
    "lead_time",
    "dow",
    "is_weekend",
    "temp_c",
    "holiday_flag",
]


def order_history(orders: DataFrame, ties: Sequence[str], n_days: int = 14, heavy: Sequence[int] | None = None) -> DataFrame:
    """Gaps to the previous and next order, the label, a mean over three rows (the
    name says 30) and the next quantity. Last orders count as no reorder."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns(
            {
                "next_order_dt": F.lead("order_dt").over(w),
                "time_to_next": whole_days(F.lead("_t").over(w) - F.col("_t")),
                "_gap": whole_days(F.col("_t") - F.lag("_t").over(w)),
                "qty_rolling_mean_30": F.avg("qty").over(w.rowsBetween(-2, 0)),
                # The next quantity counts only where that next order has a successor too.
                "target_qty_next": F.when(F.lead("_t", 2).over(w).isNotNull(), F.lead("qty").over(w)),
            }
        )

    timed = orders.withColumn("_t", epoch_micros("order_dt"))
    out = bounded_window(timed, SKU_PAIR, ["_t", *ties], compute, before=3, after=2, heavy=heavy)
    label = F.coalesce(F.col("time_to_next") <= n_days, F.lit(False)).cast("int")
    return out.withColumn("label_reorder_in_N", label).drop("_t")


def with_calendar(df: DataFrame, calendar: DataFrame, heavy: Sequence[int] | None = None) -> DataFrame:
    """The calendar has one row per day. Spark broadcasts it by its size; should it be too
    large for that, busy days are spread."""
    return attach(df, calendar.withColumnRenamed("dt", "order_dt"), ["order_dt"], heavy)


def last_price(prices: DataFrame, ties: Sequence[str]) -> DataFrame:
    daily = prices.withColumnRenamed("dt", "order_dt")
    return last_per_key(daily, DAY_KEY, ties, ["net_price", "discount_pct"])


def with_prices(df: DataFrame, prices: DataFrame, ties: Sequence[str], heavy: Sequence[int] | None = None) -> DataFrame:
    out = attach(df.drop("net_price", "discount_pct"), last_price(prices, ties), DAY_KEY, heavy)
    return out.fillna(0.0, subset=["discount_pct"])


def with_inventory(df: DataFrame, inventory: DataFrame, heavy: Sequence[int] | None = None) -> DataFrame:
    stock = inventory.withColumnRenamed("dt", "order_dt")
    return attach(df, stock.select(*DAY_KEY, "on_hand", "stockout_flag", "lead_time"), DAY_KEY, heavy)


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's median. The rows are written once, and all medians are
    selected together, with bounded buffers whatever the number of distinct values."""
    rows = stored(df, "joined")
    medians = exact_quantiles(rows, columns, [0.5])
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0]).cast("double")) for c in columns})


def _weekday(df: DataFrame) -> DataFrame:
    df = df.withColumn("dow", F.weekday("order_dt"))
    return df.withColumn("is_weekend", F.col("dow").isin(5, 6).cast("int"))


def _joined(
    rows: DataFrame,
    prices: DataFrame,
    inventory: DataFrame,
    calendar: DataFrame,
    ties: Sequence[str],
    heavy_keys: Sequence[int],
    heavy_days: Sequence[int],
) -> DataFrame:
    out = with_calendar(rows, calendar, heavy_days)
    out = with_prices(out, prices, ties, heavy_keys)
    out = with_inventory(out, inventory, heavy_keys)
    out = fill_medians(out.withColumn("time_since_prev", F.col("_gap")), ["time_since_prev", "on_hand", "lead_time"])
    return _weekday(out.fillna(0, subset=["stockout_flag"])).drop("_gap")


def order_snapshots(
    orders: DataFrame, prices: DataFrame, inventory: DataFrame, calendar: DataFrame, ties: Sequence[str], n_days: int = 14
) -> DataFrame:
    """Every order with features, label, next quantity and time to the next order."""
    # All heavy keys are read off the bare orders, in one pass.
    pairs, keys, days = heavy_hashes(orders, SKU_PAIR, DAY_KEY, ["order_dt"])
    history = order_history(orders, ties, n_days, pairs)
    return _joined(history, prices, inventory, calendar, ties, keys, days)


def latest_snapshot(
    orders: DataFrame,
    prices: DataFrame,
    inventory: DataFrame,
    calendar: DataFrame,
    ties: Sequence[str],
    as_of: Column | None = None,
) -> DataFrame:
    """The last order of each pair up to a date, with history from before it; medians are
    taken over these last rows only."""
    upto = orders if as_of is None else orders.where(F.col("order_dt") <= as_of)
    pairs, keys, days = heavy_hashes(upto, SKU_PAIR, DAY_KEY, ["order_dt"])
    history = order_history(upto, ties, heavy=pairs)
    # The last order of a pair is the one without a next.
    last = history.where("next_order_dt IS NULL").drop("next_order_dt", "time_to_next", "target_qty_next", "label_reorder_in_N")
    return _joined(last, prices, inventory, calendar, ties, keys, days)


def classification_rows(snapshots: DataFrame, ties: Sequence[str]) -> DataFrame:
    return snapshots.select("order_id", "order_dt", *SKU_PAIR, *ties, *SNAPSHOT_FEATURES, "label_reorder_in_N").dropna()


def regression_rows(snapshots: DataFrame, ties: Sequence[str]) -> DataFrame:
    rows = snapshots.where("next_order_dt IS NOT NULL AND target_qty_next IS NOT NULL")
    return rows.select("order_id", "order_dt", *SKU_PAIR, *ties, *SNAPSHOT_FEATURES, "qty", "target_qty_next").dropna()


def survival_rows(snapshots: DataFrame, ties: Sequence[str]) -> DataFrame:
    """Observed gaps only, each an event."""
    rows = snapshots.where("time_to_next IS NOT NULL").withColumn("event", F.lit(1))
    return rows.select("order_id", "order_dt", *SKU_PAIR, *ties, *SNAPSHOT_FEATURES, "time_to_next", "event")
