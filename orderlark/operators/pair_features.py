"""Features and targets along the order history of each customer-product pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from orderlark.functions.times import DAY_MICROS, calendar_features, epoch_micros, whole_days
from orderlark.operators.prepare import fill_features, last_per_key, unit_price
from orderlark.operators.skew import (
    bounded_window,
    carried,
    cut_blocks,
    heavy_and_greatest,
    is_heavy,
    null_safe_join,
    with_halo,
)

PAIR = ("customer_id", "product_id")
ROLLING_QUANTITY = (3, 5, 10)
ROLLING_VALUE = (3, 5)


def lookbacks(horizon: int) -> list[int]:
    return [horizon, 2 * horizon, 3 * horizon]


def feature_columns(horizon: int = 30) -> list[str]:
    """The model inputs, in order."""
    # The features by their names.
    recency = ["days_since_last_order", "days_since_first_order"]
    frequency = [
        "order_count",
        *[f"orders_last_{d}d" for d in lookbacks(horizon)],
        "avg_order_interval",
        "order_interval_std",
    ]
    monetary = [
        "cumulative_quantity",
        "cumulative_value",
        *[f"qty_rolling_mean_{n}" for n in ROLLING_QUANTITY],
        *[f"qty_rolling_std_{n}" for n in ROLLING_QUANTITY],
        *[f"value_rolling_mean_{n}" for n in ROLLING_VALUE],
        "avg_unit_price",
        "avg_discount",
    ]
    temporal = ["month", "quarter", "day_of_week", "is_weekend", "is_month_start", "is_month_end"]
    temporal += ["month_sin", "month_cos", "dow_sin", "dow_cos"]
    return recency + frequency + monetary + temporal + ["qty_trend", "momentum"]


def _bounded(df: DataFrame, w: WindowSpec, horizon: int) -> DataFrame:
    """Everything that looks at most nine rows back and one row ahead."""

    def rows(n: int) -> WindowSpec:
        return w.rowsBetween(-(n - 1), 0)

    gap = whole_days(F.col("_t") - F.lag("_t").over(w))
    columns = {
        "days_since_last_order": F.coalesce(gap, F.lit(3 * horizon).cast("bigint")),
        "next_order_date": F.lead("date").over(w),
        "_next_t": F.lead("_t").over(w),
        "_next_quantity": F.lead("quantity").over(w),
        "qty_trend": F.avg("quantity").over(rows(3)) / (F.avg("quantity").over(rows(6)) + 0.01),
    }
    for n in ROLLING_QUANTITY:
        columns[f"qty_rolling_mean_{n}"] = F.avg("quantity").over(rows(n))
        columns[f"qty_rolling_std_{n}"] = F.stddev_samp("quantity").over(rows(n))
    for n in ROLLING_VALUE:
        columns[f"value_rolling_mean_{n}"] = F.avg("sales_value").over(rows(n))
    gap_now = F.col("days_since_last_order")
    return df.withColumns(columns).withColumn("momentum", F.lag(gap_now).over(w) / (gap_now + 0.01))


def _plain(df: DataFrame, keys: Sequence[str], ties: Sequence[str], horizon: int) -> DataFrame:
    """One shuffle and one sort serve all frames."""
    w = Window.partitionBy(*keys).orderBy("_t", *ties)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_time = Window.partitionBy(*keys).orderBy("_t")
    place = F.row_number().over(w).cast("bigint")

    def within(days: int) -> Column:
        # Rows before the look-back are counted, not those in it: a frame that only grows
        # is updated row by row, a sliding one would be summed anew for every row.
        too_old = by_time.rangeBetween(Window.unboundedPreceding, -days * DAY_MICROS - 1)
        return place - 1 - F.count(F.lit(1)).over(too_old)

    out = _bounded(df, w, horizon)
    return out.withColumns(
        {
            "days_since_first_order": whole_days(F.col("_t") - F.first("_t").over(so_far)),
            "order_count": place,
            **{f"orders_last_{d}d": within(d) for d in lookbacks(horizon)},
            "avg_order_interval": F.avg("days_since_last_order").over(so_far),
            "order_interval_std": F.coalesce(
                F.stddev_samp("days_since_last_order").over(so_far), F.lit(0.0)
            ),
            "cumulative_quantity": F.sum("quantity").over(so_far),
            "cumulative_value": F.sum("sales_value").over(so_far),
            "avg_discount": F.avg("discount_pct").over(so_far),
        }
    )


def _rows_before(rows: DataFrame, keys: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """Per key and instant t: how many rows lie before t minus each span of days.

    Works on counts per instant. A span is a whole number of days, so a probe falls on
    an earlier day at the same time of day: running counts within single days plus a
    running count over days answer it, and no task needs a whole key.
    """
    key = list(keys)
    ticks = rows.groupBy(*key, "_t").agg(F.count(F.lit(1)).alias("_n"))
    clock = F.pmod("_t", F.lit(DAY_MICROS))
    marks = ticks.select(*key, "_t", clock.alias("_clock"), whole_days(F.col("_t")).alias("_day"), "_n")
    probes = marks.withColumn("_span", F.explode(F.array(*[F.lit(d) for d in spans])))
    probes = probes.withColumn("_day", F.col("_day") - F.col("_span")).withColumn("_n", F.lit(0).cast("bigint"))
    events = marks.withColumn("_span", F.lit(-1)).unionByName(probes)
    # Probes sort before rows of the same instant, so they count strictly earlier rows.
    in_day = Window.partitionBy(*key, "_day").orderBy("_clock", F.col("_span").desc())
    inside = events.withColumn("_inside", F.sum("_n").over(in_day.rowsBetween(Window.unboundedPreceding, 0)))
    days = events.groupBy(*key, "_day").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*key, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    hits = null_safe_join(inside.where("_span > 0"), days, [*key, "_day"])
    total = F.col("_inside") + F.col("_before")
    return hits.groupBy(*key, "_t").agg(
        *[F.max(F.when(F.col("_span") == d, total)).alias(f"_out_{d}") for d in spans]
    )


def _blocked(hot: DataFrame, keys: Sequence[str], ties: Sequence[str], horizon: int) -> DataFrame:
    """The same columns for heavy pairs: blocks with a halo, and carried totals."""
    order = ["_t", *ties]
    spans = lookbacks(horizon)
    blocks = cut_blocks(hot, keys, order)
    part = [*keys, "_block"]
    w = Window.partitionBy(*part).orderBy(*order, "_spread")
    haloed = with_halo(blocks, keys, order, before=max(ROLLING_QUANTITY), after=1)
    live = _bounded(haloed, w, horizon).where("_live").drop("_live")

    gap = F.col("days_since_last_order")
    totals = carried(
        live,
        keys,
        {
            "_c_n": F.lit(1),
            "_c_gap": gap,
            "_c_gap2": (gap * gap).cast("double"),
            "_c_qty": F.col("quantity"),
            "_c_value": F.col("sales_value"),
            "_c_disc": F.col("discount_pct"),
        },
    )
    firsts = blocks.groupBy(*keys).agg(F.min("_t").alias("_first"))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def running(value: Column, carry: str) -> Column:
        return F.sum(value).over(so_far) + F.col(carry)

    n, s1, s2 = F.col("order_count"), F.col("_s1"), F.col("_s2")
    spread = F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1))
    out = null_safe_join(live, totals, part)
    out = null_safe_join(out, F.broadcast(firsts), keys)
    out = out.withColumns(
        {
            "order_count": F.row_number().over(w) + F.col("_c_n"),
            "_s1": running(gap, "_c_gap"),
            "_s2": running((gap * gap).cast("double"), "_c_gap2"),
            "cumulative_quantity": running(F.col("quantity"), "_c_qty"),
            "cumulative_value": running(F.col("sales_value"), "_c_value"),
            "_sd": running(F.col("discount_pct"), "_c_disc"),
        }
    )
    out = null_safe_join(out, _rows_before(blocks, keys, spans), [*keys, "_t"])
    return out.withColumns(
        {
            "days_since_first_order": whole_days(F.col("_t") - F.col("_first")),
            **{f"orders_last_{d}d": n - 1 - F.col(f"_out_{d}") for d in spans},
            "avg_order_interval": s1 / n,
            "order_interval_std": F.when(n > 1, spread).otherwise(0.0),
            "avg_discount": F.col("_sd") / n,
        }
    )


def _add_targets(features: DataFrame, last_instant: int, horizon: int) -> DataFrame:
    """Reorder label and next quantity; rows whose horizon is not fully observed and
    that have no next order are dropped."""
    out = features.withColumn("days_to_next_order", whole_days(F.col("_next_t") - F.col("_t")))
    soon = F.coalesce(F.col("days_to_next_order") <= horizon, F.lit(False))
    return (
        out.withColumn("will_reorder", soon.cast("int"))
        .withColumn("next_order_quantity", F.when(soon, F.col("_next_quantity")))
        .withColumn("days_until_dataset_end", whole_days(F.lit(last_instant) - F.col("_t")))
        .where(F.col("_next_t").isNotNull() | (F.col("days_until_dataset_end") >= horizon))
    )


def build_features(
    sales: DataFrame,
    horizon: int = 30,
    targets: bool = True,
    ties: Sequence[str] = (),
    keys: Sequence[str] = PAIR,
) -> DataFrame:
    """All features (and targets) of prepared sales rows.

    `ties` are the columns that order rows of the same instant. One narrow pass first
    reads the last instant and the heavy pairs; everything else is lazy.
    """
    out, last_instant = _with_windows(sales, horizon, ties, keys)
    if targets:
        out = _add_targets(out, last_instant, horizon)
    return _finish(out, horizon) if targets else _finish(out, horizon).drop("next_order_date")


def latest_features(sales: DataFrame, horizon: int = 30, ties: Sequence[str] = (), keys: Sequence[str] = PAIR) -> DataFrame:
    """The newest feature row of each pair: the one without a next order, which the same
    window pass knows. Filter the result on a pair key to score one customer or product;
    the filter reaches the scan."""
    out, _ = _with_windows(sales, horizon, ties, keys)
    return _finish(out.where(F.col("_next_t").isNull()), horizon).drop("next_order_date")


def _with_windows(sales: DataFrame, horizon: int, ties: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, int]:
    timed = sales.withColumn("_t", epoch_micros("date"))
    (heavy,), last_instant = heavy_and_greatest(timed, [keys], F.col("_t"))
    if not heavy:
        return _plain(timed, keys, ties, horizon), last_instant
    out = _plain(timed.where(~is_heavy(keys, heavy)), keys, ties, horizon)
    hot = _blocked(timed.where(is_heavy(keys, heavy)), keys, ties, horizon)
    return out.unionByName(hot.select(*out.columns)), last_instant


def _finish(features: DataFrame, horizon: int) -> DataFrame:
    out = calendar_features(features.withColumn("avg_unit_price", unit_price()))
    return fill_features(out, feature_columns(horizon)).drop("_t", "_next_t", "_next_quantity")


def latest_per_pair(features: DataFrame, ties: Sequence[str] = (), keys: Sequence[str] = PAIR) -> DataFrame:
    """The newest row of each pair of any table, by an aggregate with map-side combine."""
    return last_per_key(features, keys, ["date", *ties])


def sequences(
    features: DataFrame,
    columns: Sequence[str],
    length: int = 10,
    ties: Sequence[str] = (),
    keys: Sequence[str] = PAIR,
    heavy: Sequence[int] | None = None,
) -> DataFrame:
    """Per row with `length` predecessors in its pair: their feature vectors, oldest
    first, and the row's own targets."""

    def collect(rows: DataFrame, w: WindowSpec) -> DataFrame:
        vector = F.array(*[F.col(c).cast("double") for c in columns])
        return rows.withColumn("sequence", F.collect_list(vector).over(w.rowsBetween(-length, -1)))

    out = bounded_window(features, keys, ["date", *ties], collect, before=length, heavy=heavy)
    return out.where(F.size("sequence") == length).select(
        *keys, "date", *ties, "sequence", "will_reorder", "next_order_quantity"
    )
