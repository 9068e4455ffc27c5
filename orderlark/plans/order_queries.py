"""Registered queries over order history, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlark.functions.scoring import discount_shopper, finite_or_zero
from orderlark.functions.times import calendar_features
from orderlark.operators import entity, evaluate, lookup, prepare, rank, snapshots, splits, summary
from orderlark.operators.pair_features import (
    PAIR,
    build_features,
    feature_columns,
    latest_features,
    sequences,
)
from orderlark.operators.skew import heavy_hashes
from orderlark.plans import views
from orderlark.plans.views import EVENT_TIES, SALES_TIES, near, near_sql
from orderlark.session import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TIES_SQL = ", ".join(SALES_TIES)
ID_SQL = f"customer_id, product_id, date, {TIES_SQL}"
ID = ["customer_id", "product_id", "date", *SALES_TIES]
LONG_ID = ["customer_id", "product_id", "date", "event_id"]

SALES_SQL = """
sales AS (
  SELECT o_custkey AS customer_id, p_brand AS product_id, o_orderdate AS date, l_quantity AS quantity,
    coalesce(l_extendedprice, 0) AS sales_value, coalesce(l_discount, 0) AS discount_pct,
    n_name AS settlement, r_name AS district, p_type AS category_h1, p_brand AS manufacturer,
    c_mktsegment AS channel_l1, l_suppkey AS salesman_id, p_name AS product_name, c_name AS customer_name,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
  WHERE l_quantity > 0)"""
LONG_SQL = """
sales AS (
  SELECT user_id AS customer_id, event_type AS product_id, ts AS date, value AS quantity,
    value AS sales_value, 0.0 AS discount_pct, event_id
  FROM events WHERE value > 0)"""


def features_sql(ties: str, horizon: int = 30, source: str = SALES_SQL) -> str:
    """The feature table in plain SQL, written independently of the Spark windows."""
    h = horizon
    day = 86_400_000_000
    counts = ",\n    ".join(
        f"""(SELECT count(*) FROM gaps q WHERE q.customer_id = g.customer_id AND q.product_id = g.product_id
      AND q.rn < g.rn AND q.t >= g.t - {m * h} * {day}::BIGINT) AS orders_last_{m * h}d"""
        for m in (1, 2, 3)
    )
    return f"""{source},
timed AS (SELECT *, epoch_us(date) AS t FROM sales),
gaps AS (
  SELECT *, row_number() OVER w AS rn,
    coalesce((t - lag(t) OVER w) // {day}, {3 * h}) AS days_since_last_order,
    lead(date) OVER w AS next_order_date, lead(t) OVER w AS next_t, lead(quantity) OVER w AS next_q
  FROM timed WINDOW w AS (PARTITION BY customer_id, product_id ORDER BY t, {ties})),
features AS (
  SELECT g.*,
    (t - min(t) OVER (PARTITION BY customer_id, product_id)) // {day} AS days_since_first_order,
    rn AS order_count,
    {counts},
    avg(days_since_last_order) OVER c AS avg_order_interval,
    coalesce(stddev_samp(days_since_last_order) OVER c, 0) AS order_interval_std,
    sum(quantity) OVER c AS cumulative_quantity, sum(sales_value) OVER c AS cumulative_value,
    avg(quantity) OVER r3 AS qty_rolling_mean_3, avg(quantity) OVER r5 AS qty_rolling_mean_5,
    avg(quantity) OVER r10 AS qty_rolling_mean_10,
    coalesce(stddev_samp(quantity) OVER r3, 0) AS qty_rolling_std_3,
    coalesce(stddev_samp(quantity) OVER r5, 0) AS qty_rolling_std_5,
    coalesce(stddev_samp(quantity) OVER r10, 0) AS qty_rolling_std_10,
    avg(sales_value) OVER r3 AS value_rolling_mean_3, avg(sales_value) OVER r5 AS value_rolling_mean_5,
    sales_value / (quantity + 0.01) AS avg_unit_price,
    avg(discount_pct) OVER c AS avg_discount,
    year(date) AS year, month(date) AS month, quarter(date) AS quarter, isodow(date) - 1 AS day_of_week,
    day(date) AS day_of_month, week(date) AS week_of_year,
    (isodow(date) >= 6)::INT AS is_weekend, (day(date) <= 5)::INT AS is_month_start,
    (day(date) >= 25)::INT AS is_month_end,
    sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
    sin(2 * pi() * (isodow(date) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS dow_cos,
    avg(quantity) OVER r3 / (avg(quantity) OVER r6 + 0.01) AS qty_trend,
    coalesce(lag(days_since_last_order) OVER w / (days_since_last_order + 0.01), 0) AS momentum,
    (next_t - t) // {day} AS days_to_next_order,
    coalesce((next_t - t) // {day} <= {h}, false)::INT AS will_reorder,
    CASE WHEN (next_t - t) // {day} <= {h} THEN next_q END AS next_order_quantity,
    ((SELECT max(t) FROM timed) - t) // {day} AS days_until_dataset_end
  FROM gaps g
  WINDOW w AS (PARTITION BY customer_id, product_id ORDER BY rn),
    c AS (w ROWS UNBOUNDED PRECEDING), r3 AS (w ROWS 2 PRECEDING), r5 AS (w ROWS 4 PRECEDING),
    r6 AS (w ROWS 5 PRECEDING), r10 AS (w ROWS 9 PRECEDING)),
labelled AS (SELECT * FROM features WHERE next_t IS NOT NULL OR days_until_dataset_end >= {h})"""


FEATURES_SQL = features_sql(TIES_SQL)
LONG_FEATURES_SQL = features_sql("event_id", source=LONG_SQL)
SCORES_SQL = f"""{FEATURES_SQL},
latest AS (
  SELECT * FROM features
  QUALIFY row_number() OVER (PARTITION BY customer_id, product_id ORDER BY date DESC,
    {', '.join(c + ' DESC' for c in SALES_TIES)}) = 1),
scores AS (
  SELECT customer_id, product_id, category_h1, days_since_last_order, avg_discount, order_count,
    round(1 / (1 + exp(-(0.02 * order_count - 0.01 * days_since_last_order))), 9) AS reorder_probability,
    round(qty_rolling_mean_3, 9) AS predicted_quantity
  FROM latest)"""


rounded, rounded_sql = views.rounded, views.rounded_sql


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Latest pair rows under a fixed scorer, so that ranking can be checked by SQL."""
    latest = latest_features(views.sales(spark, d), ties=SALES_TIES)
    logit = 0.02 * F.col("order_count") - 0.01 * F.col("days_since_last_order")
    return latest.select(
        "customer_id",
        "product_id",
        "category_h1",
        "days_since_last_order",
        "avg_discount",
        "order_count",
        F.round(1 / (1 + F.exp(-logit)), 9).alias("reorder_probability"),
        F.round("qty_rolling_mean_3", 9).alias("predicted_quantity"),
    )


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return keep


# --- cleaning and projections -------------------------------------------------------

PREPARED = ["quantity", "sales_value", "discount_pct", "settlement", "district", "category_h1", "manufacturer", "channel_l1", "salesman_id"]


@register("P1_prepare_sales", f"WITH {SALES_SQL} SELECT {ID_SQL}, {', '.join(PREPARED)} FROM sales")
def p1(spark, d):
    return views.sales(spark, d).select(*ID, *PREPARED)


CALENDAR = ["year", "month", "quarter", "day_of_week", "day_of_month", "week_of_year", "is_weekend", "is_month_start", "is_month_end"]
CIRCLE = ["month_sin", "month_cos", "dow_sin", "dow_cos"]


@register(
    "P2_temporal_features",
    f"""WITH {SALES_SQL} SELECT {ID_SQL}, year(date) AS year, month(date) AS month, quarter(date) AS quarter,
  isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, week(date) AS week_of_year,
  (isodow(date) >= 6)::INT AS is_weekend, (day(date) <= 5)::INT AS is_month_start, (day(date) >= 25)::INT AS is_month_end,
  {near_sql('sin(2 * pi() * month(date) / 12)', 6)} AS month_sin, {near_sql('cos(2 * pi() * month(date) / 12)', 6)} AS month_cos,
  {near_sql('sin(2 * pi() * (isodow(date) - 1) / 7)', 6)} AS dow_sin, {near_sql('cos(2 * pi() * (isodow(date) - 1) / 7)', 6)} AS dow_cos
FROM sales""",
)
def p2(spark, d):
    return calendar_features(views.sales(spark, d)).select(*ID, *CALENDAR, *rounded(CIRCLE, 6))


@register(
    "P3_avg_unit_price",
    f"WITH {SALES_SQL} SELECT {ID_SQL}, {near_sql('sales_value / (quantity + 0.01)', 6)} AS avg_unit_price FROM sales",
)
def p3(spark, d):
    return views.sales(spark, d).select(*ID, near(prepare.unit_price(), 6).alias("avg_unit_price"))


@register(
    "P10_ids_as_text",
    "SELECT l_orderkey::VARCHAR AS order_id, l_partkey::VARCHAR AS part_id, l_quantity AS quantity FROM lineitem",
)
def p10(spark, d):
    padded = views.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias(" order_id"), F.col("l_partkey").alias("part_id "), F.col("l_quantity").alias(" quantity ")
    )
    return prepare.ids_to_string(prepare.strip_column_names(padded), "order_id", "part_id")


@register(
    "P11_manufacturer_filter",
    f"WITH {SALES_SQL} SELECT {ID_SQL}, manufacturer FROM sales WHERE regexp_matches(lower(manufacturer), 'and#1')",
)
def p11(spark, d):
    return prepare.manufacturer_like(views.sales(spark, d), "AND#1").select(*ID, "manufacturer")


@register(
    "P13_discount_shopper",
    f"""WITH {FEATURES_SQL} SELECT {ID_SQL}, (round(avg_discount, 9) >= 0.01) AS customer_badge,
  (round(avg_discount, 9) > 0.01) AS product_badge FROM features""",
)
def p13(spark, d):
    average = F.round("avg_discount", 9)
    return build_features(views.sales(spark, d), targets=False, ties=SALES_TIES).select(
        *ID,
        discount_shopper(average).alias("customer_badge"),
        discount_shopper(average, inclusive=False).alias("product_badge"),
    )


@register(
    "P19_full_feature_table",
    f"""WITH {FEATURES_SQL} SELECT {ID_SQL}, {rounded_sql(feature_columns())}, will_reorder,
  next_order_quantity, days_to_next_order FROM labelled""",
)
def p19(spark, d):
    return build_features(views.sales(spark, d), ties=SALES_TIES).select(
        *ID, *rounded(feature_columns()), "will_reorder", "next_order_quantity", "days_to_next_order"
    )


# --- windows ------------------------------------------------------------------------

WINDOWS = {
    "W1_days_since_last_order": ["days_since_last_order"],
    "W2_days_since_first_order": ["days_since_first_order"],
    "W3_order_count": ["order_count"],
    "W4_orders_in_lookback": ["orders_last_30d", "orders_last_60d", "orders_last_90d"],
    "W5_order_interval": ["avg_order_interval", "order_interval_std"],
    "W6_cumulative": ["cumulative_quantity", "cumulative_value"],
    "W7_rolling": [c for c in feature_columns() if "_rolling_" in c],
    "W8_avg_discount": ["avg_discount"],
    "W9_qty_trend": ["qty_trend"],
    "W10_momentum": ["momentum"],
}


def _window_query(columns):
    def run(spark, d):
        out = build_features(views.sales(spark, d), targets=False, ties=SALES_TIES)
        return out.select(*ID, *rounded(columns))

    return run


def _long_window_query(columns):
    def run(spark, d):
        out = build_features(views.sales_long(spark, d), targets=False, ties=EVENT_TIES)
        return out.select(*LONG_ID, *rounded(columns))

    return run


for _name, _columns in WINDOWS.items():
    register(_name, f"WITH {FEATURES_SQL} SELECT {ID_SQL}, {rounded_sql(_columns)} FROM features")(_window_query(_columns))
for _name in ("W1_days_since_last_order", "W4_orders_in_lookback", "W7_rolling", "W9_qty_trend", "W10_momentum"):
    _columns = WINDOWS[_name]
    register(
        _name.replace("_", "_events_", 1),
        f"WITH {LONG_FEATURES_SQL} SELECT customer_id, product_id, date, event_id, {rounded_sql(_columns)} FROM features",
    )(_long_window_query(_columns))

TARGETS = "next_order_date, days_to_next_order, will_reorder, next_order_quantity, days_until_dataset_end"


@register("W11_reorder_targets", f"WITH {FEATURES_SQL} SELECT {ID_SQL}, {TARGETS} FROM labelled")
def w11(spark, d):
    return build_features(views.sales(spark, d), ties=SALES_TIES).select(*ID, *TARGETS.split(", "))


@register("W11_events_targets", f"WITH {LONG_FEATURES_SQL} SELECT customer_id, product_id, date, event_id, {TARGETS} FROM labelled")
def w11_events(spark, d):
    return build_features(views.sales_long(spark, d), ties=EVENT_TIES).select(*LONG_ID, *TARGETS.split(", "))


LATEST_SQL = f"""WITH {FEATURES_SQL} SELECT {ID_SQL}, days_since_last_order, days_since_first_order, order_count FROM features
QUALIFY row_number() OVER (PARTITION BY customer_id, product_id ORDER BY date DESC, {', '.join(c + ' DESC' for c in SALES_TIES)}) = 1"""


@register("W12_latest_per_pair", LATEST_SQL)
def w12(spark, d):
    out = latest_features(views.sales(spark, d), ties=SALES_TIES)
    return out.select(*ID, "days_since_last_order", "days_since_first_order", "order_count")


@register(
    "W15_sequences",
    f"""WITH {LONG_FEATURES_SQL},
seq AS (SELECT customer_id, product_id, date, event_id, will_reorder, next_order_quantity,
    list([days_since_last_order::DOUBLE, order_count::DOUBLE, round(quantity, 4)]) OVER w AS vectors
  FROM labelled WINDOW w AS (PARTITION BY customer_id, product_id ORDER BY date, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT customer_id, product_id, date, event_id, will_reorder, next_order_quantity,
  list_aggregate(flatten(vectors), 'string_agg', ',') AS flat
FROM (SELECT * REPLACE (list_transform(vectors, lambda v: list_transform(v, lambda x: round(x * 10000)::BIGINT)) AS vectors)
  FROM seq WHERE len(vectors) = 10)""",
)
def w15(spark, d):
    rows = views.sales_long(spark, d)
    (heavy,) = heavy_hashes(rows, PAIR)
    feats = build_features(rows, ties=EVENT_TIES)
    out = sequences(feats, ["days_since_last_order", "order_count", "quantity"], ties=EVENT_TIES, heavy=heavy)
    whole = F.transform(F.flatten("sequence"), lambda x: F.round(F.round(x, 4) * 10000).cast("bigint").cast("string"))
    return out.select(
        "customer_id", "product_id", "date", "event_id", "will_reorder", "next_order_quantity", F.array_join(whole, ",").alias("flat")
    )


# --- entity statistics and summaries ------------------------------------------------

ENTITY = [
    "customer_total_products",
    "customer_total_orders",
    "product_total_customers",
    "product_popularity",
    "category_h1_volume",
    "manufacturer_volume",
    "settlement_customer_count",
    "district_order_count",
]


@register(
    "A3_entity_features",
    f"""WITH {SALES_SQL},
c AS (SELECT customer_id, count(DISTINCT product_id) AS customer_total_products, count(*) AS customer_total_orders FROM sales GROUP BY 1),
p AS (SELECT product_id, count(DISTINCT customer_id) AS product_total_customers, sum(quantity) AS product_popularity FROM sales GROUP BY 1),
h AS (SELECT category_h1, sum(quantity) AS category_h1_volume FROM sales GROUP BY 1),
m AS (SELECT manufacturer, sum(quantity) AS manufacturer_volume FROM sales GROUP BY 1),
s AS (SELECT settlement, count(DISTINCT customer_id) AS settlement_customer_count FROM sales GROUP BY 1),
r AS (SELECT district, count(*) AS district_order_count FROM sales GROUP BY 1)
SELECT {ID_SQL}, {', '.join(ENTITY)} FROM sales JOIN c USING (customer_id) JOIN p USING (product_id)
JOIN h USING (category_h1) JOIN m USING (manufacturer) JOIN s USING (settlement) JOIN r USING (district)""",
)
def a3(spark, d):
    return entity.entity_features(views.sales(spark, d)).select(*ID, *ENTITY)


INTERACTION = ["share_of_wallet", "customer_product_concentration", "relative_quantity"]


@register(
    "A4_interaction_features",
    f"""WITH {SALES_SQL},
b AS (SELECT customer_id, count(DISTINCT product_id) AS n FROM sales GROUP BY 1)
SELECT {ID_SQL}, {near_sql("sales_value / (sum(sales_value) OVER (PARTITION BY customer_id, date) + 0.01)", 6)} AS share_of_wallet,
  {near_sql("1.0::DOUBLE / n", 6)} AS customer_product_concentration,
  {near_sql("quantity / (avg(quantity) OVER (PARTITION BY product_id) + 0.01)", 6)} AS relative_quantity
FROM sales JOIN b USING (customer_id)""",
)
def a4(spark, d):
    # The operator writes and moves whole rows, so it is given only what is read.
    sales = views.sales(spark, d).select(*ID, "sales_value", "quantity")
    return entity.interaction_features(sales).select(*ID, *rounded(INTERACTION, 6))


@register(
    "A1_data_summary",
    f"""WITH {SALES_SQL} SELECT count(*) AS total_records, min(date) AS date_start, max(date) AS date_end,
  date_diff('day', min(date), max(date)) AS date_days, count(DISTINCT customer_id) AS total_customers,
  count(DISTINCT product_id) AS total_products, sum(quantity) AS total_quantity, round(sum(sales_value), 2) AS total_value,
  round(avg(quantity), 6) AS avg_order_qty FROM sales""",
)
def a1(spark, d):
    out = summary.data_summary(views.sales(spark, d))
    return out.withColumns({"total_value": F.round("total_value", 2), "avg_order_qty": F.round("avg_order_qty", 6)})


@register(
    "A2_top_customers",
    f"WITH {SALES_SQL} SELECT customer_id, count(*) AS order_count FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
)
def a2_customers(spark, d):
    return summary.top_values(views.sales(spark, d), "customer_id", 100)


@register(
    "A2_top_products_of_category",
    f"""WITH {SALES_SQL.replace('p_brand AS product_id', 'l_partkey AS product_id')},
cat AS (SELECT * FROM sales WHERE category_h1 = 'ECONOMY ANODIZED STEEL' OR category_h1 = (SELECT min(category_h1) FROM sales)),
top AS (SELECT product_id, count(*) AS order_count FROM cat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
SELECT product_id, order_count, arg_min(product_name, (date, {TIES_SQL})) AS product_name,
  arg_min(category_h1, (date, {TIES_SQL})) AS category_h1
FROM top JOIN cat USING (product_id) GROUP BY 1, 2""",
)
def a2_products(spark, d):
    rows = views.sales(spark, d, "l_partkey")
    least = rows.agg(F.min("category_h1")).scalar()
    rows = rows.where((F.col("category_h1") == "ECONOMY ANODIZED STEEL") | (F.col("category_h1") == least))
    return summary.top_products(rows, 100, ["date", *SALES_TIES], "Product Name")


@register(
    "A2_categories",
    f"""WITH {SALES_SQL} SELECT category_h1, count(*) AS row_count, count(DISTINCT product_id) AS product_count
FROM sales GROUP BY 1""",
)
def a2_categories(spark, d):
    return summary.categories(views.sales(spark, d))


@register(
    "A6_target_rate_per_split",
    f"""WITH {FEATURES_SQL}, n AS (SELECT count(*) AS n FROM labelled),
ranked AS (SELECT *, row_number() OVER (ORDER BY date, {TIES_SQL}) - 1 AS pos FROM labelled),
split AS (SELECT *, CASE WHEN pos >= floor(n * (1 - 0.2::DOUBLE)) THEN 'test'
    WHEN pos >= floor(floor(n * (1 - 0.2::DOUBLE)) * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM ranked, n)
SELECT split, count(*) AS n_rows, round(avg(will_reorder), 9) AS mean_target FROM split GROUP BY 1""",
)
def a6(spark, d):
    feats = stored(build_features(views.sales(spark, d), ties=SALES_TIES).select("date", *SALES_TIES, "will_reorder"), "labels")
    out = summary.mean_target(splits.time_based_split(feats, ties=SALES_TIES), "split", "will_reorder")
    return out.withColumn("mean_target", F.round("mean_target", 9))


@register(
    "A8_reorder_rate_by_weekday",
    f"""WITH {FEATURES_SQL} SELECT day_of_week, count(*) AS n_rows, round(avg(will_reorder), 9) AS reorder_rate FROM labelled GROUP BY 1
UNION ALL SELECT -1, count(*), round(avg(will_reorder), 9) FROM labelled""",
)
def a8_rate(spark, d):
    out = summary.reorder_rate_by_weekday(build_features(views.sales(spark, d), ties=SALES_TIES))
    return out.withColumn("reorder_rate", F.round("reorder_rate", 9))


def _histogram_sql(column: str) -> str:
    return f"""WITH {FEATURES_SQL},
b AS (SELECT min({column})::DOUBLE AS lo, (max({column}) - min({column}))::DOUBLE / 50 AS w FROM labelled),
c AS (SELECT least(floor(({column} - lo) / w), 49)::INT AS bin, count(*) AS n FROM labelled, b WHERE {column} IS NOT NULL GROUP BY 1)
SELECT i::INT AS bin, round(lo + i * w, 6) AS bin_start, coalesce(n, 0) AS n FROM range(50) t(i) CROSS JOIN b LEFT JOIN c ON c.bin = i"""


def _histogram(column: str):
    def run(spark, d):
        values = stored(build_features(views.sales(spark, d), ties=SALES_TIES).select(column), "values")
        out = summary.histogram(values, column)
        return out.withColumn("bin_start", F.round("bin_start", 6))

    return run


for _column in ("days_to_next_order", "next_order_quantity"):
    register(f"A8_histogram_{_column}", _histogram_sql(_column))(_histogram(_column))

CORRELATED = ["days_since_last_order", "order_count", "avg_order_interval", "qty_rolling_mean_3", "avg_discount", "will_reorder"]


@register(
    "A9_correlations",
    f"WITH {FEATURES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 5) AS correlation FROM labelled"
        for i, a in enumerate(CORRELATED)
        for b in CORRELATED[i:]
    ),
)
def a9(spark, d):
    out = summary.correlations(build_features(views.sales(spark, d), ties=SALES_TIES), CORRELATED)
    return out.withColumn("correlation", F.round("correlation", 5))


# --- splits -------------------------------------------------------------------------

GAP_SPLIT_SQL = """, o AS (SELECT * FROM orders),
n0 AS (SELECT count(*) AS n FROM o),
r0 AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM o),
start AS (SELECT o_orderdate AS s FROM r0, n0 WHERE pos = floor(n * (1 - 0.2::DOUBLE))),
kept AS (SELECT o.* FROM o, start WHERE NOT (o_orderdate >= s - INTERVAL 30 DAY AND o_orderdate < s))"""


@register(
    "X1_time_based_split",
    f"""WITH x AS (SELECT 1) {GAP_SPLIT_SQL},
n1 AS (SELECT count(*) AS n FROM kept),
r1 AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM kept)
SELECT o_orderkey, o_orderdate, CASE WHEN pos >= floor(n * (1 - 0.2::DOUBLE)) THEN 'test'
  WHEN pos >= floor(floor(n * (1 - 0.2::DOUBLE)) * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r1, n1""",
)
def x1(spark, d):
    orders = views.table(spark, d, "orders")
    out = splits.time_based_split(orders, gap_days=30, date="o_orderdate", ties=["o_orderkey"])
    return out.select("o_orderkey", "o_orderdate", "split")


@register(
    "X1_time_based_split_strict_gap",
    f"""WITH x AS (SELECT 1) {GAP_SPLIT_SQL},
rest AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM kept, start WHERE o_orderdate < s),
n1 AS (SELECT count(*) AS n FROM rest)
SELECT o_orderkey, o_orderdate, CASE WHEN pos >= floor(n * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM rest, n1
UNION ALL SELECT o_orderkey, o_orderdate, 'test' FROM kept, start WHERE o_orderdate >= s""",
)
def x1_strict(spark, d):
    orders = views.table(spark, d, "orders")
    out = splits.time_based_split(orders, gap_days=30, date="o_orderdate", ties=["o_orderkey"], strict_gap=True)
    return out.select("o_orderkey", "o_orderdate", "split")


@register(
    "X1_events_clock_split",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN pos >= floor(n * (1 - 0.2::DOUBLE)) THEN 'test'
  WHEN pos >= floor(floor(n * (1 - 0.2::DOUBLE)) * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r""",
)
def x1_events(spark, d):
    events = views.table(spark, d, "events")
    return splits.time_based_split(events, date="ts", ties=["event_id"]).select("event_id", "split")


# --- lookups, ranking, planning -----------------------------------------------------

FIRST_PRODUCT_SQL = f"""prod AS (SELECT product_id, arg_min(product_name, (date, {TIES_SQL})) AS product_name,
  arg_min(manufacturer, (date, {TIES_SQL})) AS manufacturer FROM sales GROUP BY 1)"""


#: Keys without a row in the looked-up table, so that the defaults show.
UNKNOWN_SQL = "asked AS (SELECT customer_id, product_id, reorder_probability FROM scores UNION ALL SELECT -1, 'no such product', 0.5)"


def _asked(spark, d):
    """All scores, and one of a customer and a product that no sale knows."""
    known = scores(spark, d).select("customer_id", "product_id", "reorder_probability")
    return stored(known.unionByName(known.limit(1).select(F.lit(-1).cast(known.schema["customer_id"].dataType).alias("customer_id"), F.lit("no such product").alias("product_id"), F.lit(0.5).alias("reorder_probability"))), "scores")


PRODUCT_COLUMNS = {"Product Name": "product_name", "Product Manufacturer": "manufacturer"}


@register(
    "J4_product_lookup",
    f"""WITH {SCORES_SQL}, {UNKNOWN_SQL}, {FIRST_PRODUCT_SQL} SELECT customer_id, product_id, coalesce(product_name, 'Unknown Product') AS product_name,
  coalesce(manufacturer, '') AS manufacturer, {near_sql('asked.reorder_probability', 6)} AS reorder_probability FROM asked LEFT JOIN prod USING (product_id)""",
)
def j4(spark, d):
    out = lookup.with_lookup(
        _asked(spark, d), views.raw_sales(spark, d), "product_id", PRODUCT_COLUMNS, ["DATE", *SALES_TIES], lookup.PRODUCT_DEFAULTS, "Product Code"
    )
    return out.select("customer_id", "product_id", "product_name", "manufacturer", *rounded(["reorder_probability"], 6))


@register(
    "J5_customer_lookup",
    f"""WITH {SCORES_SQL},
who AS (SELECT customer_id, arg_min(customer_name, (date, {TIES_SQL})) AS customer_name, arg_min(district, (date, {TIES_SQL})) AS district
  FROM sales GROUP BY 1), {UNKNOWN_SQL}
SELECT customer_id::VARCHAR AS customer_id, product_id, coalesce(customer_name, 'Unknown Customer') AS customer_name, 'N/A' AS salesman_name, district
FROM asked LEFT JOIN who USING (customer_id)""",
)
def j5(spark, d):
    raw = views.raw_sales(spark, d)
    columns = {
        "Partner Customer Referans Name": "customer_name",
        "Salesman Name": "salesman_name",
        "Partner Customer District": "district",
    }
    out = lookup.with_lookup(
        _asked(spark, d), raw, "customer_id", columns, ["DATE", *SALES_TIES], lookup.CUSTOMER_DEFAULTS, "Partner Customer Referans Code"
    )
    return out.select("customer_id", "product_id", "customer_name", "salesman_name", "district")


@register(
    "J6_product_metadata",
    f"""WITH {SCORES_SQL}, {UNKNOWN_SQL}, {FIRST_PRODUCT_SQL} SELECT customer_id, product_id, 'Unknown Product' AS product_name,
  coalesce(manufacturer, 'Unknown') AS manufacturer FROM asked LEFT JOIN prod USING (product_id)""",
)
def j6(spark, d):
    raw = views.raw_sales(spark, d).drop("Product Name")
    out = lookup.with_lookup(
        _asked(spark, d), raw, "product_id", PRODUCT_COLUMNS, ["DATE", *SALES_TIES], lookup.STOCK_DEFAULTS, "Product Code"
    )
    return out.select("customer_id", "product_id", "product_name", "manufacturer")


def _ranked_sql(entity_id: str, tie: str, share: float) -> str:
    return f"""WITH {SCORES_SQL},
gated AS (SELECT customer_id, product_id, reorder_probability, greatest(round_even(predicted_quantity, 0), 0)::BIGINT AS predicted_quantity
  FROM scores WHERE reorder_probability >= 0.3),
prio AS (SELECT *, round(reorder_probability * {share} + predicted_quantity / (max(predicted_quantity) OVER (PARTITION BY {entity_id}) + 1) * (1 - {share}::DOUBLE), 9) AS priority_score FROM gated)"""


RANKED = ["customer_id", "product_id", "reorder_probability", "predicted_quantity", "priority_score"]


@register(
    "W17_priority_score",
    _ranked_sql("customer_id", "product_id", 0.6)
    + f" SELECT {', '.join(RANKED[:2])}, predicted_quantity, {rounded_sql(['reorder_probability', 'priority_score'], 6)} FROM prio",
)
def w17(spark, d):
    out = rank.with_priority(scores(spark, d), "customer_id", rank.CUSTOMER_SHARE, 0.3)
    return out.select("customer_id", "product_id", "predicted_quantity", *rounded(["reorder_probability", "priority_score"], 6))


def _top_sql(entity_id: str, tie: str, share: float, k: int) -> str:
    return (
        _ranked_sql(entity_id, tie, share)
        + f""" SELECT customer_id, product_id, predicted_quantity, {rounded_sql(['reorder_probability', 'priority_score'], 6)},
  row_number() OVER (PARTITION BY {entity_id} ORDER BY priority_score DESC, {tie}) AS rank FROM prio
QUALIFY row_number() OVER (PARTITION BY {entity_id} ORDER BY priority_score DESC, {tie}) <= {k}"""
    )


@register("W18_top_products_per_customer", _top_sql("customer_id", "product_id", 0.6, 5))
def w18_customer(spark, d):
    out = rank.recommend_products(scores(spark, d), 5, 0.3)
    return out.select("customer_id", "product_id", "predicted_quantity", "rank", *rounded(["reorder_probability", "priority_score"], 6))


@register("W18_top_customers_per_product", _top_sql("product_id", "customer_id", 0.7, 20))
def w18_product(spark, d):
    out = rank.recommend_customers(scores(spark, d), 20, 0.3)
    return out.select("customer_id", "product_id", "predicted_quantity", "rank", *rounded(["reorder_probability", "priority_score"], 6))


@register(
    "A5_stock_plan",
    f"""WITH {SCORES_SQL}, {FIRST_PRODUCT_SQL.replace("WHERE l_partkey % 5 <> 0 AND product_id <> 'Brand#11' ", '')}
SELECT product_id, product_name, manufacturer, round(sum(predicted_quantity), 6) AS total_qty, count(*) AS customer_count,
  round(avg(reorder_probability), 6) AS avg_confidence
FROM scores JOIN prod USING (product_id) WHERE reorder_probability >= 0.3
GROUP BY 1, 2, 3 ORDER BY total_qty DESC, product_id LIMIT 50""",
)
def a5(spark, d):
    plan = rank.stock_plan(scores(spark, d), views.raw_sales(spark, d), PRODUCT_COLUMNS, ["DATE", *SALES_TIES], "Product Code", 0.3)
    return plan.withColumn("avg_confidence", F.round("avg_confidence", 6))


FINE = "l_partkey AS product_id"


@register(
    "A5_stock_plan_by_part",
    f"""WITH {SALES_SQL.replace('p_brand AS product_id', FINE)}
SELECT product_id::VARCHAR AS product_id, product_name, manufacturer, round(sum(quantity), 6) AS total_qty, count(*) AS customer_count,
  round(avg(1 - discount_pct), 6) AS avg_confidence
FROM sales WHERE 1 - discount_pct >= 0.95 GROUP BY 1, 2, 3 ORDER BY total_qty DESC, product_id LIMIT 50""",
)
def a5_fine(spark, d):
    rows = views.sales(spark, d, "l_partkey").select(
        F.col("product_id").cast("string").alias("product_id"),
        F.col("quantity").alias("predicted_quantity"),
        (1 - F.col("discount_pct")).alias("reorder_probability"),
    )
    raw = views.raw_sales(spark, d, "l_partkey")
    plan = rank.stock_plan(rows, raw, PRODUCT_COLUMNS, ["DATE", *SALES_TIES], "Product Code", 0.95)
    return plan.withColumn("avg_confidence", F.round("avg_confidence", 6))


@register(
    "O1_top_by_score",
    f"""WITH {SCORES_SQL} SELECT customer_id, product_id, {near_sql('scores.reorder_probability', 6)} AS reorder_probability FROM scores
ORDER BY scores.reorder_probability DESC, customer_id, product_id LIMIT 50""",
)
def o1(spark, d):
    top = scores(spark, d).orderBy(F.col("reorder_probability").desc(), "customer_id", "product_id").limit(50)
    return top.select("customer_id", "product_id", *rounded(["reorder_probability"], 6))


@register(
    "O2_union_of_splits",
    "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'early' ELSE 'late' END AS part FROM orders",
)
def o2(spark, d):
    orders = views.table(spark, d, "orders")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    early = orders.where(F.col("o_orderdate") < cut).select("o_orderkey", F.lit("early").alias("part"))
    late = orders.where(F.col("o_orderdate") >= cut).select("o_orderkey", F.lit("late").alias("part"))
    return early.unionByName(late)


O3_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"


@register(
    "O3_first_and_last_per_key",
    f"""SELECT l_partkey, arg_min(l_orderkey, ({O3_ORDER})) AS first_order, arg_max(l_orderkey, ({O3_ORDER})) AS last_order
FROM lineitem GROUP BY 1""",
)
def o3(spark, d):
    order = O3_ORDER.split(", ")
    lines = views.table(spark, d, "lineitem").select("l_partkey", *order)
    first = prepare.first_per_key(lines, ["l_partkey"], order)
    last = prepare.last_per_key(lines, ["l_partkey"], order)
    return first.select("l_partkey", F.col("l_orderkey").alias("first_order")).join(
        last.select("l_partkey", F.col("l_orderkey").alias("last_order")), "l_partkey"
    )


# --- evaluation ---------------------------------------------------------------------

EVAL_SQL = f"""WITH {FEATURES_SQL},
s AS (SELECT will_reorder, next_order_quantity, round(1 / (1 + exp(-(0.02 * order_count - 0.01 * days_since_last_order))), 9) AS p,
  qty_rolling_mean_3 AS q FROM labelled)"""


def _evaluated(spark, d):
    logit = 0.02 * F.col("order_count") - 0.01 * F.col("days_since_last_order")
    return build_features(views.sales(spark, d), ties=SALES_TIES).select(
        "will_reorder", "next_order_quantity", F.round(1 / (1 + F.exp(-logit)), 9).alias("p"), F.col("qty_rolling_mean_3").alias("q")
    )


@register(
    "E1_roc_auc",
    EVAL_SQL
    + """, r AS (SELECT will_reorder, (rank() OVER (ORDER BY p) + rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(rk) FILTER (will_reorder = 1) - count(*) FILTER (will_reorder = 1) * (count(*) FILTER (will_reorder = 1) + 1) / 2.0)
  / (count(*) FILTER (will_reorder = 1) * count(*) FILTER (will_reorder = 0)), 6) AS roc_auc FROM r""",
)
def e1(spark, d):
    return evaluate.roc_auc(_evaluated(spark, d), "p", "will_reorder").select(F.round("roc_auc", 6).alias("roc_auc"))


@register(
    "E2_binary_metrics",
    EVAL_SQL
    + """, c AS (SELECT count(*) FILTER (p > 0.35 AND will_reorder = 1) AS tp, count(*) FILTER (p > 0.35 AND will_reorder = 0) AS fp,
  count(*) FILTER (p <= 0.35 AND will_reorder = 1) AS fn FROM s)
SELECT tp, fp, fn, """
    + f"{near_sql('tp / (tp + fp)', 6)} AS precision, {near_sql('tp / (tp + fn)', 6)} AS recall, {near_sql('2 * tp / (2 * tp + fp + fn)', 6)} AS f1 FROM c",
)
def e2(spark, d):
    out = evaluate.binary_metrics(_evaluated(spark, d), "p", "will_reorder", 0.35)
    return out.select("tp", "fp", "fn", *rounded(["precision", "recall", "f1"], 6))


@register(
    "E3_regression_metrics",
    EVAL_SQL
    + f""" SELECT count(*) AS n_rows, {near_sql('avg(abs(next_order_quantity - q))', 6)} AS mae,
  {near_sql('sqrt(avg((next_order_quantity - q) ** 2))', 6)} AS rmse,
  {near_sql('1 - sum((next_order_quantity - q) ** 2) / (var_pop(next_order_quantity) * count(*))', 6)} AS r2
FROM s WHERE next_order_quantity IS NOT NULL""",
)
def e3(spark, d):
    rows = _evaluated(spark, d).where("next_order_quantity IS NOT NULL")
    return evaluate.regression_metrics(rows, "q", "next_order_quantity").select("n_rows", *rounded(["mae", "rmse", "r2"], 6))


# --- first-generation snapshots -----------------------------------------------------

V1_SQL = f"""ord AS (SELECT l_orderkey AS order_id, o_orderdate AS order_dt, o_custkey AS customer_id, l_partkey AS sku_id, l_quantity AS qty,
  {TIES_SQL}, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cal AS (SELECT DISTINCT o_orderdate AS dt, (isodow(o_orderdate) = 7 AND day(o_orderdate) % 5 = 0)::INT AS holiday_flag,
  20 + 10 * sin(dayofyear(o_orderdate) * 2 * pi() / 365) AS temp_c FROM orders),
price AS (SELECT order_dt, customer_id, sku_id, arg_max(l_extendedprice / qty, ({TIES_SQL})) AS net_price,
  arg_max(l_discount, ({TIES_SQL})) AS discount_pct FROM ord GROUP BY 1, 2, 3),
inv AS (SELECT order_dt, customer_id, sku_id, (min(l_partkey) * 7 + min(l_suppkey)) % 120 AS on_hand,
  ((min(l_partkey) * 7 + min(l_suppkey)) % 120 = 0)::INT AS stockout_flag, 1 + min(l_suppkey) % 4 AS lead_time
  FROM ord WHERE l_partkey % 3 <> 0 GROUP BY 1, 2, 3)"""
V1_WINDOW = f"WINDOW w AS (PARTITION BY customer_id, sku_id ORDER BY order_dt, {TIES_SQL})"
V1_HISTORY_SQL = f"""hist AS (SELECT *, date_diff('day', lag(order_dt) OVER w, order_dt) AS gap, lead(order_dt) OVER w AS next_order_dt,
  date_diff('day', order_dt, lead(order_dt) OVER w) AS time_to_next, avg(qty) OVER (w ROWS 2 PRECEDING) AS qty_rolling_mean_30,
  CASE WHEN lead(order_dt, 2) OVER w IS NOT NULL THEN lead(qty) OVER w END AS target_qty_next FROM ord {V1_WINDOW})"""


def _v1_filled(rows: str) -> str:
    return f"""j AS (SELECT {rows}.* EXCLUDE (l_discount), holiday_flag, temp_c, net_price, coalesce(price.discount_pct, 0) AS discount_pct, on_hand, stockout_flag, lead_time
  FROM {rows} LEFT JOIN cal ON cal.dt = {rows}.order_dt LEFT JOIN price USING (order_dt, customer_id, sku_id)
  LEFT JOIN inv USING (order_dt, customer_id, sku_id)),
f AS (SELECT order_id, order_dt, customer_id, sku_id, qty, {TIES_SQL}, coalesce(gap, (SELECT median(gap) FROM j)) AS time_since_prev,
  qty_rolling_mean_30, net_price, discount_pct, coalesce(on_hand, (SELECT median(on_hand) FROM j)) AS on_hand,
  coalesce(stockout_flag, 0) AS stockout_flag, coalesce(lead_time, (SELECT median(lead_time) FROM j)) AS lead_time,
  isodow(order_dt) - 1 AS dow, (isodow(order_dt) >= 6)::INT AS is_weekend, temp_c, holiday_flag"""


V1_OUT = ["net_price", *snapshots.SNAPSHOT_FEATURES]


def _v1(spark, d, skus=None, shared=True):
    """Lines are joined to their orders once; the three tables read what was written. Where they
    are not `shared`, each joins its own: sizes of tables sway the joins, and so the partitions."""
    lines = stored(views.lines_v1(spark, d), "lines") if shared else None
    return (
        views.orders_v1(spark, d, skus, lines).drop("l_discount"),
        views.prices_v1(spark, d, skus, lines),
        views.inventory_v1(spark, d, skus, lines),
        views.calendar_v1(spark, d),
        SALES_TIES,
    )


@register(
    "J1_order_calendar",
    f"WITH {V1_SQL} SELECT {TIES_SQL}, customer_id, order_dt, holiday_flag, {rounded_sql(['temp_c'], 6)} FROM ord LEFT JOIN cal ON dt = order_dt",
)
def j1(spark, d):
    out = snapshots.with_calendar(views.orders_v1(spark, d), views.calendar_v1(spark, d))
    return out.select(*SALES_TIES, "customer_id", "order_dt", "holiday_flag", *rounded(["temp_c"], 6))


@register(
    "J2_order_prices",
    f"""WITH {V1_SQL} SELECT {TIES_SQL}, customer_id, order_dt, {rounded_sql(['net_price'], 6)}, coalesce(discount_pct, 0) AS discount_pct
FROM ord LEFT JOIN price USING (order_dt, customer_id, sku_id)""",
)
def j2(spark, d):
    out = snapshots.with_prices(views.orders_v1(spark, d).drop("l_discount"), views.prices_v1(spark, d), SALES_TIES)
    return out.select(*SALES_TIES, "customer_id", "order_dt", "discount_pct", *rounded(["net_price"], 6))


@register(
    "J3_order_inventory",
    f"""WITH {V1_SQL}, j AS (SELECT * FROM ord LEFT JOIN inv USING (order_dt, customer_id, sku_id))
SELECT {TIES_SQL}, customer_id, order_dt, coalesce(on_hand, (SELECT median(on_hand) FROM j)) AS on_hand,
  coalesce(stockout_flag, 0) AS stockout_flag, coalesce(lead_time, (SELECT median(lead_time) FROM j)) AS lead_time FROM j""",
)
def j3(spark, d):
    out = snapshots.with_inventory(views.orders_v1(spark, d), views.inventory_v1(spark, d))
    out = snapshots.fill_medians(out, ["on_hand", "lead_time"]).fillna(0, subset=["stockout_flag"])
    return out.select(*SALES_TIES, "customer_id", "order_dt", "on_hand", "stockout_flag", "lead_time")


W16_SQL = f"""WITH {V1_SQL}, {V1_HISTORY_SQL}, {_v1_filled('hist')}, time_to_next, target_qty_next,
  coalesce(time_to_next <= 14, false)::INT AS label FROM j)
SELECT {TIES_SQL}, customer_id, order_dt, {rounded_sql(V1_OUT)}, time_to_next, label, target_qty_next FROM f"""


def _snapshots(skus):
    def run(spark, d):
        out = snapshots.order_snapshots(*_v1(spark, d, skus))
        label = F.col("label_reorder_in_N").alias("label")
        return out.select(*SALES_TIES, "customer_id", "order_dt", *rounded(V1_OUT), "time_to_next", label, "target_qty_next")

    return run


register("W16_order_snapshots", W16_SQL)(_snapshots(None))
register("W16_order_snapshots_long", W16_SQL.replace("l_partkey AS sku_id", "l_partkey % 25 AS sku_id"))(_snapshots(25))


@register(
    "W22_latest_snapshot",
    f"""WITH {V1_SQL.replace('ord AS (SELECT', 'allord AS (SELECT', 1)}, {V1_HISTORY_SQL},
last AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY customer_id, sku_id
  ORDER BY order_dt DESC, {', '.join(c + ' DESC' for c in SALES_TIES)}) = 1), {_v1_filled('last')} FROM j)
SELECT {TIES_SQL}, customer_id, order_dt, qty, {rounded_sql(V1_OUT)} FROM f""".replace(
        "cal AS (SELECT DISTINCT", "ord AS (SELECT * FROM allord WHERE order_dt <= TIMESTAMP '2000-01-01'),\ncal AS (SELECT DISTINCT", 1
    ).replace("AS discount_pct FROM ord GROUP", "AS discount_pct FROM allord GROUP").replace("FROM ord WHERE l_partkey", "FROM allord WHERE l_partkey"),
)
def w22(spark, d):
    out = snapshots.latest_snapshot(*_v1(spark, d), as_of=F.lit("2000-01-01").cast("timestamp_ntz"))
    return out.select(*SALES_TIES, "customer_id", "order_dt", "qty", *rounded(V1_OUT))


@register(
    "M14_heuristic_recommendations",
    f"""WITH {V1_SQL}, {V1_HISTORY_SQL},
last AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY customer_id, sku_id
  ORDER BY order_dt DESC, {', '.join(c + ' DESC' for c in SALES_TIES)}) = 1), {_v1_filled('last')} FROM j),
p AS (SELECT *, 1 / (1 + time_since_prev / 30.0) AS p_reorder, qty_rolling_mean_30 AS qty_p50, qty_rolling_mean_30 * 1.5 AS qty_p90 FROM f),
s AS (SELECT *, round(p_reorder * (0.7 * qty_p50 + 0.3 * qty_p90) * (0.5 + 0.5 * (1 - discount_pct)) * (1 - 0.9 * stockout_flag), 9) AS sc FROM p)
SELECT customer_id, sku_id, {views.near_sql('sc', 6)} AS score, greatest(round_even(qty_p50, 0), 1)::BIGINT AS suggested_qty FROM s
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY sc DESC, sku_id) <= 10""",
)
def m14(spark, d):
    out = snapshots.latest_snapshot(*_v1(spark, d)).withColumns(
        {
            "p_reorder": 1 / (1 + F.col("time_since_prev") / 30.0),
            "qty_p50": F.col("qty_rolling_mean_30"),
            "qty_p90": F.col("qty_rolling_mean_30") * 1.5,
        }
    )
    return rank.recommend_by_value(out, 10).select("customer_id", "sku_id", *rounded(["score"], 6), "suggested_qty")


@register(
    "M6_ensemble",
    f"""WITH {SCORES_SQL}, m AS (SELECT customer_id, product_id, CASE WHEN order_count > 1 THEN reorder_probability END AS a,
  CASE WHEN days_since_last_order < 200 THEN 1 - avg_discount END AS b FROM scores)
SELECT customer_id, product_id, {near_sql('CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE 0.5 * a + 0.5 * b END', 6)} AS ensemble FROM m""",
)
def m6(spark, d):
    from orderlark.functions.scoring import ensemble

    rows = scores(spark, d)
    a = F.when(F.col("order_count") > 1, F.col("reorder_probability"))
    b = F.when(F.col("days_since_last_order") < 200, 1 - F.col("avg_discount"))
    return rows.select("customer_id", "product_id", near(ensemble({"dense": a, "boosted": b}), 6).alias("ensemble"))


@register(
    "M16_model_comparison",
    f"""WITH {SCORES_SQL}, m AS (SELECT customer_id, product_id, reorder_probability AS a, coalesce(1 - avg_discount, 0) AS b,
  CASE WHEN order_count > 1 THEN predicted_quantity ELSE 0 END AS qa, predicted_quantity + 1 AS qb FROM scores),
e AS (SELECT *, round(0.5 * a + 0.5 * b, 9) AS ens FROM m)
SELECT customer_id, product_id, {near_sql('a', 6)} AS reorder_dense, {near_sql('b', 6)} AS reorder_boosted,
  {near_sql('ens', 6)} AS reorder_ensemble, {near_sql('qa', 6)} AS quantity_dense, {near_sql('qb', 6)} AS quantity_boosted,
  {near_sql('0.5 * qa + 0.5 * qb', 6)} AS quantity_ensemble
FROM e QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ens DESC, product_id) <= 10""",
)
def m16(spark, d):
    rows = scores(spark, d)
    quantity = F.when(F.col("order_count") > 1, F.col("predicted_quantity"))
    more = F.col("predicted_quantity") + 1
    discount = 1 - F.col("avg_discount")
    table = rows.select(
        "customer_id",
        "product_id",
        F.col("reorder_probability").alias("reorder_dense"),
        discount.alias("reorder_boosted"),
        F.round(0.5 * F.col("reorder_probability") + 0.5 * discount, 9).alias("reorder_ensemble"),
        quantity.alias("quantity_dense"),
        more.alias("quantity_boosted"),
        (0.5 * finite_or_zero(quantity) + 0.5 * more).alias("quantity_ensemble"),
    )
    out = rank.compare_models(table, ["dense", "boosted", "ensemble"])
    return out.select("customer_id", "product_id", *rounded([c for c in table.columns if c.startswith(("reorder", "quantity"))], 6))
