"""Stand-in inputs: the given tables read through the schemas the jobs expect."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlark.operators.prepare import prepare_sales

SALES_TIES = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
)
EVENT_TIES = ("event_id",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sales(spark: SparkSession, sf_dir: str, product: str = "p_brand") -> DataFrame:
    """Order lines under the column names of the sales input."""
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    joined = (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(who, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        F.col("o_orderdate").alias("DATE"),
        F.col("o_custkey").alias("Partner Customer Referans Code"),
        F.col(product).alias("Product Code"),
        F.col("l_quantity").alias("NetSalesQty"),
        F.col("l_extendedprice").alias("Net Sales Value LC"),
        F.col("l_discount").alias("Discount %"),
        F.col("n_name").alias("Partner Customer Settlement"),
        F.col("r_name").alias("Partner Customer District"),
        F.col("p_type").alias("Product Level H1"),
        F.col("p_brand").alias("Product Manufacturer"),
        F.col("c_mktsegment").alias("Customer Channel Current Level 1 Manager"),
        F.col("l_suppkey").alias("Salesman Code"),
        F.col("p_name").alias("Product Name"),
        F.col("c_name").alias("Partner Customer Referans Name"),
        *SALES_TIES,
    )


def sales(spark: SparkSession, sf_dir: str, product: str = "p_brand") -> DataFrame:
    return prepare_sales(raw_sales(spark, sf_dir, product))


def sales_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long pair histories with clock times."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("customer_id"),
            F.col("event_type").alias("product_id"),
            F.col("ts").alias("date"),
            F.col("value").alias("quantity"),
            F.col("value").alias("sales_value"),
            F.lit(0.0).alias("discount_pct"),
            "event_id",
        )
        .where("quantity > 0")
    )


def lines_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with customer and day: orders, prices and stock of the first generation
    are all read off them."""
    line = table(spark, sf_dir, "lineitem").select(*SALES_TIES, "l_discount")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def orders_v1(spark: SparkSession, sf_dir: str, skus: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Order lines of the first generation. Pairs of customer and part rarely repeat;
    `skus` folds the parts into that many products with real histories."""
    sku = F.col("l_partkey") if skus is None else F.col("l_partkey") % skus
    return (lines_v1(spark, sf_dir) if lines is None else lines).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_dt"),
        F.col("o_custkey").alias("customer_id"),
        sku.alias("sku_id"),
        F.col("l_quantity").alias("qty"),
        *SALES_TIES,
        "l_discount",
    )


def calendar_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("dt")).distinct()
    sunday = F.weekday("dt") == 6
    return dates.select(
        "dt",
        (sunday & (F.dayofmonth("dt") % 5 == 0)).cast("int").alias("holiday_flag"),
        (20 + 10 * F.sin(F.dayofyear("dt") * F.lit(2 * math.pi / 365))).alias("temp_c"),
    )


def prices_v1(spark: SparkSession, sf_dir: str, skus: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    return orders_v1(spark, sf_dir, skus, lines).select(
        F.col("order_dt").alias("dt"),
        "customer_id",
        "sku_id",
        (F.col("l_extendedprice") / F.col("qty")).alias("net_price"),
        F.col("l_discount").alias("discount_pct"),
        *SALES_TIES,
    )


def inventory_v1(spark: SparkSession, sf_dir: str, skus: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    """One row per day, customer and product; a third of the parts have none."""
    on_hand = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 120
    rows = orders_v1(spark, sf_dir, skus, lines).where("l_partkey % 3 <> 0")
    return (
        rows.groupBy(F.col("order_dt").alias("dt"), "customer_id", "sku_id")
        .agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
        .select(
            "dt",
            "customer_id",
            "sku_id",
            on_hand.alias("on_hand"),
            (on_hand == 0).cast("int").alias("stockout_flag"),
            (1 + F.col("l_suppkey") % 4).alias("lead_time"),
        )
    )


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))


def near(column: str | Column, digits: int = 4) -> Column:
    """Rounding for comparison: exact halves, and sums that miss one by float noise, go up."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * float(10**digits) + 0.500001) / float(10**digits)


def near_sql(expression: str, digits: int = 4) -> str:
    return f"floor(({expression}) * 1e{digits} + 0.500001) / 1e{digits}"


def strip_sql(expression: str) -> str:
    return rf"regexp_replace({expression}, '^[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"


def rounded(columns: list[str], digits: int = 4) -> list[Column]:
    return [near(c, digits).alias(c) for c in columns]


def rounded_sql(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"{near_sql(c, digits)} AS {c}" for c in columns)


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a speaker, a stand-in emotion and a place on the clock
    (one turn per half minute, fifteen characters per second)."""
    turns = table(spark, sf_dir, "conversations")
    emotions = F.array(*[F.lit(e) for e in ("hap", "neu", "sad", "ang")])
    speaker = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "operator")
    start = F.col("turn") * 30.0
    return turns.select(
        "conv_id",
        "turn",
        speaker.otherwise(F.col("role")).alias("speaker"),
        "text",
        F.get(emotions, (F.length("text") % 4).cast("int")).alias("emotion"),
        start.alias("start"),
        (start + F.length("text") / 15.0).alias("end"),
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dialogue turns: one call per user, speakers repeat in a row."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv_id"),
        "ts",
        "event_id",
        F.col("event_type").alias("speaker"),
        F.format_string("%.2f", F.col("value")).alias("text"),
        F.get(F.array(F.lit("hap"), F.lit("neu"), F.lit("sad")), (F.col("event_id") % 3).cast("int")).alias("emotion"),
        F.col("event_id").cast("double").alias("start"),
        (F.col("event_id") + 0.5).alias("end"),
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue rendered in the bracket styles, with every fourth line malformed, and with
    tabs and no-break spaces at the edges."""
    turns = dialogue(spark, sf_dir)
    text = F.concat(F.regexp_replace("text", r"[\r\n:\[\]]", " "), F.lit("\t\u00a0"))
    seconds = (F.col("turn") * 7 + F.col("conv_id") % 50).cast("int")
    clock = F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
    line = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("["), clock, F.lit("] "), F.col("speaker"), F.lit(": "), text))
        .when(
            F.col("turn") % 4 == 1,
            F.format_string("[%dm %ds 250ms - %dm %ds] %s: %s", F.floor(seconds / 60), seconds % 60, F.floor(seconds / 60) + 1, seconds % 60, "speaker", text),
        )
        .when(F.col("turn") % 4 == 2, F.format_string("[%ds\u00a0]\u00a0%s", seconds, text))
        .otherwise(F.concat(clock, F.lit(" "), text))
    )
    return turns.select("conv_id", "turn", line.alias("line"))


def analysis_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis answer per turn: plain, fenced, with fields left out, or broken; scores
    are whole, fractions or quoted."""
    turns = dialogue(spark, sf_dir)
    said = F.array(
        F.struct(F.col("speaker"), F.col("text"), F.col("emotion")),
        F.struct(F.lit("Customer").alias("speaker"), F.lit("ok").alias("text"), F.lit("neu").alias("emotion")),
    )
    quality = F.when(
        F.col("turn") % 5 != 3,
        F.struct((F.length("text") % 5 + 1).alias("score"), F.lit("x").alias("label")),
    )
    body = F.to_json(
        F.struct(
            said.alias("dialogue"),
            F.when(F.col("turn") % 5 != 2, F.lit("Card")).alias("topic"),
            F.concat(F.lit("Call "), F.col("conv_id").cast("string")).alias("summary"),
            quality.alias("quality_assessment"),
        )
    )
    score = F.concat(F.lit('"score":'), (F.length("text") % 5 + 1).cast("string"))
    half = F.when(F.col("turn") % 3 == 1, ".5").otherwise("")
    quoted = F.concat(F.lit('"score":"'), (F.length("text") % 5 + 1).cast("string"), half, F.lit('"'))
    body = F.replace(body, score, F.when(F.col("turn") % 2 == 0, quoted).otherwise(F.concat(score, half)))
    answer = (
        F.when(F.col("turn") % 7 == 1, F.concat(F.lit("\u00a0```json\n"), body, F.lit("\n```\t")))
        .when(F.col("turn") % 7 == 5, F.substring(body, 1, 25))
        .otherwise(body)
    )
    return turns.select("conv_id", "turn", answer.alias("answer"))


def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a copy whose every seventh word is dropped or replaced."""
    turns = table(spark, sf_dir, "conversations")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    dropped = F.filter(words, lambda w, i: i % 7 != 6)
    replaced = F.transform(words, lambda w, i: F.when(i % 7 == 6, F.lit("#")).otherwise(w))
    drops = F.col("conv_id") % 2 == 0
    return turns.select(
        "conv_id",
        "turn",
        F.when(drops, "dropping").otherwise("replacing").alias("model"),
        F.array_join(words, " ").alias("reference"),
        F.array_join(F.when(drops, dropped).otherwise(replaced), " ").alias("hypothesis"),
    )


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product of every embedding with every label's mean embedding.

    The means are a few vectors (one per label), so they travel as one array value.
    """
    rows = table(spark, sf_dir, "embeddings")
    return _centroid_scores(rows, rows, "label")


def _centroid_scores(rows: DataFrame, source: DataFrame, label: str) -> DataFrame:
    parts = source.select(label, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    packed = vectors.agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col("v.x").alias("mean")))).scalar()

    spread = rows.select("vec_id", "embedding", F.explode(packed).alias("c"))
    products = F.zip_with("c.mean", "embedding", lambda a, b: a * b)
    dot = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return spread.select("vec_id", "c.label", dot.alias("score"))


def bi_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    who, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return who.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("city")
    )


def bi_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("payment_type"),
        F.col("o_totalprice").alias("amount"),
    )


def bi_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.col("l_orderkey").alias("order_id"),
        (1 + F.col("l_quantity") % 5).cast("int").alias("score"),
    )
