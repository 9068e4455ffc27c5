"""Registered queries over sources, sinks and streams. Each writes data that Spark derives
from the tables into the shared folder, and reads it back through the job under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlark.operators import evaluate
from orderlark.operators.pair_features import build_features
from orderlark.operators.prepare import missing_columns, prepare_sales
from orderlark.plans import views
from orderlark.plans.dialogue_queries import DIALOGUE_SQL
from orderlark.plans.order_queries import EVAL_SQL, FEATURES_SQL, ID, ID_SQL, SALES_SQL, _evaluated
from orderlark.plans.views import SALES_TIES, rounded, rounded_sql
from orderlark.session import scratch_path
from orderlark.sources import files, tables
from orderlark.streaming import stages

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return keep


S1_SQL = f"""WITH {SALES_SQL} SELECT customer_id::VARCHAR AS customer_id, product_id, date, l_orderkey::VARCHAR AS l_orderkey,
  l_linenumber::VARCHAR AS l_linenumber, quantity, sales_value, discount_pct, district FROM sales"""


def _s1_columns(df):
    return prepare_sales(df).select(
        F.col("customer_id").cast("string").alias("customer_id"), "product_id", "date",
        F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"),
        "quantity", "sales_value", "discount_pct", "district",
    )


@register("S1_load_sales_csv", S1_SQL)
def s1_csv(spark, d):
    path = scratch_path(spark, "sales") + ".csv"
    tables.save_csv(views.raw_sales(spark, d), path, compression="gzip")
    return _s1_columns(tables.load_sales(spark, path))


@register("S1_load_sales_parquet", S1_SQL)
def s1_parquet(spark, d):
    path = scratch_path(spark, "sales") + ".parquet"
    views.raw_sales(spark, d).write.parquet(path)
    return _s1_columns(tables.load_sales(spark, path))


@register(
    "S2_missing_columns",
    "SELECT 'Product Code,NetSalesQty' AS missing, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def s2(spark, d):
    rows = views.raw_sales(spark, d).drop("Product Code", "NetSalesQty")
    return rows.agg(F.lit(",".join(missing_columns(rows))).alias("missing"), F.count(F.lit(1)).alias("n_rows"))


@register(
    "S3_load_all_tables",
    """SELECT 'orders' AS name, count(*) AS n_rows, min(o_orderdate) AS first_date FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT 'customers', count(*), NULL FROM customer UNION ALL SELECT 'skus', count(*), NULL FROM part
UNION ALL SELECT 'prices', count(*), min(o_orderdate) FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT 'calendar', count(DISTINCT o_orderdate), min(o_orderdate) FROM orders
UNION ALL SELECT 'inventory', count(*), min(o_orderdate) FROM (SELECT DISTINCT o_orderdate, o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 3 <> 0)
UNION ALL SELECT 'campaigns', count(*), min(date) FROM (SELECT s_suppkey, TIMESTAMP '1995-01-01' AS date FROM supplier)
UNION ALL SELECT 'interactions', count(*), min(ts) FROM events""",
)
def s3(spark, d):
    root = scratch_path(spark, "star")
    line = views.orders_v1(spark, d)
    who, part, events = (views.table(spark, d, t) for t in ("customer", "part", "events"))
    suppliers = views.table(spark, d, "supplier")
    given = {
        "orders": line.select(F.col("order_id").cast("string"), "order_dt", "customer_id", "sku_id", F.col("qty").cast("bigint")),
        "customers": who.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name")),
        "skus": part.select(F.col("p_partkey").alias("sku_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category")),
        "inventory": views.inventory_v1(spark, d),
        "prices": views.prices_v1(spark, d).select("dt", "sku_id", "customer_id", "net_price", "discount_pct"),
        "calendar": views.calendar_v1(spark, d),
        "campaigns": suppliers.select(F.col("s_suppkey").cast("string").alias("campaign_id"), F.lit("1995-01-01").cast("timestamp_ntz").alias("start_dt")),
        "interactions": events.select(F.col("user_id").alias("customer_id"), "ts", "event_type"),
    }
    for name, df in given.items():
        # Every declared column is written, in order; what the tables lack stays empty.
        fields = [f.strip().split(" ") for f in tables.STAR_SCHEMAS[name].split(",")]
        full = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in fields])
        tables.save_csv(full, f"{root}/{name}.csv")
    dated = {"orders": "order_dt", "prices": "dt", "calendar": "dt", "inventory": "dt", "campaigns": "start_dt", "interactions": "ts"}
    out = None
    for name, df in tables.load_all(spark, root).items():
        first = F.min(dated[name]) if name in dated else F.lit(None).cast("timestamp_ntz")
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), first.alias("first_date")).select(F.lit(name).alias("name"), "n_rows", "first_date")
        out = one if out is None else out.unionByName(one)
    return out


CACHED = ["days_since_last_order", "order_count", "avg_order_interval", "momentum"]


@register("S4_feature_cache", f"WITH {FEATURES_SQL} SELECT {ID_SQL}, {rounded_sql(CACHED)}, will_reorder FROM labelled")
def s4(spark, d):
    root = scratch_path(spark, "features")
    tables.save_features(build_features(views.sales(spark, d), ties=SALES_TIES), root, 30)
    return tables.load_features(spark, root, 30).select(*ID, *rounded(CACHED), "will_reorder")


@register(
    "S5_embedding_csv",
    "SELECT count(*) AS n_rows, "
    + ", ".join(f"round(sum(embedding[{i + 1}]::DOUBLE), 3) AS sum_{i}" for i in (0, 31, 63))
    + ', "label" FROM embeddings GROUP BY "label"',
)
def s5(spark, d):
    path = scratch_path(spark, "embeddings")
    tables.save_embeddings_csv(views.table(spark, d, "embeddings"), path, 64)
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy(F.col("Label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.round(F.sum(F.col(f"{i}").cast("double")), 3).alias(f"sum_{i}") for i in (0, 31, 63)]
    )


@register(
    "S6_metric_sink",
    EVAL_SQL
    + """, m AS (SELECT count(*)::DOUBLE AS n_rows, avg(abs(next_order_quantity - q)) AS mae FROM s WHERE next_order_quantity IS NOT NULL)
SELECT 'quantity' AS component, 'rolling' AS model, 'n_rows' AS metric, n_rows AS value FROM m UNION ALL SELECT 'quantity', 'rolling', 'mae', round(mae, 6) FROM m""",
)
def s6(spark, d):
    path = scratch_path(spark, "metrics")
    found = evaluate.regression_metrics(_evaluated(spark, d).where("next_order_quantity IS NOT NULL"), "q", "next_order_quantity")
    tables.save_metrics(evaluate.long_metrics(found, "quantity", "rolling"), path)
    read = tables.load_metrics(spark, path).where("metric IN ('n_rows', 'mae')")
    return read.withColumn("value", F.round("value", 6))


CALL_KEY = r"conv_id=([^/]+)/"


def _write_call_files(spark, d):
    """A text file per call, and for two of three calls a recording beside it."""
    root = scratch_path(spark, "calls")
    lines = views.transcript_lines(spark, d)
    by_call = lines.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    by_call.select("conv_id", "line").write.partitionBy("conv_id").text(f"{root}/transcripts")
    recorded = by_call.where("conv_id % 3 <> 0").select("conv_id", "line")
    recorded.write.partitionBy("conv_id").option("extension", "wav").csv(f"{root}/audio")
    return root


@register(
    "S7_transcripts_and_recordings",
    """SELECT conv_id::VARCHAR AS key, conv_id % 3 <> 0 AS recorded, count(*) AS n_lines FROM conversations GROUP BY conv_id""",
)
def s7(spark, d):
    root = _write_call_files(spark, d)
    texts = files.transcript_files(spark, f"{root}/transcripts", key=CALL_KEY)
    recordings = files.list_files(spark, f"{root}/audio", "*.wav", key=CALL_KEY)
    matched = files.with_recording(texts, recordings).withColumn("recorded", F.lit(True)).drop("recording")
    rest = files.without_recording(texts, recordings).withColumn("recorded", F.lit(False))
    both = matched.unionByName(rest)
    return both.select("key", "recorded", F.regexp_count(F.col("content"), F.lit(r"[^\n]+")).cast("bigint").alias("n_lines"))


@register("S8_arriving_recordings", "SELECT DISTINCT conv_id::VARCHAR AS key, 'wav' AS kind FROM conversations WHERE conv_id % 3 <> 0")
def s8(spark, d):
    root = _write_call_files(spark, d)
    out, state = scratch_path(spark, "arrivals"), scratch_path(spark, "arrivals-state")
    query = (
        stages.arriving_files(spark, f"{root}/audio")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.parquet(out)
    return found.select(
        F.regexp_extract("filepath", CALL_KEY, 1).alias("key"), F.regexp_extract("filepath", stages.RECORDING, 1).alias("kind")
    )


# --- streams ------------------------------------------------------------------------

ARRIVALS_SQL = f"""{DIALOGUE_SQL},
calls AS (SELECT *, 'call_' || conv_id || '_' || turn || '.wav' AS filename, turn % 13 = 4 AS silent, turn % 7 = 5 AS broken FROM dialogue WHERE turn % 11 <> 7)"""


def _write_arrivals(spark, d, parts=4):
    root = scratch_path(spark, "inbox")
    answers = views.analysis_json(spark, d)
    suffix = F.when(F.col("turn") % 11 == 7, ".txt").otherwise(".wav")
    path = F.concat(F.lit("/inbox/call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), suffix)
    answer = F.when(F.col("turn") % 13 != 4, F.col("answer")).otherwise("")
    answers.select(path.alias("filepath"), answer.alias("answer")).repartition(parts).write.json(root)
    return root


def _events(spark, d):
    inbox = _write_arrivals(spark, d)
    out, state = scratch_path(spark, "stage-events"), scratch_path(spark, "stage-state")
    stages.process_arrivals(stages.arriving_answers(spark, inbox), out, state).awaitTermination()
    # A restart on the same checkpoint finds nothing new and repeats nothing.
    stages.process_arrivals(stages.arriving_answers(spark, inbox), out, state).awaitTermination()
    return out


@register(
    "R1_process_once",
    f"""WITH {ARRIVALS_SQL} SELECT filename, (CASE WHEN silent THEN 3 ELSE 8 END)::BIGINT AS n_events FROM calls""",
)
def r1(spark, d):
    events = stages.read_events(spark, _events(spark, d))
    return events.groupBy("filename").agg(F.count(F.lit(1)).alias("n_events"))


@register(
    "R2_stage_events",
    f"""WITH {ARRIVALS_SQL} SELECT filename, 0 AS event_no, 'file_detected' AS type, NULL AS stage FROM calls
UNION ALL SELECT filename, 1, 'processing_started', NULL FROM calls
UNION ALL SELECT filename, 2 + i, 'processing_update', (['identified_dialogue', 'emotion_analysis', 'summary', 'topic_classification', 'classification'])[i + 1] FROM calls, range(5) t(i) WHERE NOT silent
UNION ALL SELECT filename, 100, CASE WHEN silent THEN 'processing_error' ELSE 'processing_completed' END, NULL FROM calls""",
)
def r2(spark, d):
    return stages.read_events(spark, _events(spark, d)).select("filename", "event_no", "type", "stage")


@register(
    "R3_latest_stage",
    f"""WITH {ARRIVALS_SQL} SELECT filename, CASE WHEN silent THEN 'processing_error' ELSE 'processing_completed' END AS type, 100 AS event_no,
  (CASE WHEN silent THEN 3 ELSE 8 END)::BIGINT AS n_events FROM calls""",
)
def r3(spark, d):
    events = _events(spark, d)
    out, state = scratch_path(spark, "latest"), scratch_path(spark, "latest-state")
    stages.track_latest(spark, events, out, state).awaitTermination()
    return stages.read_latest(spark, out).select("filename", "type", "event_no", "n_events")


@register(
    "R4_error_isolation",
    f"""WITH {ARRIVALS_SQL} SELECT type, count(*) AS n, count(DISTINCT filename) AS n_files FROM (
  SELECT filename, CASE WHEN silent THEN 'processing_error' ELSE 'processing_completed' END AS type FROM calls
  UNION ALL SELECT filename, 'failed_stage' FROM calls, range(5) WHERE broken AND NOT silent) GROUP BY 1""",
)
def r4(spark, d):
    events = stages.read_events(spark, _events(spark, d))
    failed = F.col("result") == "Analysis failed."
    failed = failed | F.startswith(F.col("result"), F.lit('["ERROR')) | F.startswith(F.col("result"), F.lit('{"label":"Error"'))
    kind = F.when(F.col("type").isin(stages.FAILED, stages.COMPLETED), F.col("type")).when(failed, "failed_stage")
    shown = events.withColumn("type", kind).where(F.col("type").isNotNull())
    return shown.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("filename").alias("n_files"))
