"""Arriving call files: processed once, published as stage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderlark.functions.strings import strip
from orderlark.operators.transcripts import call_stages, parse_analysis

# Recordings that are picked up, and the names of the events.
RECORDING = r"\.(wav|mp3|flac)$"
DETECTED, STARTED, UPDATE = "file_detected", "processing_started", "processing_update"
COMPLETED, FAILED = "processing_completed", "processing_error"
ARRIVAL_SCHEMA = "filepath string, answer string"
EVENT_SCHEMA = (
    "type string, filepath string, filename string, stage string, result string, error string, "
    "event_no int, timestamp timestamp"
)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def arriving_files(spark: SparkSession, directory: str, per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Stream of (filepath, length) of recordings that appear below a folder."""
    read = spark.readStream.format("binaryFile").option("recursiveFileLookup", True)
    read = read.schema("path string, modificationTime timestamp, length bigint, content binary")
    if per_trigger:
        read = read.option("maxFilesPerTrigger", per_trigger)
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.load(directory).select(F.col("path").alias("filepath"), "length").where(F.col("filepath").rlike(RECORDING))


def arriving_answers(spark: SparkSession, directory: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of (filepath, answer): recordings with the analysis text they got."""
    read = spark.readStream.schema(ARRIVAL_SCHEMA)
    if per_trigger:
        read = read.option("maxFilesPerTrigger", per_trigger)
    return read.json(directory).where(F.col("filepath").rlike(RECORDING))


def stage_events(calls: DataFrame) -> DataFrame:
    """All events of each call in order. A call without an answer ends in an error event
    and never stops the batch; an answer that cannot be decoded publishes failure texts."""
    unreadable = F.col("answer").isNull() | (strip("answer") == "")
    base = calls.withColumn("filename", file_name(F.col("filepath")))

    def event(number: Column, kind: Column, stage: Column, result: Column, error: Column) -> list[Column]:
        return [
            kind.alias("type"),
            F.col("filepath"),
            F.col("filename"),
            stage.alias("stage"),
            result.alias("result"),
            error.alias("error"),
            number.cast("int").alias("event_no"),
            F.current_timestamp().alias("timestamp"),
        ]

    none = F.lit(None).cast("string")
    frame = F.array(
        F.struct(F.lit(0).alias("no"), F.lit(DETECTED).alias("kind")),
        F.struct(F.lit(1).alias("no"), F.lit(STARTED).alias("kind")),
        F.struct(F.lit(100).alias("no"), F.when(unreadable, FAILED).otherwise(COMPLETED).alias("kind")),
    )
    outer = base.select("filepath", "filename", F.explode(frame).alias("f"))
    error = F.when(F.col("f.kind") == FAILED, "Failed to process file: no answer")
    framed = outer.select(*event(F.col("f.no"), F.col("f.kind"), none, none, error))
    stages = call_stages(parse_analysis(base.where(~unreadable)))
    updates = stages.select(*event(F.col("stage_no") + 2, F.lit(UPDATE), F.col("stage"), F.col("result"), none))
    return framed.unionByName(updates)


def process_arrivals(arrivals: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run all files there are and stop. Each batch writes its own folder and a repeated
    batch replaces it, so a restart leaves every file's events exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stage_events(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA + ", batch int").parquet(out)


def latest_stage(events: DataFrame) -> DataFrame:
    """Newest event per file; the same on a stream and on a table."""
    newest = F.max_by(F.struct("type", "stage", "event_no"), F.struct("event_no", "type"))
    return events.groupBy("filename").agg(newest.alias("_e"), F.count(F.lit(1)).alias("n_events")).select(
        "filename", F.col("_e.type").alias("type"), F.col("_e.event_no").alias("event_no"), "n_events"
    )


def track_latest(spark: SparkSession, events_dir: str, out: str, checkpoint: str, per_trigger: int | None = None) -> StreamingQuery:
    """Follow an event folder and keep the newest stage per file: every batch writes the
    files it changed, under its own number."""
    read = spark.readStream.schema(EVENT_SCHEMA).option("recursiveFileLookup", True)
    if per_trigger:
        read = read.option("maxFilesPerTrigger", per_trigger)
    events = read.parquet(events_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return (
        latest_stage(events)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The last written state of each file."""
    rows = spark.read.parquet(out)
    last = F.max_by(F.struct("type", "event_no", "n_events"), "version").alias("_s")
    return rows.groupBy("filename").agg(last).select("filename", "_s.*")
