"""Transcript and recording files in nested folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_NAME = r"([^/]+)\.[^./]+$"


def transcript_files(spark: SparkSession, directory: str, glob: str = "*.txt", key: str = BASE_NAME) -> DataFrame:
    """(key, path, content) of every text file below a folder."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    rows = read.text(directory, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(path, key, 1).alias("key"), path.alias("path"), F.col("value").alias("content"))


def list_files(spark: SparkSession, directory: str, glob: str, key: str = BASE_NAME) -> DataFrame:
    """(key, path, length) of files; their content is not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return read.load(directory).select(F.regexp_extract("path", key, 1).alias("key"), "path", "length")


def with_recording(transcripts: DataFrame, recordings: DataFrame) -> DataFrame:
    return transcripts.join(recordings.select("key", F.col("path").alias("recording")).dropDuplicates(["key"]), "key")


def without_recording(transcripts: DataFrame, recordings: DataFrame) -> DataFrame:
    return transcripts.join(recordings, "key", "left_anti")
