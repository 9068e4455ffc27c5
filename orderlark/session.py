"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "orderlark", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir. Where the session names
    none, a single-machine context gets a temporary one and keeps it; a cluster is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orderlark-"))
    return named or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when that query ends.
SWEEP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that are run in here leave no shuffle files behind: for tables that are
    written and then read back, whose plan nobody runs again."""
    before = spark.conf.get(SWEEP_CONF, None)
    spark.conf.set(SWEEP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP_CONF) if before is None else spark.conf.set(SWEEP_CONF, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: computed once, cut off from
    its lineage, safe from lost executors, and read by column. Its shuffle files go at once."""
    path = scratch_path(df.sparkSession, label)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
