"""Shared by the operators: packed columns, byte-level words, Arrow passes."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space between words: space, tab, newline, VT, FF, CR.
SPACES = "[\\x20\\x09-\\x0D]+"

UPPER_TO_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
# Bytes of alphanumeric words: digits, a-z and everything beyond ASCII; the rest parts words.
_WORD_BYTES = set(b"0123456789" + string.ascii_lowercase.encode()) | set(range(0x80, 0x100))
ALNUM_WORDS = bytes(
    UPPER_TO_LOWER[b] if UPPER_TO_LOWER[b] in _WORD_BYTES else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """All columns as one struct `row`, beside working columns whose names then clash with none."""
    return df.select(*[c.alias(n) for n, c in named.items()], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def constant(one_row: DataFrame, column: str) -> Column:
    """The value of a column of a bounded one-row table as a constant of later expressions. It
    travels with the tasks; as a joined column it would be copied into every row."""
    text = one_row.select(F.to_json(column)).first()[0]
    return F.from_json(F.lit(text), one_row.schema[column].dataType)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return text.translate(ALNUM_WORDS).split()


def space_words(text: bytes) -> list[bytes]:
    """Words between white space, A-Z lower-cased. bytes.split() parts at the same six characters."""
    return text.translate(UPPER_TO_LOWER).split()


def words_column(text: str | Column) -> Column:
    """Words between white space as a SQL array; empty for null and blank texts."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    # The pattern leaves an empty string before leading and after trailing white space.
    return F.array_remove(parts, "")


def arrow_pass(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]
) -> DataFrame:
    """mapInArrow with per-task state: make() runs once a task and gives the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield step(batch)

    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def schema_ddl(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in columns)


def fixed_point(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, **more: str) -> DataFrame:
    """vec_id, x and further columns (new name = old one): x holds floor(scale * entry) as
    long, saturated at the ends of long. Rows whose vector is null, empty or holds null or
    non-finite entries go, as do those whose length is not the most frequent one (of equally
    frequent lengths the smaller one counts)."""
    slim = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), *[F.col(c).alias(n) for n, c in more.items()])
    endless = F.lit(float("inf"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != endless), F.lit(False)))
    kept = slim.where(sound).withColumn("x", F.transform("v", lambda c: F.floor(c.cast("double") * scale)))
    lengths = kept.groupBy(F.size("v").alias("length")).count().orderBy(F.col("count").desc(), "length").first()
    return kept.where(F.size("v") == (lengths["length"] if lengths else 0)).drop("v")
