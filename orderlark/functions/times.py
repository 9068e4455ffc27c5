"""Calendar columns and zone-free clock arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def epoch_micros(moment: str | Column) -> Column:
    """Microseconds since 1970 of a date or zone-less timestamp, whatever the session zone."""
    c = F.col(moment) if isinstance(moment, str) else moment
    seconds = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400
    seconds = seconds + F.hour(c) * 3600 + F.minute(c) * 60
    micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return seconds * 1_000_000 + micros


def whole_days(micros: Column) -> Column:
    """Whole days in a span of microseconds, rounded down."""
    return ((micros - F.pmod(micros, F.lit(DAY_MICROS))) / DAY_MICROS).cast("bigint")


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Date parts, weekend and month-edge flags, and month and weekday on the unit circle."""
    c = F.col(date)
    df = df.withColumns(
        {
            "year": F.year(c),
            "month": F.month(c),
            "quarter": F.quarter(c),
            "day_of_week": F.weekday(c),
            "day_of_month": F.dayofmonth(c),
            "week_of_year": F.weekofyear(c),
        }
    )
    turn_month = F.col("month") * F.lit(2 * math.pi / 12)
    turn_week = F.col("day_of_week") * F.lit(2 * math.pi / 7)
    return df.withColumns(
        {
            "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
            "is_month_start": (F.col("day_of_month") <= 5).cast("int"),
            "is_month_end": (F.col("day_of_month") >= 25).cast("int"),
            "month_sin": F.sin(turn_month),
            "month_cos": F.cos(turn_month),
            "dow_sin": F.sin(turn_week),
            "dow_cos": F.cos(turn_week),
        }
    )
