"""Train, validation and test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.operators.skew import null_safe_join, running_rank


def _instants(df: DataFrame, date: str) -> DataFrame:
    """Per distinct instant: its rows and how many rows come before it.

    Positions come from counts per day, per minute and per instant, so no window holds
    more than the days of the calendar, the minutes of a day or the instants of a minute.
    """
    counted = df.groupBy(F.col(date).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_day", F.to_date("_at"))
    counted = counted.withColumn("_minute", F.hour("_at") * 60 + F.minute("_at"))

    def earlier(w) -> Column:
        return F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    days = counted.groupBy("_day").agg(F.sum("_n").alias("_n"))
    days = days.select("_day", earlier(Window.orderBy("_day")).alias("_before_day"))
    minutes = counted.groupBy("_day", "_minute").agg(F.sum("_n").alias("_n"))
    minutes = minutes.select(
        "_day", "_minute", earlier(Window.partitionBy("_day").orderBy("_minute")).alias("_before_minute")
    )
    inside = earlier(Window.partitionBy("_day", "_minute").orderBy("_at"))
    return (
        counted.withColumn("_inside", inside)
        .join(minutes, ["_day", "_minute"])
        .join(days, "_day")
        .select("_at", "_n", (F.col("_before_day") + F.col("_before_minute") + F.col("_inside")).alias("_pos"))
    )


def _row_at(df: DataFrame, date: str, positions: Sequence[int]) -> list[tuple]:
    """Per position in date order: the instant found there and how many of the rows of
    that instant come before it."""
    wanted = F.array(*[F.lit(p).cast("bigint") for p in positions])
    hit = F.filter(wanted, lambda p: (p >= F.col("_pos")) & (p < F.col("_pos") + F.col("_n")))
    found = _instants(df, date).select("_at", "_pos", F.explode(hit).alias("_p")).collect()
    by_position = {r["_p"]: (r["_at"], r["_p"] - r["_pos"]) for r in found}
    return [by_position[p] for p in positions]


def time_based_split(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.2,
    gap_days: int = 0,
    date: str = "date",
    ties: Sequence[str] = (),
    strict_gap: bool = False,
) -> DataFrame:
    """Adds `split` (train, val, test) by position in date order.

    Rows in the gap before the test start are dropped. The cut is then taken anew on the
    smaller table, unless `strict_gap` keeps the first test start. Only the cut instants
    need row order; every other row is labelled by its date alone.
    """
    kind = df.schema[date].dataType

    def literal(moment) -> Column:
        # Through text, so that no session zone touches a zone-less moment.
        return F.lit(str(moment)).cast(kind)

    n = df.count()
    start, _ = _row_at(df, date, [int(n * (1 - test_size))])[0]
    if gap_days > 0:
        begin = literal(start) - F.expr(f"INTERVAL {int(gap_days)} DAYS")
        df = df.where(~((F.col(date) >= begin) & (F.col(date) < literal(start))))
        n = df.count()
    if strict_gap:
        n_rest = df.where(F.col(date) < literal(start)).count()
        test_at = (start, 0)
        val_at = _row_at(df, date, [int(n_rest * (1 - val_size))])[0]
    else:
        n_rest = int(n * (1 - test_size))
        test_at, val_at = _row_at(df, date, [n_rest, int(n_rest * (1 - val_size))])

    cuts = [literal(test_at[0]), literal(val_at[0])]
    at_cut = (F.col(date) == cuts[0]) | (F.col(date) == cuts[1])

    def right_of(cut: tuple, ranked: bool) -> Column:
        at = literal(cut[0])
        later = F.col(date) > at
        return later | ((F.col(date) == at) & (F.col("_rank") > cut[1])) if ranked else later

    def label(ranked: bool) -> Column:
        return (
            F.when(right_of(test_at, ranked), "test").when(right_of(val_at, ranked), "val").otherwise("train")
        )

    elsewhere = df.where(~at_cut).withColumn("split", label(False))
    on_cut = running_rank(df.where(at_cut), [date], ties or df.columns, "_rank")
    return elsewhere.unionByName(on_cut.withColumn("split", label(True)).drop("_rank"))


#: Hex digits of a hash range: about a million ranges per class.
RANGE_DIGITS = 5


def stratified_split(
    df: DataFrame, label: str, key: str, parts: Sequence[tuple[str, float]], salt: str = ""
) -> DataFrame:
    """Adds `split`: exact shares of every class, drawn in hash order of the key.

    `parts` are (name, share) pairs; the last one takes the remainder. Rows are counted per
    class and hash range. Only the few ranges that hold a cut are ranked row by row; all
    other rows are placed by their range alone. A null label is a class.
    """
    digest = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    rows = df.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, RANGE_DIGITS))
    counts = rows.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n"))
    in_class = Window.partitionBy(label)
    upto = F.sum("_n").over(in_class.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"_upto": upto, "_size": F.sum("_n").over(in_class)})
    edge, cuts = 0.0, []
    for i, (_, share) in enumerate(parts[:-1]):
        edge = round(edge + share, 9)
        wanted = F.floor(F.col("_size") * F.lit(edge))
        before = F.col("_upto") - F.col("_n")
        here = (before < wanted) & (wanted <= F.col("_upto"))
        # The range that holds the cut, and how many of its rows lie before the cut.
        cuts += [F.max(F.when(here, F.col("_range"))).alias(f"_at{i}"), F.max(F.when(here, wanted - before)).alias(f"_first{i}")]
    # One row per class.
    placed = null_safe_join(rows, counts.groupBy(label).agg(*cuts), [label]) if cuts else rows
    at_cut = F.lit(False)
    for i in range(len(parts) - 1):
        at_cut = at_cut | F.coalesce(F.col("_range") == F.col(f"_at{i}"), F.lit(False))

    def place(ranked: bool) -> Column:
        pick = None
        for i, (name, _) in enumerate(parts[:-1]):
            # A class too small for the cut has no row before it.
            before = F.col("_range") < F.col(f"_at{i}")
            if ranked:
                before = before | ((F.col("_range") == F.col(f"_at{i}")) & (F.col("_rank") <= F.col(f"_first{i}")))
            pick = F.when(before, name) if pick is None else pick.when(before, name)
        last = F.lit(parts[-1][0])
        return last if pick is None else pick.otherwise(last)

    order = Window.partitionBy(label, "_range").orderBy("_digest", key)
    on_cut = placed.where(at_cut).withColumn("_rank", F.row_number().over(order))
    keep = [*df.columns, "split"]
    whole = placed.where(~at_cut).withColumn("split", place(False)).select(*keep)
    return whole.unionByName(on_cut.withColumn("split", place(True)).select(*keep))


def hash_bucket(key: str, buckets: int = 100, salt: str = "") -> Column:
    """A stable bucket number of a key."""
    digest = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def random_split(df: DataFrame, key: str, test_share: float = 0.1, salt: str = "") -> DataFrame:
    """Adds `split` (train, test). A row's side depends only on its key."""
    test = hash_bucket(key, 1000, salt) < round(test_share * 1000)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def fold_of(key: str, folds: int = 3, salt: str = "fold") -> Column:
    return hash_bucket(key, folds, salt).cast("int")
