"""Grouped work that survives a key holding a large share of all rows.

Window functions put a whole group into one task. Here the few keys that are too big
for that are found with a heavy-hitter sketch, and only their rows take a second way:
they are range-partitioned into ordered blocks, each block gets the few neighbour rows
its bounded frames need (the halo), and running totals are carried from block to block
through a table with one row per block. All other keys keep the plain window plan.

Which keys count as heavy never changes a result, only the plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from orderlark.session import stored

MAX_GROUP_ROWS = 1_000_000
GROUP_ROWS_CONF = "spark.orderlark.maxGroupRows"
# Keys are sketched in parts by hash; each part names its thousand most frequent ones.
SKETCH_PARTS = 8
SKETCH_TOP = 1000
SKETCH_ITEMS = 10_000
SALTS = 256


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(MAX_GROUP_ROWS)))


def heavy_hashes(df: DataFrame, *key_sets: Sequence[str]) -> list[list[int]]:
    """Hashes of the heavy keys of each key set, in one pass that shuffles only sketches.

    A key is heavy above max_group_rows and an eight-thousandth of all rows, so each list
    has at most eight thousand entries whatever the data size.
    """
    return heavy_and_greatest(df, key_sets, F.lit(0))[0]


def heavy_and_greatest(
    df: DataFrame, key_sets: Sequence[Sequence[str]], value: Column
) -> tuple[list[list[int]], int | None]:
    """As heavy_hashes, and the greatest value of an expression from the same pass."""
    sets = [F.struct(F.lit(i).alias("set"), F.xxhash64(*keys).alias("key")) for i, keys in enumerate(key_sets)]
    hashed = df.select(value.alias("_v"), F.explode(F.array(*sets)).alias("k")).select("_v", "k.*")
    found = (
        hashed.groupBy("set", F.pmod("key", F.lit(SKETCH_PARTS)).alias("_part"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("_v").alias("greatest"),
            F.expr(f"approx_top_k(key, {SKETCH_TOP}, {SKETCH_ITEMS})").alias("top"),
        )
        .collect()
    )
    n_rows = sum(r["n"] for r in found if r["set"] == 0)
    floor = max(max_group_rows(df.sparkSession), n_rows // (SKETCH_TOP * SKETCH_PARTS))
    heavy: list[list[int]] = [[] for _ in key_sets]
    for r in found:
        heavy[r["set"]] += [item["item"] for item in r["top"] if item["count"] > floor]
    return heavy, max((r["greatest"] for r in found if r["greatest"] is not None), default=None)


def is_heavy(keys: Sequence[str], hashes: Sequence[int]) -> Column:
    # One parsed list instead of thousands of separate literal calls.
    names = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"xxhash64({names}) IN ({', '.join(f'{h}L' for h in hashes)})")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null; the key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def attach(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], heavy: Sequence[int] | None = None, how: str = "left"
) -> DataFrame:
    """Join a table with one row per key onto the rows (left, left_semi or left_anti).

    Rows of heavy keys are spread over SALTS sub-keys and their stats row is copied to
    each; all other keys have the one sub-key 0. The salt is a hash of the row, so a
    recomputed task repeats it.
    """
    if heavy is None:
        (heavy,) = heavy_hashes(df, keys)
    if not heavy:
        return df.join(stats, list(keys), how)
    salt = F.when(is_heavy(keys, heavy), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(F.lit(0))
    every = F.expr(f"sequence(0L, {SALTS - 1}L)")
    copies = F.when(is_heavy(keys, heavy), every).otherwise(F.expr("array(0L)"))
    salted = stats.withColumn("_salt", F.explode(copies))
    return df.withColumn("_salt", salt.cast("bigint")).join(salted, [*keys, "_salt"], how).drop("_salt")


def cut_blocks(hot: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """Order the rows of heavy keys into blocks of about `block_rows` rows.

    Adds `_block` (ascending along keys, order) and `_spread` (a last tie-break that
    also separates exact copies). Both are written out, so that every later use and every
    recomputed task sees the same cut.
    """
    block_rows = block_rows or max_group_rows(hot.sparkSession)
    frozen = stored(hot.withColumn("_spread", F.monotonically_increasing_id()), "heavy")
    blocks = max(1, math.ceil(frozen.count() / block_rows))
    cut = frozen.repartitionByRange(blocks, *keys, *order, "_spread")
    return stored(cut.withColumn("_block", F.spark_partition_id()), "blocks")


def _edge_rows(blocked: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, ahead: bool) -> DataFrame:
    """The n rows just before (or after) each block of a key, labelled with that block."""
    part = [*keys, "_block"]
    along = [F.col(c) for c in (*order, "_spread")]
    inward = [c.asc() if ahead else c.desc() for c in along]
    ranked = blocked.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*inward)))
    payload = [c for c in blocked.columns if c != "_block"]
    edges = (
        ranked.where(F.col("_r") <= n)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct("_r", F.struct(*payload).alias("row")))).alias("_edge"))
    )
    # Each block of a key has at least one of its rows, so n blocks are always enough.
    by_block = Window.partitionBy(*keys).orderBy("_block")
    frame = by_block.rowsBetween(1, n) if ahead else by_block.rowsBetween(-n, -1)
    gathered = F.collect_list("_edge").over(frame)
    nearest_first = F.flatten(gathered if ahead else F.reverse(gathered))
    return (
        edges.select("_block", F.slice(nearest_first, 1, n).alias("_near"))
        .select("_block", F.explode("_near").alias("_n"))
        .select("_n.row.*", "_block")
    )


def with_halo(blocked: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int) -> DataFrame:
    """Blocks plus the neighbour rows bounded frames reach into; `_live` marks own rows."""
    out = blocked.withColumn("_live", F.lit(True))
    for n, ahead in ((before, False), (after, True)):
        if n:
            edge = _edge_rows(blocked, keys, order, n, ahead).withColumn("_live", F.lit(False))
            out = out.unionByName(edge)
    return out


def carried(blocked: DataFrame, keys: Sequence[str], sums: dict[str, Column], maxes: dict[str, Column] | None = None) -> DataFrame:
    """Per block of a key: totals over all earlier blocks of that key."""
    maxes = maxes or {}
    per_block = blocked.groupBy(*keys, "_block").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxes.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums],
        *[F.max(n).over(earlier).alias(n) for n in maxes],
    )


def bounded_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int,
    after: int = 0,
    heavy: Sequence[int] | None = None,
) -> DataFrame:
    """Apply `compute(rows, window)` whose frames reach at most `before` rows back and
    `after` rows ahead."""
    if heavy is None:
        (heavy,) = heavy_hashes(df, keys)
    plain = Window.partitionBy(*keys).orderBy(*order)
    if not heavy:
        return compute(df, plain)
    hot = cut_blocks(df.where(is_heavy(keys, heavy)), keys, order)
    haloed = with_halo(hot, keys, order, before, after)
    by_block = Window.partitionBy(*keys, "_block").orderBy(*order, "_spread")
    hot_out = compute(haloed, by_block).where("_live").drop("_live", "_block", "_spread")
    return compute(df.where(~is_heavy(keys, heavy)), plain).unionByName(hot_out)


def running_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, heavy: Sequence[int] | None = None) -> DataFrame:
    """row_number within the key, exact also for heavy keys."""
    if heavy is None:
        (heavy,) = heavy_hashes(df, keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if not heavy:
        return df.withColumn(name, number)
    cold = df.where(~is_heavy(keys, heavy)).withColumn(name, number)
    hot = cut_blocks(df.where(is_heavy(keys, heavy)), keys, order)
    before = carried(hot, keys, {"_before": F.lit(1)})
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order, "_spread"))
    ranked = null_safe_join(hot, before, [*keys, "_block"]).withColumn(name, inside + F.col("_before"))
    return cold.unionByName(ranked.drop("_block", "_spread", "_before"))
