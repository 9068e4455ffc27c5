"""Exact nearest neighbours as a distributed join, and votes over them.

Base rows are grouped around a few pivot rows. From the distances of a query to the
pivots and the reach of each group follows an upper bound of its k-th distance; groups
that lie beyond that bound are never visited. Groups that lie side by side share a pack, large
groups are cut over several. A query travels once to each pack that holds a group it needs, and
meets there, inside a task, the groups within its bound. A pack returns only the k best rows
per query. No pair is ever emitted beyond those; packs and the parts of the queries are
bounded, and so is the memory of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.operators.rank import top_per
from orderlark.session import stored

MOST_PIVOTS = 256
BLOCK_ROWS = 1000
#: Rows of a pack, and of a part of the queries, in blocks.
PACK_BLOCKS = 20
#: Where there are fewer visits than this, queries are dealt into more parts of a block or more.
LEAST_VISITS = 32
#: Distances that a task holds at once.
MOST_DISTANCES = 2_000_000
DIGITS = 9  # squared distances are rounded, so that equal vectors tie and ids decide


def _matrix(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    """Rows (dense `val`, or sparse `idx` and `val`) as a dense block."""
    if "idx" not in pdf.columns:
        return np.stack(pdf["val"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, dim))
    out = np.zeros((len(pdf), dim))
    for i, (idx, val) in enumerate(zip(pdf["idx"], pdf["val"])):
        out[i, np.asarray(idx, int)] = val
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d2, 0.0)


def _pick_pivots(base: DataFrame, dim: int, pivots: int, vector: Sequence[str]) -> np.ndarray:
    """The rows with the smallest id hashes: a fixed, bounded sample."""
    rows = base.orderBy(F.xxhash64("id"), "id").select(*vector).limit(pivots).collect()
    return _matrix(pd.DataFrame([r.asDict() for r in rows], columns=list(vector)), dim)


def _packs(sizes: Sequence[int], order: Sequence[int], pack_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First pack and number of packs of every cell, and the number of all packs. Cells share
    a pack with the next ones in order; one larger than a pack has packs of its own."""
    first, pieces, packs, held = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, pack_rows
    for c in order:
        if held + sizes[c] > pack_rows:
            pieces[c] = math.ceil(sizes[c] / pack_rows)
            first[c], packs, held = packs, packs + pieces[c], 0 if pieces[c] == 1 else pack_rows
        else:
            first[c] = packs - 1
        held += sizes[c]
    return first, pieces, int(packs)


def _best(query: np.ndarray, d2: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest of every query; equal distances go to the earlier row."""
    order = np.lexsort((row, d2, query))
    query, d2, row = query[order], d2[order], row[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], d2[kept], row[kept]


def knn_join(
    queries: DataFrame, base: DataFrame, k: int, dim: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, neighbor_id, neighbor_label, distance, rank) of the k nearest base rows.

    `queries` has (id, val) and `base` (id, val, label), ids being whole numbers; a further column
    `idx` makes the vectors sparse, with positions below `dim`. Euclidean
    distance; equal distances go to the smaller id. On unit vectors the order is that of the cosine.
    By default there is a pivot per block of base rows, up to MOST_PIVOTS.
    """
    # Vectors, their cells and the routed queries are each read several times below, and
    # the cells must not move in between: they are written once.
    vector = [c for c in ("idx", "val") if c in base.columns]
    vector_type = ", ".join(f"{c} array<{'int' if c == 'idx' else 'double'}>" for c in vector)
    base = stored(base.select("id", "label", *vector), "base")
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(1, base.count() // block_rows))
    centers = _pick_pivots(base, dim, pivots, vector)

    def nearest_center(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = np.sqrt(_squared(_matrix(pdf, dim), centers))
                pdf = pdf.assign(cell=d.argmin(1).astype("int32"), reach=d.min(1))
                yield pdf

    cell_type = f"id bigint, label string, {vector_type}, cell int, reach double"
    placed = stored(base.mapInPandas(nearest_center, cell_type), "cells")
    # At most k rows per cell, so pivots * k numbers come to the driver.
    by_reach = Window.partitionBy("cell").orderBy("reach", "id")
    closest = placed.select("cell", "reach", "id").withColumn("_r", F.row_number().over(by_reach)).where(F.col("_r") <= k)
    near_rows = closest.select("cell", "reach").collect()
    sizes = {
        r["cell"]: (r["n"], r["radius"])
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()
    }
    cells = np.array(sorted(sizes), dtype=np.int32)
    radius = np.array([sizes[c][1] for c in cells])
    near_cell = np.array([np.searchsorted(cells, r["cell"]) for r in near_rows], dtype=int)
    near_reach = np.array([r["reach"] for r in near_rows])
    pack_rows = block_rows * PACK_BLOCKS
    aside = _squared(centers[cells], centers[cells[:1]]).sum(axis=1)
    first, pieces, packs = _packs([sizes[c][0] for c in cells], np.argsort(aside, kind="stable"), pack_rows)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf) if len(cells) else 0, 1000):
                some = pdf.iloc[at : at + 1000]
                d = np.sqrt(_squared(_matrix(some, dim), centers[cells]))
                # k base rows are known to lie within these distances of the query.
                last = min(k, len(near_reach)) - 1
                bound = np.partition(d[:, near_cell] + near_reach, last, axis=1)[:, last]
                needed = np.zeros((len(some), packs), bool)
                for c in range(len(cells)):
                    needed[:, first[c] : first[c] + pieces[c]] |= (d[:, c] - radius[c] <= bound + 1e-6)[:, None]
                yield some.assign(bound=bound, packs=[np.flatnonzero(n).astype(np.int32) for n in needed])

    routed = queries.select("id", *vector).mapInPandas(route, f"id bigint, {vector_type}, bound double, packs array<int>")
    routed = stored(routed, "routed")
    n_queries = routed.count()
    parts = max(1, math.ceil(n_queries / pack_rows), min(math.ceil(n_queries / block_rows), math.ceil(LEAST_VISITS / max(packs, 1))))

    def of_cell(values: np.ndarray) -> Column:
        return F.create_map(*[F.lit(int(x)) for pair in zip(cells, values) for x in pair])[F.col("cell")]

    left = routed.withColumn("pack", F.explode("packs")).drop("packs").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    pack = of_cell(first) + F.pmod(F.xxhash64("id"), of_cell(pieces)) if len(cells) else F.lit(0)
    right = placed.drop("reach").withColumn("pack", pack.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(bs):
            return pd.DataFrame()
        # Rows in order of id, so that the earlier of two is the one with the smaller id.
        bs = bs.sort_values("id")
        x, y, bound = _matrix(qs, dim), _matrix(bs, dim), qs["bound"].to_numpy()
        found, n = [], 0
        for cell, rows in bs.reset_index(drop=True).groupby("cell").groups.items():
            rows = rows.to_numpy()
            d = np.sqrt(_squared(x, centers[[cell]]))[:, 0]
            asking = np.flatnonzero(d - sizes[cell][1] <= bound + 1e-6)
            step = max(1, MOST_DISTANCES // len(rows))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                d2 = np.round(_squared(x[some], y[rows]), DIGITS)
                last = min(k, len(rows)) - 1
                q, r = np.nonzero(d2 <= np.partition(d2, last, axis=1)[:, [last]])
                found.append(_best(some[q], d2[q, r], rows[r], k))
                n += len(found[-1][0])
                if n > MOST_DISTANCES:
                    found = [_best(*(np.concatenate(c) for c in zip(*found)), k)]
                    n = 0
        if not found:
            return pd.DataFrame()
        q, d2, r = _best(*(np.concatenate(c) for c in zip(*found)), k)
        return pd.DataFrame({"query_id": qs["id"].to_numpy()[q], "neighbor_id": bs["id"].to_numpy()[r], "neighbor_label": bs["label"].to_numpy()[r], "d2": d2})

    keys, visits = ["pack", "part"], max(packs, 1) * parts
    left, right = left.repartition(visits, *keys), right.repartition(visits, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best, "query_id bigint, neighbor_id bigint, neighbor_label string, d2 double"
    )
    ranked = top_per(found.withColumn("_near", -F.col("d2")), "query_id", "_near", "neighbor_id", k)
    return ranked.select("query_id", "neighbor_id", "neighbor_label", F.sqrt("d2").alias("distance"), "rank")


def knn_vote(neighbors: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """(query_id, prediction): majority of the k nearest, or votes weighted by 1/distance,
    where neighbours at distance 0 outvote all others. Ties go to the smallest label."""
    near = neighbors.where(F.col("rank") <= k)
    if weights == "uniform":
        votes = near.groupBy("query_id", "neighbor_label").agg(F.count(F.lit(1)).cast("double").alias("_v"))
        strength = F.struct(-F.col("_v"), F.col("neighbor_label"))
    else:
        zero = F.col("distance") == 0
        votes = near.groupBy("query_id", "neighbor_label").agg(
            F.sum(zero.cast("int")).alias("_same"),
            F.round(F.sum(F.when(~zero, 1 / F.col("distance"))), 9).alias("_v"),
        )
        strength = F.struct(-F.col("_same"), -F.coalesce(F.col("_v"), F.lit(0.0)), F.col("neighbor_label"))
    return votes.groupBy("query_id").agg(F.min_by("neighbor_label", strength).alias("prediction"))


def knn_grid(
    rows: DataFrame, dim: int, fold: Column, folds: int, ks: Sequence[int], weights: Sequence[str]
) -> DataFrame:
    """Accuracy per (k, weights) by cross validation. The neighbours of each fold are
    found once, for the greatest k; smaller k read a part of them."""
    folded = rows.withColumn("_fold", fold)
    near = None
    for f in range(folds):
        held, rest = folded.where(F.col("_fold") == f), folded.where(F.col("_fold") != f)
        found = knn_join(held, rest, max(ks), dim).withColumn("_fold", F.lit(f))
        near = found if near is None else near.unionByName(found)
    truth = folded.select(F.col("id").alias("query_id"), "label", "_fold")
    out = None
    for k in ks:
        for w in weights:
            votes = knn_vote(near, k, w).join(truth, "query_id")
            per_fold = votes.groupBy("_fold").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
            one = per_fold.agg(F.avg("a").alias("accuracy")).select(F.lit(k).alias("k"), F.lit(w).alias("weights"), "accuracy")
            out = one if out is None else out.unionByName(one)
    return out
