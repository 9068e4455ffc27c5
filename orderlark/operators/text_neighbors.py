"""Exact nearest neighbours of sparse rows, visit by visit.

Tokens are numbered, and every row is packed into arrays of numbers and weights. Queries are
dealt into parts and base rows into blocks, both bounded in rows and in tokens; a visit brings
one part and one block into a task, adds up the products there through postings, and hands on
k rows a query. No pair of rows, and no pair of a query and a block, is ever written: a row is
copied once for each part or block of the other side, and these are few, as they are large.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from orderlark.operators.rank import top_per
from orderlark.operators.skew import attach
from orderlark.session import stored

BLOCK_ROWS = 20_000
#: Tokens of a block or a part, all its rows together: with their weights some 100 MB in a task.
BLOCK_TOKENS = 5_000_000
#: Where there are fewer visits than this, both sides are dealt into more pieces, of QUERY_ROWS and
#: BASE_ROWS or more.
LEAST_VISITS = 32
QUERY_ROWS = 250
BASE_ROWS = 2500
DIGITS = 9  # squared distances are rounded, so that equal rows tie and ids decide

FOUND = "q bigint, b bigint, dot double"


def numbered(weights: DataFrame) -> DataFrame:
    """(id, code, weight): tokens as numbers, so that rows are short and tasks hold no texts.
    Tokens that are numbers already keep them."""
    if isinstance(weights.schema["token"].dataType, LongType):
        return weights.select("id", F.col("token").alias("code"), "weight")
    codes = stored(weights.select("token").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    return stored(attach(weights, codes, ["token"], how="inner").select("id", "code", "weight"), "numbered")


def packed_rows(weights: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(name, codes, ws): one row per id that has tokens."""
    mine = weights.join(ids.select("id"), "id", "left_semi")
    rows = mine.groupBy(F.col("id").alias(name)).agg(F.collect_list(F.struct("code", "weight")).alias("l"))
    return rows.select(name, F.transform("l", lambda x: x["code"]).alias("codes"), F.transform("l", lambda x: x["weight"]).alias("ws"))


def scorer(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k largest products of each of some queries with the rows of a block."""

    def visit(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(bs):
            return pd.DataFrame({"q": [], "b": [], "dot": []})
        bs = bs.sort_values("b")
        ids, lengths = bs["b"].to_numpy(), bs["codes"].map(len).to_numpy()
        codes = np.concatenate(bs["codes"].to_numpy())
        order = np.argsort(codes, kind="stable")
        row = np.repeat(np.arange(len(bs)), lengths)[order]
        weight = np.concatenate(bs["ws"].to_numpy())[order]
        known, starts = np.unique(codes[order], return_index=True)
        ends = np.append(starts[1:], len(codes))
        out: list[tuple] = []
        for q, tokens, ws in zip(qs["q"].tolist(), qs["codes"], qs["ws"]):
            tokens = np.asarray(tokens)
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            met = known[at] == tokens
            at, own = at[met], np.asarray(ws)[met]
            if not len(at):
                continue
            spans = [slice(a, b) for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            products = np.concatenate([weight[s] for s in spans]) * np.repeat(own, ends[at] - starts[at])
            dots = np.bincount(np.concatenate([row[s] for s in spans]), products, len(ids))
            near = np.flatnonzero(dots > 0)
            # Order by rounded distance, then id; rows are sorted by id.
            d2 = np.round(np.maximum(2.0 - 2.0 * dots[near], 0.0), DIGITS)
            if len(near) > k:
                inside = d2 <= np.partition(d2, k - 1)[k - 1]
                near, d2 = near[inside], d2[inside]
            best = near[np.argsort(d2, kind="stable")[:k]]
            out.append((np.full(len(best), q), ids[best], dots[best]))
        if not out:
            return pd.DataFrame({"q": [], "b": [], "dot": []})
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("q", "b", "dot"), zip(*out))})

    return visit


def _pieces(rows: DataFrame, most_rows: int) -> tuple[int, int, int]:
    """Rows, their tokens, and pieces of at most about most_rows rows and BLOCK_TOKENS tokens."""
    n, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
    return n, tokens, max(1, math.ceil(n / most_rows), math.ceil(tokens / BLOCK_TOKENS))


def _cut(asked: tuple[int, int, int], rows: tuple[int, int, int]) -> tuple[int, int]:
    """Blocks and parts, raised until there are LEAST_VISITS: always by the piece that brings
    most visits for the tokens that it has copied once more."""
    (n, own, parts), (m, others, blocks) = asked, rows
    while blocks * parts < LEAST_VISITS:
        more_parts, more_blocks = parts < math.ceil(n / QUERY_ROWS), blocks < math.ceil(m / BASE_ROWS)
        if more_blocks and (not more_parts or parts * others >= blocks * own):
            blocks += 1
        elif more_parts:
            parts += 1
        else:
            break
    return blocks, parts


def _rounds(blocks: int, parts: int, least: int) -> list[tuple[int, int]]:
    """Ranges of parts that meet all blocks together: as few parts as give `least` visits."""
    step = max(1, math.ceil(least / blocks))
    return [(at, min(at + step, parts)) for at in range(0, parts, step)]


def block_max_pairs(weights: DataFrame, queries: DataFrame, base: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, b, dot): all pairs that can be among the k largest products of a query; at most k
    for each block of base rows.

    Rows are copied for their visits in rounds: the disk holds the copies of one round, about as
    much as the base rows take, and of the others only the pairs that were found."""
    weights = numbered(weights)
    asked = stored(packed_rows(weights, queries, "q"), "asked")
    rows = stored(packed_rows(weights, base, "b"), "rows")
    blocks, parts = _cut(_pieces(asked, BLOCK_ROWS), _pieces(rows, block_rows))
    of_part, of_block = F.pmod(F.xxhash64("q"), F.lit(parts)), F.pmod(F.xxhash64("b"), F.lit(blocks))

    def visits(side: DataFrame, mine: Column, others: tuple[int, int], step: int, n_visits: int) -> DataFrame:
        each = F.explode(F.transform(F.sequence(F.lit(others[0]), F.lit(others[1] - 1)), lambda o: mine + o * step))
        # As many tasks as visits, however small these are.
        return side.withColumn("visit", each).repartition(n_visits, "visit")

    found = None
    for first, last in _rounds(blocks, parts, max(LEAST_VISITS, weights.sparkSession.sparkContext.defaultParallelism)):
        n_visits = blocks * (last - first)
        now = asked.where((of_part >= first) & (of_part < last))
        left = visits(now, of_part, (0, blocks), parts, n_visits)
        right = visits(rows, of_block * parts, (first, last), 1, n_visits)
        pairs = stored(left.groupBy("visit").cogroup(right.groupBy("visit")).applyInPandas(scorer(k), FOUND), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def sparse_knn(weights: DataFrame, queries: DataFrame, base: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, neighbor_id, neighbor_label, distance, rank) of the k nearest base rows, for
    unit-length rows of an open vocabulary.

    `weights` has (id, token, weight) of all rows, `queries` (id) and `base` (id, label). Rows
    without tokens are zero vectors. Equal distances go to the smaller id. The result is exact.
    """
    pairs = block_max_pairs(weights, queries, base, k, block_rows)
    near = pairs.select("q", "b", F.round(F.greatest(2.0 - 2.0 * F.col("dot"), F.lit(0.0)), DIGITS).alias("d2"))

    # Rows that share no token: the k smallest ids with tokens and without, for every query.
    lengths = weights.select("id").distinct().withColumn("own", F.lit(1.0))
    sized = base.select("id").join(lengths, "id", "left").select("id", F.coalesce("own", F.lit(0.0)).alias("unit"))
    far = sized.where("unit = 1").orderBy("id").limit(k).unionByName(sized.where("unit = 0").orderBy("id").limit(k))
    packed = far.agg(F.collect_list(F.struct("id", "unit"))).scalar()
    others = queries.select("id").join(lengths, "id", "left").select(F.col("id").alias("q"), "own", F.explode(packed).alias("f"))
    others = others.select("q", F.col("f.id").alias("b"), (F.coalesce("own", F.lit(0.0)) + F.col("f.unit")).alias("d2"))
    best = near.unionByName(others).groupBy("q", "b").agg((-F.min("d2")).alias("_near"))
    ranked = top_per(best, "q", "_near", "b", k)
    out = ranked.join(base.select(F.col("id").alias("b"), F.col("label").alias("neighbor_label")), "b")
    return out.select(F.col("q").alias("query_id"), F.col("b").alias("neighbor_id"), "neighbor_label", F.sqrt(-F.col("_near")).alias("distance"), "rank")
