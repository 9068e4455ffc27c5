"""Linear ranker learned from pairs within groups, weighted by what a swap costs in NDCG.

Each round ranks every group by the current scores. A pair of a relevant and another row
pulls their scores apart with a force that falls with their distance (logistic) and grows
with the change of NDCG if the two swapped ranks. Groups are packed once into blocks of many
rows; the pairs of groups of like shape are worked on together, and none is emitted. Tasks
hand on their sums, and the driver takes a Newton step on the handful of weights. The best
round by validation groups is kept.

A group larger than GROUP_ROWS is dealt by hash into even parts that are ranked each for
itself, a rank inside standing for as many ranks of the whole as there are parts. All rows
take part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlark.operators.skew import null_safe_join
from orderlark.session import stored

GROUP_ROWS = 2000
ROUNDS = 100
PATIENCE = 10
RIDGE = 1e-3
BLOCK_ROWS = 50_000
#: Pairs, with those that pad, that are held at a time; a larger group is taken alone.
PAIRS = 50_000


@dataclass(frozen=True)
class LambdaRanker:
    features: list[str]
    weights: np.ndarray
    means: np.ndarray
    ndcg: list[float]  # of the validation groups, by round

    def score(self, df: DataFrame, output: str = "score") -> DataFrame:
        parts = [(F.coalesce(F.col(c).cast("double"), F.lit(float(m))) - float(m)) * float(w) for c, m, w in zip(self.features, self.means, self.weights, strict=True)]
        return df.withColumn(output, F.round(sum(parts, F.lit(0.0)), 9))


def block_terms(x: np.ndarray, good: np.ndarray, scores: np.ndarray, sizes: np.ndarray, stretch: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and curvature of the pair loss, added up over the taught groups, and the NDCG of
    every group (nan where all rows are of one kind). Rows lie group after group; groups of like
    shape are padded to one and worked on together."""
    p, n = x.shape[1], len(sizes)
    group, starts = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
    place = np.arange(len(scores)) - np.repeat(starts, sizes)
    rank = np.empty(len(scores))
    rank[np.lexsort((-scores, group))] = place
    discount = 1 / np.log2(rank * stretch[group] + 2)
    n_good = np.bincount(group[good], minlength=n)
    n_bad = sizes - n_good
    some = (n_good > 0) & (n_bad > 0)
    # Good rows first: as many places from the top as a group has good rows.
    top = place < n_good[group]
    ideal = np.bincount(group[top], 1 / np.log2(place[top] * stretch[group[top]] + 2), n)
    ndcg = np.where(some, np.bincount(group[good], discount[good], n) / np.where(some, ideal, 1.0), np.nan)
    sorted_rows = np.lexsort((~good, group))
    gradient, curvature = np.zeros(p), np.zeros((p, p))
    wanted = np.flatnonzero(some & taught)
    wanted = wanted[np.lexsort((n_bad[wanted], n_good[wanted]))]

    def side(chosen: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.arange(count[chosen].max())
        here = at < count[chosen][:, None]
        rows = sorted_rows[np.where(here, first[chosen][:, None] + at, first[chosen][:, None])]
        return x[rows], scores[rows], discount[rows], here

    done = 0
    while done < len(wanted):
        shape = np.maximum.accumulate(n_good[wanted[done:]]) * np.maximum.accumulate(n_bad[wanted[done:]])
        over = np.flatnonzero(shape * np.arange(1, len(shape) + 1) > PAIRS)
        upto = done + max(1, over[0] if len(over) else len(shape))
        chosen, done = wanted[done:upto], upto
        a, a_score, a_discount, a_here = side(chosen, starts, n_good)
        b, b_score, b_discount, b_here = side(chosen, starts + n_good, n_bad)
        cost = np.abs(a_discount[:, :, None] - b_discount[:, None, :]) / ideal[chosen][:, None, None]
        cost *= a_here[:, :, None]
        cost *= b_here[:, None, :]
        miss = 1 / (1 + np.exp(np.clip(a_score[:, :, None] - b_score[:, None, :], -50, 50)))
        force = cost * miss
        bend = force * (1 - miss)
        rows_a, rows_b = a.reshape(-1, p), b.reshape(-1, p)
        gradient += rows_a.T @ force.sum(axis=2).ravel() - rows_b.T @ force.sum(axis=1).ravel()
        middle = rows_a.T @ (bend @ b).reshape(-1, p)
        curvature += (rows_a.T * bend.sum(axis=2).ravel()) @ rows_a + (rows_b.T * bend.sum(axis=1).ravel()) @ rows_b - middle - middle.T
    return gradient, curvature, ndcg


def group_terms(x: np.ndarray, relevant: np.ndarray, scores: np.ndarray, stretch: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient and curvature of the pair loss of one group, and its NDCG."""
    gradient, curvature, ndcg = block_terms(x, relevant > 0, scores, np.array([len(x)]), np.array([stretch]), np.array([True]))
    return gradient, curvature, float(ndcg[0])


BLOCK = "sizes binary, parts binary, held binary, y binary, x binary"


def _blocks(rows: DataFrame) -> DataFrame:
    """Groups packed into blocks. Rows come group after group, the first of each marked by at = 1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(at, parts, held, y, x) -> pa.RecordBatch:
            first = np.flatnonzero(at == 1)
            packed = (np.diff(np.append(first, len(at))), parts[first].astype(np.int64), held[first].astype(bool), y.astype(bool), x.astype(np.float64))
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in packed], names=["sizes", "parts", "held", "y", "x"])

        kept, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, parts, held, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "parts", "held", "y"))
            columns = (at, parts, held, y, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
            first = np.flatnonzero(at == 1)
            # The batch's last group may go on in the next one.
            if n + len(at) >= BLOCK_ROWS and len(first) and n + first[-1]:
                kept.append(tuple(c[: first[-1]] for c in columns))
                yield block(*(np.concatenate(c) for c in zip(*kept)))
                kept, n, columns = [], 0, tuple(c[first[-1] :] for c in columns)
            kept.append(columns)
            n += len(columns[0])
        if n:
            yield block(*(np.concatenate(c) for c in zip(*kept)))

    return rows.mapInArrow(pack, BLOCK)


def _parts(df: DataFrame, group: str, key: str, group_rows: int) -> DataFrame:
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("parts"))
    return null_safe_join(df, sizes, [group]).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))


def fit_lambda_rank(
    df: DataFrame,
    group: str,
    features: Sequence[str],
    label: str,
    key: str,
    rounds: int = ROUNDS,
    patience: int = PATIENCE,
    group_rows: int = GROUP_ROWS,
) -> LambdaRanker:
    """`key` tells rows of a group apart. A fifth of the groups, by hash, validate the rounds.
    Null features count as their mean; a group with one kind of label teaches nothing."""
    p = len(features)
    slim = df.select(F.col(group).alias("group"), F.col(key).cast("string").alias("key"), (F.col(label) > 0).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    slim = stored(_parts(slim.where("y IS NOT NULL"), "group", "key", group_rows), "ranked")
    facts = slim.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"x{i}").alias(f"d{i}") for i in range(p)]).first()
    means, scales = (np.array([facts[f"{c}{i}"] or 0.0 for i in range(p)]) for c in "md")
    scales = np.where(scales > 1e-12, scales, np.inf)
    x = F.array(*[((F.coalesce(F.col(f"x{i}"), F.lit(float(means[i]))) - float(means[i])) / float(scales[i])) for i in range(p)])
    held = (F.pmod(F.xxhash64("group"), F.lit(5)) == 0).alias("held")
    # The window only numbers the rows: a group's rows lie together and in order behind it.
    number = F.row_number().over(Window.partitionBy("group", "part").orderBy("key", "y", "x")).alias("at")
    groups = stored(_blocks(slim.select("group", "part", "parts", "key", "y", x.alias("x")).select(number, "parts", held, "y", "x")), "groups")

    def sums(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, curvature, gain, n = np.zeros(p), np.zeros((p, p)), 0.0, 0
            for batch in batches:
                for i in range(batch.num_rows):
                    sizes, parts, held, y, values = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(batch.schema.names, (np.int64, np.int64, bool, bool, np.float64)))
                    values = values.reshape(-1, p)
                    # Column by column: equal rows get equal scores wherever in a block they lie.
                    scores = sum(values[:, j] * weights[j] for j in range(p))
                    g, h, ndcg = block_terms(values, y, scores, sizes, parts, ~held)
                    judged = ndcg[held & ~np.isnan(ndcg)]
                    gain, n = gain + judged.sum(), n + len(judged)
                    gradient, curvature = gradient + g, curvature + h
            yield pa.RecordBatch.from_arrays([pa.array([[gain, float(n), *gradient.tolist(), *curvature.ravel().tolist()]], pa.list_(pa.float64()))], names=["sums"])

        found = groups.mapInArrow(run, "sums array<double>").collect()
        total = np.sum([r["sums"] for r in found], axis=0) if found else np.zeros(2 + p + p * p)
        return total[0] / max(total[1], 1.0), total[2 : 2 + p], total[2 + p :].reshape(p, p)

    weights, best, history = np.zeros(p), np.zeros(p), []
    for _ in range(rounds):
        ndcg, gradient, curvature = sums(weights)
        history.append(float(ndcg))
        if ndcg >= max(history):
            best = weights
        if len(history) - 1 - int(np.argmax(history)) >= patience:
            break
        scale = max(float(np.trace(curvature)) / p, 1e-12)
        step = np.linalg.solve(curvature + RIDGE * scale * np.eye(p), gradient - RIDGE * scale * weights)
        size = np.abs(step).max()
        weights = weights + step * min(1.0, 1.0 / size if size else 1.0)
        if size < 1e-6:
            break
    return LambdaRanker(list(features), best / scales, means, history)
