"""Boosted trees over binned features: quantile, squared and logistic loss, with early stopping.

Features are cut once into at most BINS bins, a row keeps one byte for each. Rows are packed
into blocks of a few thousand, one array per column, so that a pass opens arrays and no single
rows. A level of a tree takes one pass: every task adds its rows up per (node, feature, bin),
tasks hand on these sums only, and the driver picks the splits from a table whose size depends
on depth, features and bins, not on rows. Quantile leaves take a further pass, in which a task
hands on evenly spaced ranks of the residuals of each leaf. Several losses (two quantiles, say)
share every pass.

Gradients are added as whole numbers, so neither the order of tasks nor a task that runs
again changes a tree. Predictions so far are written out every KEEP rounds; between that,
tasks apply the few newest trees themselves, so no plan grows with the rounds.

Null and non-finite features count as 0. Rows with a null target are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlark.session import stored

BINS = 64
KEEP = 25
#: Steps per unit of a gradient or a loss; units are those of the loss (`units`: of its gradient,
#: of itself), so that sums fit a long at any scale of the target.
STEPS = float(1 << 24)
SKETCH = 10_000
#: A task sorts the residuals of so many rows at a time, and hands on at most so many of each leaf.
SORTED_ROWS = 1_000_000
POINTS = 5_000


@dataclass(frozen=True)
class Pinball:
    """Quantile loss; leaves hold the quantile of their residuals."""

    q: float

    def gradient(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        return self.q - (y < f)

    def curvature(self, f: np.ndarray) -> np.ndarray:
        return np.ones(len(f))

    def loss(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.maximum(self.q * (y - f), (self.q - 1) * (y - f))

    def units(self, spread: float) -> tuple[float, float]:
        return 1.0, spread

    def link(self, f: np.ndarray) -> np.ndarray:
        return f


@dataclass(frozen=True)
class Squared:
    def gradient(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        return y - f

    def curvature(self, f: np.ndarray) -> np.ndarray:
        return np.ones(len(f))

    def loss(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        return (y - f) ** 2

    def units(self, spread: float) -> tuple[float, float]:
        return spread, spread**2

    def link(self, f: np.ndarray) -> np.ndarray:
        return f


@dataclass(frozen=True)
class Logistic:
    """Targets are 0 and 1, scores log odds; `link` gives the probability."""

    def gradient(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        return y - self.link(f)

    def curvature(self, f: np.ndarray) -> np.ndarray:
        p = self.link(f)
        return np.maximum(p * (1 - p), 1e-6)

    def loss(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.logaddexp(0.0, f) - y * f

    def units(self, spread: float) -> tuple[float, float]:
        return 1.0, 1.0

    def link(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(f, -50, 50)))


Loss = Pinball | Squared | Logistic


@dataclass(frozen=True)
class Growth:
    """Sizes of a fit. With validation rows, an output stops after `patience` rounds without
    gain and keeps its best prefix."""

    rounds: int = 100
    depth: int = 3
    leaves: int = 31
    rate: float = 0.1
    min_rows: int = 1
    row_share: float = 1.0
    feature_share: float = 1.0
    #: Rounds that share one draw of rows.
    redraw: int = 5
    patience: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Node i has the children 2i + 1 and 2i + 2; leaves have feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @staticmethod
    def root(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))


def leaf_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Node that each row ends in; rows at or below the cut go left."""

    def below(node: int) -> np.ndarray:
        if feature[node] < 0:
            return np.int32(node)
        return np.where(x[:, feature[node]] > cut[node], below(2 * node + 2), below(2 * node + 1))

    return np.broadcast_to(below(0), len(x))


@dataclass
class Output:
    """One fitted loss: start value, trees, and what validation said after each round."""

    name: str
    loss: Loss
    start: float
    trees: list[Tree] = field(default_factory=list)
    validation: list[float] = field(default_factory=list)
    gains: np.ndarray | None = None
    growing: bool = True

    def best(self) -> int:
        """Rounds of the best prefix; the first of equals."""
        return int(np.argmin(self.validation)) if self.validation else len(self.trees)


@dataclass
class BoostedTrees:
    features: list[str]
    outputs: list[Output]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds one column per output, without a shuffle."""
        outputs = self.outputs

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy()).astype(np.float64)
            found = []
            for out in outputs:
                f = np.full(len(rows), out.start)
                for tree in out.trees:
                    f += tree.value[leaf_of(rows, tree.feature, tree.threshold)]
                found.append(out.loss.link(f))
            return pd.Series(list(np.stack(found, axis=1)))

        out = df.withColumn("_scores", scores(_inputs(self.features)))
        return out.withColumns({o.name: F.col("_scores")[i] for i, o in enumerate(outputs)}).drop("_scores")

    def importance(self, output: str) -> dict[str, float]:
        """Share of each feature in the gain of all splits, greatest first."""
        gains = next(o.gains for o in self.outputs if o.name == output)
        total = gains.sum() or 1.0
        return dict(sorted(zip(self.features, (gains / total).tolist()), key=lambda p: (-p[1], p[0])))


def _inputs(features: Sequence[str]):
    clean = []
    for c in features:
        x = F.col(c).cast("double")
        clean.append(F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))
    return F.array(*clean)


def _edges(rows: DataFrame, p: int) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature, from one pass of sketches."""
    ranks = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], ranks, SKETCH).alias(f"e{i}") for i in range(p)]).first()
    return [np.unique(found[f"e{i}"] or []) for i in range(p)]


BLOCK = "row binary, y binary, val binary, codes binary, f binary"


def _block(row: np.ndarray, y: np.ndarray, val: np.ndarray, codes: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    """Some rows as one: packed numbers, bins and predictions column after column."""
    packed = (row.astype(np.int64), y.astype(np.float64), val.astype(bool), codes.T.astype(np.uint8), f.T.astype(np.float64))
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in packed], names=["row", "y", "val", "codes", "f"])


def _binned(rows: DataFrame, edges: list[np.ndarray], starts: list[float]) -> DataFrame:
    """One byte per feature, and the predictions so far, in blocks of the rows of a batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                codes = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
                row, y, val = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "y", "val"))
                yield _block(row, y, val, codes, np.tile(starts, (len(y), 1)))

    return rows.mapInArrow(cut, BLOCK)


def _opened(batches: Iterator[pa.RecordBatch], outputs: list[Output], since: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row numbers, targets, whether for validation, bins, and predictions with the trees that
    the stored ones lack, of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row, y, val, codes, f = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("row", np.int64), ("y", np.float64), ("val", bool), ("codes", np.uint8), ("f", np.float64)))
            codes, f = codes.reshape(-1, len(y)).T, f.reshape(-1, len(y)).T.copy(order="F")
            for o, out in enumerate(outputs):
                for tree in out.trees[since:]:
                    f[:, o] += tree.value[leaf_of(codes, tree.feature, tree.bin)]
            yield row, y, val, codes, f


def _drawn(row: np.ndarray, draw: int, share: float) -> np.ndarray:
    """Whether a row takes part in a draw: a hash of its number, the same in every run."""
    with np.errstate(over="ignore"):
        mixed = (row.astype(np.uint64) + np.uint64(draw + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(40)).astype(np.float64) < share * float(1 << 24)


def _used(row: np.ndarray, y: np.ndarray, held: np.ndarray, codes: np.ndarray, f: np.ndarray, draw: int, growth: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets, bins and predictions of the rows that a tree is grown on."""
    used = ~held if growth.row_share >= 1 else ~held & _drawn(row, draw, growth.row_share)
    return (y, codes, f) if used.all() else (y[used], codes[used], f[used])


def _long_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["out", "cell", "n", "g", "h"])


def _sums(state: DataFrame, outputs: list[Output], trees: dict[int, Tree], slots: dict[int, np.ndarray], since: int, draw: int, growth: Growth, spread: float, first: bool):
    """Counts, gradients and curvatures per (output, slot, feature, bin); on the first level
    also the loss of the validation rows, as cell -1."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        losses = np.zeros((len(outputs), 2), np.int64)
        for row, y, held, codes, f in _opened(batches, outputs, since):
            if first and held.any():
                for i, out in enumerate(outputs):
                    if out.growing:
                        loss_unit = out.loss.units(spread)[1]
                        losses[i] += [held.sum(), np.rint(out.loss.loss(y[held], f[held, i]) / loss_unit * STEPS).astype(np.int64).sum()]
            y, codes, f = _used(row, y, held, codes, f, draw, growth)
            for i, tree in trees.items():
                loss, unit = outputs[i].loss, outputs[i].loss.units(spread)[0]
                slot = slots[i][leaf_of(codes, tree.feature, tree.bin)]
                live = slot >= 0
                own, mine, target, at = (codes, slot, y, f[:, i]) if live.all() else (codes[live], slot[live], y[live], f[live, i])
                g = np.rint(loss.gradient(target, at) / unit * STEPS)
                h = np.rint(loss.curvature(at) * STEPS)
                even = len(h) > 0 and (h == h[0]).all()
                size = int(slots[i].max()) + 1
                table = tables.setdefault(i, np.zeros((3, size, codes.shape[1], BINS), np.int64))
                for j in range(codes.shape[1]):
                    cell = mine * BINS + own[:, j]
                    n = np.bincount(cell, minlength=size * BINS)
                    sums = (n, np.bincount(cell, g, size * BINS), n * int(h[0]) if even else np.bincount(cell, h, size * BINS))
                    for k, v in enumerate(sums):
                        table[k, :, j] += v.astype(np.int64).reshape(size, BINS)
        for i, table in tables.items():
            table = table.reshape(3, -1)
            cell = np.flatnonzero(table[0])
            yield _long_batch(np.full(len(cell), i), cell, *table[:, cell])
        if losses[:, 0].any():
            o = np.arange(len(outputs))
            yield _long_batch(o, np.full(len(o), -1), losses[:, 0], losses[:, 1], 0 * o)

    found = state.mapInArrow(add, "out long, cell long, n long, g long, h long")
    return found.groupBy("out", "cell").agg(*[F.sum(c).alias(c) for c in "ngh"]).toArrow().to_pandas()


def _best_splits(table: np.ndarray, allowed: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and bin of the best split of every slot, with the sums of both sides.
    table: (slots, features, bins, 3)."""
    left = np.cumsum(table, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    n, g, h = (np.stack([left[..., k], right[..., k]]) for k in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(h > 0, g * g / h, 0.0)
        whole = np.where(total[..., 2] > 0, total[..., 1] ** 2 / total[..., 2], 0.0)
    gain = np.where((n >= min_rows).all(axis=0) & allowed[None, :, None], parts.sum(axis=0) - whole, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    s = np.arange(len(best))
    feature, cut = np.divmod(best, gain.shape[2])
    return flat[s, best], feature, cut, left[s, feature, cut], right[s, feature, cut]


def _leaf_quantiles(state: DataFrame, outputs: list[Output], trees: dict[int, Tree], since: int, draw: int, growth: Growth) -> None:
    """Set the leaves of quantile trees. Of n sorted residuals, a task hands on the middle ones
    of at most POINTS runs of like length, so a rank is off by 1/(2 POINTS) of the rows at most;
    a leaf of up to POINTS rows is exact."""
    wanted = {i: outputs[i].loss.q for i in trees if isinstance(outputs[i].loss, Pinball)}
    if not wanted:
        return

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def points() -> Iterator[pa.RecordBatch]:
            for i in wanted:
                leaf, left = (np.concatenate([b[i][c] for b in kept]) for c in (0, 1))
                for node in np.unique(leaf):
                    own = np.sort(left[leaf == node])
                    ends = np.unique(np.linspace(0, len(own), min(len(own), POINTS) + 1).astype(np.int64))
                    middle = own[(ends[:-1] + ends[1:] - 1) // 2]
                    columns = (np.full(len(middle), i), np.full(len(middle), node), middle, np.diff(ends))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["out", "leaf", "left", "n"])

        for row, y, held, codes, f in _opened(batches, outputs, since):
            y, codes, f = _used(row, y, held, codes, f, draw, growth)
            kept.append({i: (leaf_of(codes, trees[i].feature, trees[i].bin), y - f[:, i]) for i in wanted})
            n += len(y)
            if n >= SORTED_ROWS:
                yield from points()
                kept, n = [], 0
        if n:
            yield from points()

    def quantile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("left")
        upto = np.cumsum(pdf["n"].to_numpy())
        at = np.searchsorted(upto, wanted[key[0]] * upto[-1], side="left")
        return pd.DataFrame({"out": [key[0]], "leaf": [key[1]], "v": [pdf["left"].iat[min(at, len(pdf) - 1)]]})

    placed = state.mapInArrow(place, "out int, leaf int, left double, n long")
    for r in placed.groupBy("out", "leaf").applyInPandas(quantile, "out int, leaf int, v double").collect():
        trees[r["out"]].value[r["leaf"]] = growth.rate * r["v"]


def _grown(state: DataFrame, outputs: list[Output], edges: list[np.ndarray], since: int, number: int, growth: Growth, spread: float) -> bool:
    """Grow one tree for every output that still grows; False once all have stopped."""
    p, draw = len(edges), number // growth.redraw
    allowed = np.zeros(p, bool)
    take = max(1, round(p * growth.feature_share))
    allowed[np.random.default_rng([growth.seed, number]).permutation(p)[:take]] = True
    trees = {i: Tree.root(growth.depth) for i, o in enumerate(outputs) if o.growing}
    frontier = {i: [0] for i in trees}
    n_leaves = dict.fromkeys(trees, 1)
    for level in range(growth.depth):
        slots = {}
        for i, nodes in frontier.items():
            slots[i] = np.full(len(trees[i].feature), -1)
            slots[i][nodes] = range(len(nodes))
        found = _sums(state, outputs, {i: trees[i] for i in frontier}, slots, since, draw, growth, spread, level == 0)
        if level == 0:
            for r in found[found["cell"] == -1].itertuples():
                out = outputs[r.out]
                if out.growing and r.n:
                    out.validation.append(r.g / r.n / STEPS)
                    out.growing = len(out.validation) - 1 - out.best() < growth.patience
            for i in [i for i in trees if not outputs[i].growing]:
                del trees[i], frontier[i]
            if not trees:
                return False
        for i, nodes in list(frontier.items()):
            tree, rows = trees[i], found[(found["out"] == i) & (found["cell"] >= 0)]
            table = np.zeros((len(nodes) * p * BINS, 3))
            table[rows["cell"].to_numpy()] = rows[["n", "g", "h"]].to_numpy(np.float64) / [1, STEPS, STEPS]
            gain, feature, cut, left, right = _best_splits(table.reshape(len(nodes), p, BINS, 3), allowed, growth.min_rows)
            nxt = []
            # The greatest gains first, while leaves are left.
            for s in sorted(range(len(nodes)), key=lambda s: (-gain[s], s)):
                if gain[s] > 1e-9 and n_leaves[i] < growth.leaves:
                    node = nodes[s]
                    tree.feature[node], tree.bin[node], tree.threshold[node] = feature[s], cut[s], edges[feature[s]][cut[s]]
                    outputs[i].gains[feature[s]] += gain[s]
                    n_leaves[i] += 1
                    for child, sums in ((2 * node + 1, left[s]), (2 * node + 2, right[s])):
                        tree.value[child] = growth.rate * outputs[i].loss.units(spread)[0] * sums[1] / max(sums[2], 1e-9)
                        nxt.append(child)
            if nxt:
                frontier[i] = sorted(nxt)
            else:
                del frontier[i]
        if not frontier:
            break
    _leaf_quantiles(state, outputs, trees, since, draw, growth)
    for i, tree in trees.items():
        outputs[i].trees.append(tree)
        # Without validation rows, an output whose tree could not split has nothing to gain.
        if tree.feature[0] < 0 and growth.row_share == 1 and growth.feature_share == 1:
            outputs[i].growing = False
    return True


def _advanced(state: DataFrame, outputs: list[Output], since: int) -> DataFrame:
    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for opened in _opened(batches, outputs, since):
            yield _block(*opened)

    return stored(state.mapInArrow(advance, BLOCK), "boosting")


def fit_boosted(
    df: DataFrame, features: Sequence[str], target: str, losses: Mapping[str, Loss], growth: Growth = Growth(), validation: str | None = None
) -> BoostedTrees:
    """Fit one series of trees per loss (output column -> loss). `validation` names a boolean
    column; its rows take no part in trees, bins or starts, and stop each series. An empty
    table gives a model without trees that scores 0 (or even odds)."""
    val = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    y = F.col(target).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(F.monotonically_increasing_id().alias("row"), y.alias("y"), val.alias("val"), _inputs(features).alias("x"))
    # Row numbers are written out, so a task that runs again draws the same rows.
    rows = stored(rows, "boosting")
    train, p = rows.where("NOT val"), len(features)
    qs = [l.q for l in losses.values() if isinstance(l, Pinball)] or [0.5]
    facts = train.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("spread"), F.percentile_approx("y", qs, SKETCH).alias("q")).first()
    if not facts["n"]:
        return BoostedTrees(list(features), [Output(name, loss, 0.0, gains=np.zeros(p)) for name, loss in losses.items()])
    outputs = []
    for name, loss in losses.items():
        start = facts["mean"]
        if isinstance(loss, Pinball):
            start = facts["q"][qs.index(loss.q)]
        elif isinstance(loss, Logistic):
            share = min(max(facts["mean"], 1e-6), 1 - 1e-6)
            start = math.log(share / (1 - share))
        outputs.append(Output(name, loss, float(start), gains=np.zeros(p)))
    spread = facts["spread"] or 1.0
    edges = _edges(train, p)
    # Every pass reads the blocks again: they are dealt out evenly, over all cores at least.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(facts["n"] / SORTED_ROWS))
    state, since = stored(_binned(rows.repartition(tasks, "row"), edges, [o.start for o in outputs]), "boosting"), 0
    for number in range(growth.rounds):
        if number - since >= KEEP:
            state, since = _advanced(state, outputs, since), number
        if not _grown(state, outputs, edges, since, number, growth, spread):
            break
    if validation:
        # The last trees have not been seen by the validation rows yet.
        _last_validation(state, outputs, since, growth, spread)
        for out in outputs:
            out.trees = out.trees[: out.best()]
    return BoostedTrees(list(features), outputs)


def _last_validation(state: DataFrame, outputs: list[Output], since: int, growth: Growth, spread: float) -> None:
    found = _sums(state, outputs, {}, {}, since, 0, growth, spread, True)
    for r in found.itertuples():
        if outputs[r.out].growing and r.n:
            outputs[r.out].validation.append(r.g / r.n / STEPS)
