"""Boosted trees against a plain NumPy version, their stopping rule, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlark.models import boosting
from orderlark.models.boosting import Growth, Logistic, Pinball, Squared, fit_boosted


def table(spark, n=500, seed=3, levels=20):
    """Features of few values, so that every value is a bin of its own."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, 3)).astype(float)
    y = x[:, 0] + 5 * (x[:, 1] > 9) + rng.normal(size=n) * (1 + x[:, 2] / 10)
    rows = [(int(i), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "key long, a double, b double, c double, y double").repartition(4).cache()


def plain_tree(x, g, h, depth, min_rows):
    """Exhaustive search over all values; returns the leaf of each row as a set of rows."""
    groups = [np.arange(len(x))]
    for _ in range(depth):
        nxt = []
        for rows in groups:
            best, halves = 1e-9, [rows]
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f])[:-1]:
                    left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                    if min(len(left), len(right)) >= min_rows:
                        gain = sum(g[s].sum() ** 2 / h[s].sum() for s in (left, right)) - g[rows].sum() ** 2 / h[rows].sum()
                        if gain > best + 1e-7:
                            best, halves = gain, [left, right]
            nxt += halves
        groups = nxt
    return groups


@pytest.mark.parametrize("loss", [Squared(), Pinball(0.9), Logistic()])
def test_same_trees_as_a_search_over_all_splits(spark, loss, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    x, y, df = table(spark)
    if isinstance(loss, Logistic):
        y, df = (y > 12).astype(float), df.withColumn("y", (F.col("y") > 12).cast("double"))
    growth = Growth(rounds=5, depth=2, min_rows=10)
    model = fit_boosted(df, ["a", "b", "c"], "y", {"s": loss}, growth)
    start = {Squared: y.mean(), Pinball: np.sort(y)[int(np.ceil(0.9 * len(y))) - 1]}.get(type(loss), None)
    if start is None:
        start = np.log(y.mean() / (1 - y.mean()))
    f = np.full(len(y), start)
    for _ in range(5):
        g, h = loss.gradient(y, f), loss.curvature(f)
        for rows in plain_tree(x, g, h, 2, 10):
            if isinstance(loss, Pinball):
                f_new = np.sort(y[rows] - f[rows])[int(np.ceil(0.9 * len(rows))) - 1]
            else:
                f_new = g[rows].sum() / h[rows].sum()
            f[rows] += 0.1 * f_new
    found = model.score(df).orderBy("key").toPandas()["s"].to_numpy()
    assert found == pytest.approx(loss.link(f), abs=1e-4)


def test_quantiles_cover_rows_that_took_no_part(spark):
    _, _, df = table(spark, n=6000, seed=8)
    held = F.col("key") % 3 == 0
    model = fit_boosted(df.where(~held), ["a", "b", "c"], "y", {"p50": Pinball(0.5), "p90": Pinball(0.9)}, Growth(rounds=25, rate=0.3))
    out = model.score(df.where(held)).toPandas()
    assert (out.y <= out.p50).mean() == pytest.approx(0.5, abs=0.05)
    assert (out.y <= out.p90).mean() == pytest.approx(0.9, abs=0.03)
    # The spread grows with c, which a quantile follows and a mean does not.
    wide = (out.p90 - out.p50)
    assert wide[out.c > 14].mean() > 1.4 * wide[out.c < 5].mean()
    assert list(model.importance("p50"))[0] == "a" and sum(model.importance("p50").values()) == pytest.approx(1)


def test_stops_after_its_patience_and_keeps_the_best_prefix(spark):
    _, _, df = table(spark, n=400, seed=5)
    df = df.withColumn("val", F.col("key") % 4 == 0)
    growth = Growth(rounds=200, depth=4, rate=0.5, patience=6, row_share=0.8, feature_share=0.7)
    model = fit_boosted(df, ["a", "b", "c"], "y", {"s": Squared()}, growth, "val")
    (out,) = model.outputs
    assert len(out.trees) == out.best() < len(out.validation) - 1 == out.best() + 6
    # Every prefix was judged: the shortest and the kept one, by hand.
    val = df.where("val").toPandas()
    spread = df.where("NOT val").agg(F.stddev_pop("y")).first()[0]
    kept = model.score(df.where("val")).toPandas()
    assert out.validation[0] == pytest.approx(((val.y - out.start) ** 2).mean() / spread**2, rel=1e-5)
    assert out.validation[out.best()] == pytest.approx(((kept.y - kept.s) ** 2).mean() / spread**2, rel=1e-5)
    again = fit_boosted(df, ["a", "b", "c"], "y", {"s": Squared()}, growth, "val")
    assert len(again.outputs[0].validation) == len(out.validation)


def test_leaves_are_limited(spark):
    _, _, df = table(spark)
    model = fit_boosted(df, ["a", "b", "c"], "y", {"s": Squared()}, Growth(rounds=2, depth=5, leaves=6))
    for tree in model.outputs[0].trees:
        assert (tree.feature >= 0).sum() == 5


def test_odd_tables(spark):
    columns = "a double, b double, y double"
    empty = spark.createDataFrame([], columns)
    assert fit_boosted(empty, ["a", "b"], "y", {"s": Logistic()}).score(empty).count() == 0
    rows = [(None, float("nan"), 1.0), (float("inf"), 1.0, 2.0), (1.0, None, None), (5.0, 1.0, float("nan")), (3.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, columns)
    scored = fit_boosted(df, ["a", "b"], "y", {"s": Pinball(0.5), "m": Squared()}, Growth(rounds=3)).score(df).collect()
    assert len(scored) == 5 and all(np.isfinite([r["s"], r["m"]]).all() for r in scored)
    same = spark.createDataFrame([(1.0, 2.0, 7.0)] * 9, columns)
    model = fit_boosted(same, ["a", "b"], "y", {"s": Pinball(0.9)}, Growth(rounds=50))
    assert {r["s"] for r in model.score(same).collect()} == {7.0} and len(model.outputs[0].trees) <= 1


def test_rows_travel_in_blocks(spark):
    """A pass opens a few packed blocks, in which no row is lost."""
    _, _, df = table(spark)
    rows = df.select(F.col("key").alias("row"), "y", (F.col("key") % 5 == 0).alias("val"), F.array("a", "b", "c").alias("x"))
    state = boosting._binned(rows, [np.arange(20.0)] * 3, [1.0, 2.0]).collect()
    assert len(state) <= 4
    assert sorted(k for r in state for k in np.frombuffer(r["row"], np.int64)) == list(range(500))
    assert {v for r in state for v in np.frombuffer(r["f"], float)} == {1.0, 2.0}


def test_leaf_quantiles_from_few_ranks(spark, monkeypatch):
    """Tasks that hand on fifty ranks of a leaf miss the quantile by a hundredth of the rows at most."""
    monkeypatch.setattr(boosting, "POINTS", 50)
    _, _, df = table(spark, n=4000, seed=4)
    model = fit_boosted(df.withColumn("a", F.lit(0.0)), ["a"], "y", {"s": Pinball(0.8)}, Growth(rounds=1, rate=1.0))
    y = np.sort([r["y"] for r in df.select("y").collect()])
    (out,) = model.outputs
    assert abs(np.searchsorted(y, out.start + out.trees[0].value[0]) / 4000 - 0.8) <= 0.011
