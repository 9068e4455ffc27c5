"""Exact quantiles, proportional hazards and the ranker against brute force."""

import numpy as np
import pytest

from orderlark.models import hazards, lambda_rank
from orderlark.operators.evaluate import ndcg
from orderlark.operators.selection import exact_quantiles

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("bracket_rows", [5, 300, 50_000])
def test_exact_quantiles(spark, bracket_rows):
    rng = np.random.default_rng(2)
    n = 4000
    columns = {
        "distinct": rng.permutation(n) * 1.5 - 100,
        "wide": rng.normal(size=n) * 10.0 ** rng.integers(-9, 9, n),
        "few": rng.integers(0, 3, n).astype(float),
        "one": np.full(n, 7.0),
        "hot": np.where(rng.random(n) < 0.6, 3.0, rng.random(n) * 10),
    }
    rows = [tuple(None if c == "few" and i % 5 == 0 else float(v[i]) for c, v in columns.items()) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", empty double").cache()
    found = exact_quantiles(df, [*columns, "empty"], QS, bracket_rows)
    for c, v in columns.items():
        held = v[np.arange(n) % 5 != 0] if c == "few" else v
        assert found[c] == pytest.approx(np.quantile(held, QS).tolist(), rel=1e-12, abs=1e-15), c
    assert found["empty"] == [None] * len(QS)


def partial_likelihood(x, t, e, b):
    """Efron's log partial likelihood, term by term."""
    eta, total = x @ b, 0.0
    for time in np.unique(t[e == 1]):
        tied, risk = np.flatnonzero((t == time) & (e == 1)), t >= time
        for k in range(len(tied)):
            total -= np.log(np.exp(eta[risk]).sum() - k / len(tied) * np.exp(eta[tied]).sum())
        total += eta[tied].sum()
    return total


def survival_rows(n=400, seed=4, days=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 100, 3]
    rate = np.exp(0.8 * x[:, 0] - 0.1 * (x[:, 1] - 100))
    t = np.ceil(rng.exponential(12 / rate)).clip(1, days)
    e = ((t < days) & (rng.random(n) < 0.8)).astype(int)
    return x, t, e


@pytest.mark.parametrize("range_times", [7, 50_000])
def test_hazards_maximise_the_partial_likelihood(spark, range_times):
    x, t, e = survival_rows()
    rows = [(float(a), float(b), float(c), 1.0, float(d), int(f)) for (a, b, c), d, f in zip(x, t, e)]
    df = spark.createDataFrame([*rows, (None, 100.0, 3.0, 1.0, None, 1)], "a double, b double, c double, same double, time double, event int")
    model = hazards.fit_hazards(df, ["a", "b", "c", "same"], "time", "event", range_times)
    assert model.weights[3] == 0
    best = model.weights[:3]
    at_best = partial_likelihood(x - x.mean(0), t, e, best)
    assert at_best == pytest.approx(model.log_likelihood, abs=1e-6)
    for i in range(3):
        for sign in (1, -1):
            step = np.zeros(3)
            step[i] = sign * 1e-3 / x[:, i].std()
            assert partial_likelihood(x - x.mean(0), t, e, best + step) < at_best
    assert best[0] == pytest.approx(0.8, abs=0.2) and best[1] == pytest.approx(-0.1, abs=0.05)
    # The baseline: Efron's steps, added up over the event times.
    hazard = np.exp((x - model.means[:3]) @ best)
    want = []
    for time in np.unique(t[e == 1]):
        tied = (t == time) & (e == 1)
        want.append(sum(1 / (hazard[t >= time].sum() - k / tied.sum() * hazard[tied].sum()) for k in range(tied.sum())))
    assert model.times.tolist() == np.unique(t[e == 1]).tolist()
    assert model.hazards.tolist() == pytest.approx(np.cumsum(want).tolist(), rel=1e-6)


def test_hazards_order_held_out_rows(spark):
    x, t, e = survival_rows(n=600, seed=9)
    rows = [(int(i), *map(float, x[i]), float(t[i]), int(e[i])) for i in range(len(t))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, time double, event int")
    model = hazards.fit_hazards(df.where("id % 3 > 0"), ["a", "b", "c"], "time", "event")
    held = model.score(df.where("id % 3 = 0")).collect()
    assert hazards.concordance((r["time"], r["event"], r["log_hazard"]) for r in held) > 0.7
    assert all(r["median_days"] is None or r["median_days"] in model.times for r in held)
    quick = [r["median_days"] for r in held if r["log_hazard"] > 1 and r["median_days"]]
    slow = [r["median_days"] for r in held if r["log_hazard"] < -0.5 and r["median_days"]]
    assert np.mean(quick) < np.mean(slow)


def test_hazards_without_events(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0)], "a double, time double, event int")
    for rows in (df, df.limit(0)):
        model = hazards.fit_hazards(rows, ["a"], "time", "event")
        assert model.score(df).select("log_hazard", "median_days").collect() == [(0.0, None)]


def test_lambda_terms_are_sums_over_pairs():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(12, 3)), rng.integers(0, 2, 12), rng.normal(size=3)
    scores = x @ w
    rank = np.argsort(np.argsort(-scores))
    discount, ideal = 1 / np.log2(rank + 2), (1 / np.log2(np.arange(y.sum()) + 2)).sum()
    gradient, curvature = np.zeros(3), np.zeros((3, 3))
    for i in np.flatnonzero(y):
        for j in np.flatnonzero(y == 0):
            cost = abs(discount[i] - discount[j]) / ideal
            miss = 1 / (1 + np.exp(scores[i] - scores[j]))
            gradient += cost * miss * (x[i] - x[j])
            curvature += cost * miss * (1 - miss) * np.outer(x[i] - x[j], x[i] - x[j])
    g, h, value = lambda_rank.group_terms(x, y, scores)
    assert np.allclose(g, gradient) and np.allclose(h, curvature)
    assert value == pytest.approx((discount * y).sum() / ideal)


@pytest.mark.parametrize("group_rows", [8, 2000])
def test_ranker_beats_a_single_feature(spark, group_rows):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(120):
        x = rng.normal(size=(25, 3))
        y = x @ [1.0, -2.0, 0.0] + rng.normal(size=25) > 2.0
        rows += [(f"g{g}", f"{g}-{i}", *map(float, x[i]), int(y[i])) for i in range(25)]
    df = spark.createDataFrame([*rows, (None, "n", 1.0, None, 0.0, 1)], "grp string, item string, a double, b double, c double, y int")
    train, held = df.where("item NOT LIKE '%7%'"), df.where("item LIKE '7_-%'")
    model = lambda_rank.fit_lambda_rank(train, "grp", ["a", "b", "c"], "y", "item", group_rows=group_rows)
    assert model.weights[0] > 0 > model.weights[1] and abs(model.weights[2]) < abs(model.weights[0]) / 2

    def gain(scored):
        return ndcg(scored, "grp", "score", "y", "item").first()

    ours, one = gain(model.score(held)), gain(held.withColumnRenamed("a", "score"))
    assert ours["ndcg_at_5"] > one["ndcg_at_5"] and ours["ndcg_at_10"] > one["ndcg_at_10"]


def test_lambda_terms_of_many_groups_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 60)
    x, stretch, taught = rng.normal(size=(sizes.sum(), 3)), rng.integers(1, 4, 60), rng.random(60) < 0.7
    y, scores = rng.random(len(x)) < 0.3, np.round(rng.normal(size=len(x)), 1)
    ends = np.cumsum(sizes)
    each = [lambda_rank.group_terms(x[e - n : e], y[e - n : e], scores[e - n : e], k) for e, n, k in zip(ends, sizes, stretch)]
    for pairs in (1, 500, 50_000):
        monkeypatch.setattr(lambda_rank, "PAIRS", pairs)
        g, h, ndcg = lambda_rank.block_terms(x, y, scores, sizes, stretch, taught)
        assert np.allclose(g, sum(e[0] for e, t in zip(each, taught) if t)) and np.allclose(h, sum(e[1] for e, t in zip(each, taught) if t))
        assert np.allclose(ndcg, [e[2] for e in each], equal_nan=True)


def test_ranker_blocks_hold_whole_groups(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(0, 400, 1, 1).selectExpr("id % 7 + 1 AS at", "1L AS parts", "false AS held", "0 AS y", "array(cast(id AS double), 0D) AS x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    monkeypatch.setattr(lambda_rank, "BLOCK_ROWS", 25)
    try:
        found = lambda_rank._blocks(rows).withColumn("n", F.length("x") / 16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = [np.frombuffer(r["sizes"], np.int64) for r in found]
    assert len(found) > 5 and [s.sum() for s in sizes] == [r["n"] for r in found]
    assert np.concatenate(sizes).tolist() == [7] * 57 + [1]
    assert np.concatenate([np.frombuffer(r["x"]).reshape(-1, 2)[:, 0] for r in found]).tolist() == list(range(400))
