"""Proportional hazards by partial likelihood, ties after Efron.

Each Newton step needs, for every time with an event, sums over all rows still at risk: of the
hazards exp(x b), of their products with x, and with pairs of x. Rows are first summed per
time, with partial sums where they are read, so a time that very many rows share moves as one
row. The table of times is cut into ordered ranges; a range's totals are carried into all
earlier ones, and inside a range the sums run from the latest time back. The driver sees one
row of totals for each range, and the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlark.session import stored

RANGE_TIMES = 50_000
MOST_STEPS = 30
TOLERANCE = 1e-9
#: Beyond so many event times, the baseline is kept in as many equal steps of time.
MOST_KNOTS = 10_000
CHUNK = 1_000_000


@dataclass(frozen=True)
class HazardModel:
    """log hazard = sum of weight * (feature - mean); baseline: times and cumulative hazards."""

    features: list[str]
    weights: np.ndarray
    means: np.ndarray
    log_likelihood: float
    times: np.ndarray
    hazards: np.ndarray

    def log_hazard(self) -> Column:
        parts = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(m)) * float(w) for c, m, w in zip(self.features, self.means, self.weights, strict=True)]
        return sum(parts, F.lit(0.0))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds log_hazard, and median_days: the first time at which half are expected to have
        had the event; null where the baseline ends before."""
        times, hazards = self.times, self.hazards

        @F.pandas_udf("double")
        def median(log_hazard: pd.Series) -> pd.Series:
            at = np.searchsorted(hazards, math.log(2.0) * np.exp(-log_hazard.to_numpy(np.float64)), side="left")
            return pd.Series(np.append(times, np.nan)[at]).replace({np.nan: None}).astype("float64")

        scored = df.withColumn("log_hazard", self.log_hazard())
        return scored.withColumn("median_days", F.nanvl(median("log_hazard"), F.lit(None).cast("double")))


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(values: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices from rows of their upper halves."""
    out = np.zeros((len(values), p, p))
    for at, (i, j) in enumerate(_upper(p)):
        out[:, i, j] = out[:, j, i] = values[:, at]
    return out


def per_time(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """Sums per time: rows has time, event (0 or 1) and x0, x1, ..."""
    p = len(weights)
    x = [F.col(f"x{i}") for i in range(p)]
    eta = sum((c * float(w) for c, w in zip(x, weights, strict=True)), F.lit(0.0))
    hazard, event = F.exp(eta), F.col("event").cast("double")
    terms = [F.lit(1.0), *x, *[x[i] * x[j] for i, j in _upper(p)]]
    sums = [F.sum(hazard * t).alias(f"s{i}") for i, t in enumerate(terms)]
    sums += [F.sum(event * hazard * t).alias(f"e{i}") for i, t in enumerate(terms)]
    sums += [F.sum(event * c).alias(f"g{i}") for i, c in enumerate(x)]
    return rows.groupBy("time").agg(F.sum("event").cast("long").alias("d"), F.sum(event * eta).alias("eta"), *sums)


def _efron(d: int, s0: float, e0: float) -> tuple[float, np.ndarray]:
    """Sums over the d tied events of ln(f), 1/f, u/f, 1/f^2, u/f^2, u^2/f^2 with
    f = s0 - u e0 and u = 0, 1/d, ..., (d - 1)/d."""
    logs, sums = 0.0, np.zeros(5)
    for at in range(0, d, CHUNK):
        u = np.arange(at, min(d, at + CHUNK)) / d
        f = s0 - u * e0
        logs += np.log(f).sum()
        sums += [(u**k / f**n).sum() for k, n in ((0, 1), (1, 1), (0, 2), (1, 2), (2, 2))]
    return logs, sums


def _likelihood(table: pd.DataFrame, carried: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray, pd.DataFrame]:
    """Log likelihood, gradient, information and baseline steps of a range of times."""
    m = 1 + p + p * (p + 1) // 2
    table = table.sort_values("time", ascending=False)
    at_risk = table[[f"s{i}" for i in range(m)]].to_numpy().cumsum(axis=0) + carried
    events = table[[f"e{i}" for i in range(m)]].to_numpy()
    value, gradient, information = table["eta"].sum(), table[[f"g{i}" for i in range(p)]].to_numpy().sum(axis=0), np.zeros((p, p))
    some = np.flatnonzero(table["d"].to_numpy() > 0)
    s2, e2 = _square(at_risk[some, 1 + p :], p), _square(events[some, 1 + p :], p)
    steps = []
    for k, row in enumerate(some):
        s1, e1 = at_risk[row, 1 : 1 + p], events[row, 1 : 1 + p]
        logs, (a, b, c0, c1, c2) = _efron(int(table["d"].iat[row]), at_risk[row, 0], events[row, 0])
        value -= logs
        gradient = gradient - (s1 * a - e1 * b)
        cross = np.outer(s1, e1)
        information += s2[k] * a - e2[k] * b - (np.outer(s1, s1) * c0 - (cross + cross.T) * c1 + np.outer(e1, e1) * c2)
        steps.append((table["time"].iat[row], a))
    return value, gradient, information, pd.DataFrame(steps, columns=["time", "step"])


def newton_terms(rows: DataFrame, weights: np.ndarray, ranges: int) -> tuple[float, np.ndarray, np.ndarray, DataFrame, dict[int, np.ndarray]]:
    """Log likelihood, gradient and information at some weights, and the cut table of times."""
    p = len(weights)
    m = 1 + p + p * (p + 1) // 2
    cut = per_time(rows, weights).repartitionByRange(ranges, "time").withColumn("range", F.spark_partition_id())
    table = stored(cut, "times")
    totals = table.groupBy("range").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(m)]).orderBy(F.desc("range")).collect()
    carried, sums = {}, np.zeros(m)
    for r in totals:
        carried[r["range"]] = sums.copy()
        sums += [r[f"s{i}"] for i in range(m)]

    def terms(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        value, gradient, information, _ = _likelihood(pdf, carried[key[0]], p)
        return pd.DataFrame({"terms": [[float(value), *gradient.tolist(), *information.ravel().tolist()]]})

    # A range holds about RANGE_TIMES times, however many rows share one.
    found = table.groupBy("range").applyInPandas(terms, "terms array<double>").collect()
    total = np.sum([r["terms"] for r in found], axis=0)
    return float(total[0]), total[1 : 1 + p], total[1 + p :].reshape(p, p), table, carried


def fit_hazards(df: DataFrame, features: Sequence[str], time: str = "time_to_next", event: str = "event", range_times: int = RANGE_TIMES) -> HazardModel:
    """Newton steps from zero, halved where the likelihood would fall. Null features count as
    0, rows with a null time are left out, a null event is none. Constant features get weight 0."""
    p = len(features)
    slim = df.where(F.col(time).isNotNull()).select(
        F.col(time).cast("double").alias("time"), F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("event"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    )
    slim = stored(slim, "survival")
    facts = slim.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("time").alias("times"), F.sum("event").alias("events"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"x{i}").alias(f"d{i}") for i in range(p)]).first()
    if not facts["n"] or not facts["events"]:
        return HazardModel(list(features), np.zeros(p), np.zeros(p), 0.0, np.zeros(0), np.zeros(0))
    means, scales = (np.array([facts[f"{c}{i}"] for i in range(p)]) for c in "md")
    moving = scales > 1e-12 * np.maximum(1.0, np.abs(means))
    scales = np.where(moving, scales, 1.0)
    rows = slim.select("time", "event", *[((F.col(f"x{i}") - float(means[i])) / float(scales[i]) if moving[i] else F.lit(0.0)).alias(f"x{i}") for i in range(p)])
    ranges = max(1, math.ceil(facts["times"] / range_times))
    weights = np.zeros(p)
    value, gradient, information, table, carried = newton_terms(rows, weights, ranges)
    for _ in range(MOST_STEPS):
        step = np.linalg.lstsq(information, gradient, rcond=1e-12)[0]
        for _ in range(10):
            tried = newton_terms(rows, weights + step, ranges)
            if tried[0] >= value - TOLERANCE * abs(value):
                break
            step = step / 2
        gain = tried[0] - value
        weights, (value, gradient, information, table, carried) = weights + step, tried
        if gain <= TOLERANCE * abs(value):
            break
    times, hazards = _baseline(table, carried, p)
    return HazardModel(list(features), weights / scales, means, value, times, hazards)


def _baseline(table: DataFrame, carried: dict[int, np.ndarray], p: int) -> tuple[np.ndarray, np.ndarray]:
    """Event times and the cumulative hazard of a row with average features."""

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _likelihood(pdf, carried[key[0]], p)[3]

    found = stored(table.groupBy("range").applyInPandas(steps, "time double, step double"), "baseline")
    facts = found.agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("low"), F.max("time").alias("high")).first()
    knot = F.col("time") if facts["n"] <= MOST_KNOTS else F.floor((F.col("time") - facts["low"]) * MOST_KNOTS / (facts["high"] - facts["low"]))
    knots = found.groupBy(knot.alias("knot")).agg(F.max("time").alias("time"), F.sum("step").alias("step")).orderBy("time").collect()
    return np.array([r["time"] for r in knots]), np.cumsum([r["step"] for r in knots])


def concordance(pairs: Iterator[tuple[float, int, float]]) -> float:
    """Share of comparable pairs (time, event, score) whose higher score comes first; ties in
    the score count half. Compares all pairs: for bounded samples."""
    t, e, s = (np.array(c, float) for c in zip(*pairs, strict=True))
    before = (t[:, None] < t[None, :]) & (e[:, None] > 0)
    right = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
    return float(right[before].mean())
