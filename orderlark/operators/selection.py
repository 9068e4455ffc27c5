"""Exact quantiles by distributed selection.

A sketch brackets the wanted ranks between two values. One pass counts the rows below and
inside each bracket; brackets that still hold many distinct rows are narrowed by a sketch of
their own rows, and small ones are read as counts per value. All columns and quantiles share
each pass, and no buffer ever holds more than a bracket's values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bracket of at most so many rows is read as counts per value.
BRACKET_ROWS = 50_000
ACCURACY = 1000


@dataclass
class Bracket:
    """The part of a column that holds the ranks [first, last], counted from 0."""

    column: str
    first: int
    last: int
    low: float | None = None  # None: the whole column
    high: float | None = None
    below: int = 0
    rows: int = 0

    def holds(self) -> Column:
        value = F.col(self.column)
        return value.isNotNull() if self.low is None else value.between(self.low, self.high)


def _narrowed(rows: DataFrame, brackets: Sequence[Bracket]) -> None:
    """Bring each bracket down to the values a sketch of it finds around its ranks."""
    asked = []
    for i, b in enumerate(brackets):
        step = 2.0 / ACCURACY
        ends = [max(0.0, (b.first - b.below) / b.rows - step), min(1.0, (b.last - b.below + 1) / b.rows + step)]
        asked.append(F.percentile_approx(F.when(b.holds(), F.col(b.column)), ends, ACCURACY).alias(f"_{i}"))
    found = rows.agg(*asked).first()
    tried = [tuple(found[f"_{i}"]) for i in range(len(brackets))]
    counts = rows.agg(
        *[F.count_if(F.col(b.column) < low).alias(f"_l{i}") for i, (b, (low, _)) in enumerate(zip(brackets, tried))],
        *[F.count_if(F.col(b.column).between(low, high)).alias(f"_n{i}") for i, (b, (low, high)) in enumerate(zip(brackets, tried))],
    ).first()
    for i, (b, (low, high)) in enumerate(zip(brackets, tried)):
        below, inside = counts[f"_l{i}"], counts[f"_n{i}"]
        if below <= b.first and b.last < below + inside and inside < b.rows:
            b.low, b.high, b.below, b.rows = low, high, below, inside
        else:
            # The sketch missed the ranks, or one value fills nearly all: halve the values.
            _halved(rows, b)


def _halved(rows: DataFrame, b: Bracket) -> None:
    value = F.col(b.column)
    low, high = (b.low, b.high) if b.low is not None else rows.agg(F.min(value), F.max(value)).first()
    middle = low / 2 + high / 2
    counts = rows.agg(
        F.count_if(value < low).alias("below"),
        F.count_if(value.between(low, middle)).alias("left"),
        F.count_if((value > middle) & (value <= high)).alias("right"),
        F.max(F.when(value.between(low, middle), value)).alias("left_most"),
        F.min(F.when((value > middle) & (value <= high), value)).alias("right_least"),
    ).first()
    if b.last < counts["below"] + counts["left"]:
        b.low, b.high, b.below, b.rows = low, counts["left_most"], counts["below"], counts["left"]
    elif b.first >= counts["below"] + counts["left"]:
        b.low, b.high, b.below, b.rows = counts["right_least"], high, counts["below"] + counts["left"], counts["right"]
    else:
        # The two ranks are the neighbours on both sides of the middle.
        b.low, b.high, b.below, b.rows = counts["left_most"], counts["right_least"], b.first, 2


def exact_quantiles(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float], bracket_rows: int = BRACKET_ROWS) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column over its values that are not null; None without any.

    `df` is read a few times, so it should be a stored table or a scan.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    totals = rows.agg(*[F.count(c).alias(c) for c in columns]).first()
    wanted = {c: [q * (totals[c] - 1) for q in quantiles] for c in columns if totals[c]}
    brackets = {(c, p): Bracket(c, math.floor(p), math.ceil(p), rows=totals[c]) for c, ps in wanted.items() for p in ps}
    # A bracket whose ends are one value, or neighbours, needs no further pass.
    large = [b for b in brackets.values() if b.rows > bracket_rows]
    while large:
        _narrowed(rows, large)
        large = [b for b in large if b.rows > bracket_rows and b.low != b.high]

    listed = list(brackets.items())
    open_ = [(i, b) for i, (_, b) in enumerate(listed) if b.low is None or b.low != b.high]
    values: dict[int, list[tuple[float, int]]] = {}
    if open_:
        # Rows above the last wanted rank play no part, so at most bracket_rows counts come.
        marks = F.array(*[F.when(b.holds(), F.struct(F.lit(i).alias("i"), F.col(b.column).alias("v"))) for i, b in open_])
        each = rows.select(F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").count()
        for r in each.collect():
            values.setdefault(r["i"], []).append((r["v"], r["count"]))
    found: dict[tuple[str, float], float] = {}
    for i, (key, b) in enumerate(listed):
        if b.low is not None and b.low == b.high:
            found[key] = b.low
            continue
        seen, ends = b.below, {}
        for value, n in sorted(values[i]):
            for rank in (b.first, b.last):
                if seen <= rank < seen + n:
                    ends[rank] = value
            seen += n
        first, last, share = ends[b.first], ends[b.last], key[1] - b.first
        found[key] = first + (last - first) * share
    return {c: [found[c, p] for p in wanted[c]] if c in wanted else [None] * len(quantiles) for c in columns}
