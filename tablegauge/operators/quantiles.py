"""Exact, linearly interpolated quantiles of many columns.

``percentile`` keeps every distinct value of a column in one aggregation buffer.  Here a quantile is bracketed
instead: a sketch of bounded size (``percentile_approx``) proposes two values around the wanted rank, an exact
count proves where the rank lies relative to them, and only the few values in between are grouped and sorted.
Columns with up to `SORTED_LEAST` values skip the sketch.  Passes over the data are map-side aggregates of
the numeric columns; only the bracketed rest is shuffled.  The driver holds a few numbers per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tablegauge.functions.missing import ident, number_literal
from tablegauge.operators.columns import COLUMN_BLOCK

# A bracket is narrowed by sketches until this share of its column, within these limits, is left to be sorted.
SORTED_SHARE = 1e-6
SORTED_LEAST, SORTED_MOST = 100_000, 1_000_000
# A sketch is off by at most 1 / SKETCH_ACCURACY of the values it sees.  It sees this share of the bracketed
# values, within these limits: it only proposes a bracket, and exact counts decide.
SKETCH_ACCURACY = 10_000
SKETCHED_SHARE = 1 / 16
SKETCHED_LEAST, SKETCHED_MOST = 50_000, 64_000_000
SKETCH_SEED = 17
# The facts pass of a profile takes a mergeable sketch per column: its values at GRID + 1 evenly spaced shares, off
# by at most 1 / GRID_ACCURACY of the values in rank.  It proposes the first bracket of every quantile.
GRID = 256
GRID_ACCURACY = 2048


def _clamp(x: float, least: float, most: float) -> float:
    return min(max(x, least), most)


@dataclass(frozen=True)
class _Bracket:
    """An interval of one column's values, and how many values lie in it and before it."""

    column: str
    low: float | None          # None: no bound on this side
    high: float | None
    below: int
    at_low: int
    inside: int
    at_high: int

    @property
    def end(self) -> int:
        return self.below + self.at_low + self.inside + self.at_high

    def edge_value(self, rank: int) -> float | None:
        """The value at ``rank`` if it equals one of the two bounds."""
        if rank < self.below + self.at_low:
            return self.low
        if rank >= self.below + self.at_low + self.inside:
            return self.high
        return None

    def inner_rank(self, rank: int) -> int:
        return rank - self.below - self.at_low


@dataclass
class _Quantile:
    """One quantile of one column; its two neighbouring order statistics lie within ``bracket``."""

    prob: float
    n: int
    bracket: _Bracket

    @property
    def ranks(self) -> tuple[int, int]:
        first = min(math.floor(self.prob * (self.n - 1)), self.n - 1)
        return first, min(first + 1, self.n - 1)

    @property
    def open(self) -> bool:
        return any(self.bracket.edge_value(r) is None for r in self.ranks)

    def interpolate(self, lower: float, upper: float) -> float:
        """Linear interpolation, computed from the nearer of the two values."""
        weight = self.prob * (self.n - 1) - self.ranks[0]
        if lower == upper:
            return lower
        if weight >= 0.5:
            return upper - (upper - lower) * (1 - weight)
        return lower + (upper - lower) * weight


def sketch_expression(value: str) -> str:
    """A mergeable sketch of a column (SQL), to be taken in a pass that aggregates anyway: the values at GRID + 1
    evenly spaced shares.  NULL for a column without values."""
    shares = ", ".join(number_literal(i / GRID) for i in range(GRID + 1))
    return f"percentile_approx({value}, array({shares}), {GRID_ACCURACY})"


def _from_sketch(q: _Quantile, grid: list[float]) -> tuple[float, float]:
    """Two grid values whose ranks lie before and after the quantile's two ranks, if the sketch keeps its bound."""
    margin = 2.0 / GRID_ACCURACY
    first, second = q.ranks
    low = max(0, math.floor((first / q.n - margin) * GRID))
    high = min(GRID, math.ceil(((second + 1) / q.n + margin) * GRID))
    return grid[low], grid[high]


def column_quantiles(numbers: DataFrame, probs: Sequence[float], counts: dict[str, int] | None = None,
                     sketches: dict[str, list[float]] | None = None,
                     approximate: bool = False) -> dict[str, list[float]]:
    """Exact quantiles of every column of ``numbers`` (doubles, missing as NULL; see `numeric_values`).

    ``counts`` are the numbers of values per column, if they are known already; ``sketches`` the columns'
    `sketch_expression`, if a pass took them already: they propose the first brackets, so that no pass of its own
    is needed for that.  Columns without values are left out.  Runs jobs.  The result has ``len(probs)`` numbers per
    column, so it is as small as the schema.

    ``approximate=True`` gives in one pass, for each share p, a value whose rank lies within n / GRID_ACCURACY of
    p * n (the sketch's order statistic, without interpolation); `approximation_errors` checks that bound.
    """
    if approximate:
        return approximate_quantiles(numbers, probs)
    out: dict[str, list[float]] = {}
    for i in range(0, len(numbers.columns), COLUMN_BLOCK):
        block = numbers.columns[i:i + COLUMN_BLOCK]
        known = counts or dict(zip(block, numbers.selectExpr(*[f"count({ident(c)})" for c in block]).first()))
        out.update(_block_quantiles(numbers, {c: known[c] for c in block if known[c] > 0}, list(probs),
                                    sketches or {}))
    return out


def approximate_quantiles(numbers: DataFrame, probs: Sequence[float]) -> dict[str, list[float]]:
    """The sketch's value at each share, for every column with values: one pass."""
    shares = ", ".join(number_literal(p) for p in probs)
    out: dict[str, list[float]] = {}
    for i in range(0, len(numbers.columns), COLUMN_BLOCK):
        block = numbers.columns[i:i + COLUMN_BLOCK]
        row = numbers.selectExpr(*[f"percentile_approx({ident(c)}, array({shares}), {GRID_ACCURACY})"
                                   for c in block]).first()
        out.update({c: list(v) for c, v in zip(block, row) if v is not None})
    return out


def approximation_errors(numbers: DataFrame, probs: Sequence[float], values: dict[str, list[float]]) -> DataFrame:
    """``(column, prob, value, n, rank_low, rank_high, within_bound)``: where each approximate value ranks, counted
    exactly in one pass, and whether some rank of it lies within ``n / GRID_ACCURACY`` (plus one for rounding) of
    ``prob * n``."""
    spark = numbers.sparkSession
    lines = [(c, float(p), float(v)) for c, vs in values.items() for p, v in zip(probs, vs)]
    if not lines:
        return spark.createDataFrame([], "column string, prob double, value double, n bigint, rank_low bigint, "
                                         "rank_high bigint, within_bound boolean")
    counts = []
    for c, _, v in lines:
        counts += [f"count_if({ident(c)} < {number_literal(v)})", f"count_if({ident(c)} <= {number_literal(v)})",
                   f"count({ident(c)})"]
    row = numbers.selectExpr(*counts).first()
    found = [(c, p, v, row[3 * k + 2], row[3 * k] + 1, row[3 * k + 1]) for k, (c, p, v) in enumerate(lines)]
    table = spark.createDataFrame(found, "column string, prob double, value double, n bigint, rank_low bigint, "
                                         "rank_high bigint")
    target, slack = F.col("prob") * F.col("n"), F.col("n") / F.lit(GRID_ACCURACY) + F.lit(1)
    within = (F.col("rank_low") <= target + slack) & (F.col("rank_high") >= target - slack)
    return table.withColumn("within_bound", within)


def _block_quantiles(df: DataFrame, counts: dict[str, int], probs: list[float],
                     sketches: dict[str, list[float]]) -> dict[str, list[float]]:
    quantiles = [
        _Quantile(p, n, _Bracket(c, None, None, 0, 0, n, 0)) for c, n in counts.items() for p in probs]

    def too_wide(q: _Quantile) -> bool:
        return q.open and q.bracket.inside > _clamp(q.n * SORTED_SHARE, SORTED_LEAST, SORTED_MOST)

    sketched = [q for q in quantiles if too_wide(q) and sketches.get(q.bracket.column)]
    if sketched:
        _narrow(df, sketched, [_from_sketch(q, sketches[q.bracket.column]) for q in sketched])
    while wide := [q for q in quantiles if too_wide(q)]:
        _narrow(df, wide)
    inner = _inner_values(df, [q for q in quantiles if q.open])
    out: dict[str, list[float]] = {}
    for q in quantiles:
        def value_at(rank: int) -> float:
            edge = q.bracket.edge_value(rank)
            return edge if edge is not None else inner[(q.bracket, q.bracket.inner_rank(rank))]
        lower, upper = (value_at(r) for r in q.ranks)
        out.setdefault(q.bracket.column, []).append(q.interpolate(lower, upper))
    return out


def _within(column: str, low: float | None, high: float | None) -> str:
    """The column's values strictly between the bounds, others as NULL."""
    v = ident(column)
    tests = [f"{v} > {number_literal(low)}"] if low is not None else []
    tests += [f"{v} < {number_literal(high)}"] if high is not None else []
    return f"case when {' and '.join(tests)} then {v} end" if tests else v


def _measure(df: DataFrame, intervals: list[tuple[str, float | None, float | None]]) -> list[_Bracket]:
    """Exact counts for every interval, in one pass."""
    upto = []                                    # counts of values < low, <= low, < high, <= high
    for column, low, high in intervals:
        v = ident(column)
        for bound, unbounded in ((low, "0"), (high, f"count({v})")):
            tests = ("<", "<=")
            upto += [unbounded if bound is None else f"count_if({v} {t} {number_literal(bound)})" for t in tests]
    row = df.selectExpr("count(1)", *upto).first()[1:]
    brackets = []
    for i, interval in enumerate(intervals):
        below, to_low, before_high, to_high = row[4 * i:4 * i + 4]
        inside = max(before_high - to_low, 0)                    # equal bounds enclose nothing
        brackets.append(_Bracket(*interval, below, to_low - below, inside, to_high - to_low - inside))
    return brackets


def _narrow(df: DataFrame, quantiles: list[_Quantile], proposals: list[tuple[float, float]] | None = None) -> None:
    """One sketch (unless ``proposals`` come from one taken before) and one exact count; every quantile ends with a
    smaller bracket."""
    proposals = proposals or _propose(df, quantiles)
    trials = _measure(df, [(q.bracket.column, *p) for q, p in zip(quantiles, proposals)])
    missed = []
    for q, trial in zip(quantiles, trials):
        first, second = q.ranks
        if first < trial.below:            # the proposal is too high: stay left of it
            missed.append((q, (trial.column, q.bracket.low, trial.low)))
        elif second >= trial.end:          # too low: stay right of it
            missed.append((q, (trial.column, trial.high, q.bracket.high)))
        else:
            q.bracket = trial
    if missed:
        for (q, _), bracket in zip(missed, _measure(df, [interval for _, interval in missed])):
            q.bracket = bracket


def _propose(df: DataFrame, quantiles: list[_Quantile],
             share: float | None = None) -> list[tuple[float, float]]:
    """Two values around each quantile, from one sketch per bracket over ``share`` of the rows."""
    inside = {q.bracket: q.bracket.inside for q in quantiles}
    if share is None:
        share = max(_clamp(n * SKETCHED_SHARE, SKETCHED_LEAST, SKETCHED_MOST) / n for n in inside.values())
    rows = df if share >= 1 else df.sample(fraction=share, seed=SKETCH_SEED)

    wanted: dict[_Bracket, list[float]] = {b: [] for b in inside}
    slots = []
    for q in quantiles:
        b, (first, second) = q.bracket, q.ranks
        margin = 2.0 / SKETCH_ACCURACY
        if share < 1:
            margin += 3.0 / math.sqrt(share * b.inside)          # six standard deviations of a sampled rank
        bounds = (b.inner_rank(first) / b.inside - margin, (b.inner_rank(second) + 1) / b.inside + margin)
        slots.append(len(wanted[b]))
        wanted[b] += [min(max(x, 0.0), 1.0) for x in bounds]

    sketches = []
    for b, shares in wanted.items():
        sketches.append(
            f"percentile_approx({_within(b.column, b.low, b.high)}, "
            f"array({', '.join(map(number_literal, shares))}), {SKETCH_ACCURACY})")
    found = dict(zip(wanted, rows.selectExpr(*sketches).first()))
    if any(f is None for f in found.values()):                   # the sample missed a bracket altogether
        return _propose(df, quantiles, share=1.0)
    return [(found[q.bracket][s], found[q.bracket][s + 1]) for q, s in zip(quantiles, slots)]


def _inner_values(df: DataFrame, quantiles: list[_Quantile]) -> dict[tuple[_Bracket, int], float]:
    """Order statistics strictly inside a bracket, by (bracket, rank within it)."""
    ranks: dict[_Bracket, set[int]] = {}
    for q in quantiles:
        inner = {q.bracket.inner_rank(r) for r in q.ranks if q.bracket.edge_value(r) is None}
        ranks.setdefault(q.bracket, set()).update(inner)
    if not ranks:
        return {}
    brackets = list(ranks)
    cells = [f"struct({i} as bracket, {_within(b.column, b.low, b.high)} as v)" for i, b in enumerate(brackets)]
    wanted = [f"{i}, array({', '.join(f'{r}L' for r in sorted(ranks[b]))})" for i, b in enumerate(brackets)]
    counted = df.selectExpr(f"inline(array({', '.join(cells)}))").where("v is not null").groupBy("bracket", "v").count()
    # A bracket has at most SORTED_MOST values, so one task can sort it.
    in_order = Window.partitionBy("bracket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        counted.withColumn("upto", F.sum("count").over(in_order))
        .selectExpr("*", f"explode(element_at(map({', '.join(wanted)}), bracket)) as rank")
        .where("rank < upto and rank >= upto - count")
        .select("bracket", "rank", "v")
    )
    return {(brackets[r["bracket"]], r["rank"]): r["v"] for r in hits.collect()}
