"""Causal window statistics as Column expressions.

Each takes its keys and order explicitly. A rolling statistic is null until its window holds ``k`` rows without a null; an
expanding one until ``at_least`` non-null values were seen. No frame looks ahead, except those named ``forward``, which
serve as regressands only.

A panel has one row per series and date, so a series is bounded by the calendar; parallelism comes from the series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ANNUAL = 252


class Along:
    """Windows along one series: ``keys`` partition, ``order`` runs in time."""

    def __init__(self, keys: Sequence[str] | str, order: str):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = order

    @property
    def spec(self) -> object:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last(self, k: int) -> object:
        return self.spec.rowsBetween(1 - k, 0)

    def past(self, k: int) -> object:
        """The ``k`` rows before the current one."""
        return self.spec.rowsBetween(-k, -1)

    def ever(self) -> object:
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    def ahead(self, k: int) -> object:
        return self.spec.rowsBetween(1, k)

    # -- rolling -------------------------------------------------------------------------------------------------------
    def rolling(self, statistic: Callable[..., Column], columns: Sequence[Column], k: int, frame: object | None = None, at_least: int | None = None) -> Column:
        frame = frame or self.last(k)
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
        seen = F.count(F.when(whole, F.lit(1))).over(frame)
        value = statistic(*[F.when(whole, c) for c in columns]).over(frame)
        return F.when(seen >= (k if at_least is None else at_least), value)

    def mean(self, x: Column, k: int) -> Column:
        return self.rolling(F.avg, [x], k)

    def total(self, x: Column, k: int) -> Column:
        return self.rolling(F.sum, [x], k)

    def std(self, x: Column, k: int) -> Column:
        return self.rolling(F.stddev_samp, [x], k)

    def realized_vol(self, r: Column, k: int = 21) -> Column:
        return self.std(r, k) * F.sqrt(F.lit(float(ANNUAL)))

    def correlation(self, a: Column, b: Column, k: int) -> Column:
        return self._correlation(a, b, k, self.last(k), k)

    def _correlation(self, a: Column, b: Column, k: int, frame: object, at_least: int) -> Column:
        part = lambda f: self.rolling(f, [a, b], k, frame, at_least)
        spread = part(lambda x, y: F.stddev_pop(x)) * part(lambda x, y: F.stddev_pop(y))
        return part(F.covar_pop) / F.nullif(spread, F.lit(0.0))

    def range_vol(self, high: Column, low: Column, k: int = 21) -> Column:
        """Range-based volatility of Parkinson."""
        return F.sqrt(self.rolling(F.avg, [F.pow(F.ln(high / low), 2) / (4 * F.ln(F.lit(2.0)))], k) * ANNUAL)

    # -- expanding -----------------------------------------------------------------------------------------------------
    def expanding(self, statistic: Callable[[Column], Column], x: Column, at_least: int = 1) -> Column:
        return F.when(F.count(x).over(self.ever()) >= at_least, statistic(x).over(self.ever()))

    def expanding_z(self, x: Column, at_least: int = ANNUAL) -> Column:
        e = self.ever()
        return F.when(F.count(x).over(e) >= at_least, (x - F.avg(x).over(e)) / F.nullif(F.stddev_samp(x).over(e), F.lit(0.0)))

    def expanding_quantile(self, x: Column, p: float, at_least: int = 1) -> Column:
        return self.expanding(lambda c: F.percentile(c, F.lit(p)), x, at_least)

    def share_true(self, flag: Column) -> Column:
        return F.avg(flag.cast("double")).over(self.ever())

    def count_true(self, flag: Column) -> Column:
        return F.sum(F.when(flag, 1).otherwise(0)).over(self.ever())

    def last_true(self, flag: Column) -> Column:
        """Date (or place) of the last row so far where the flag held."""
        return F.max(F.when(flag, F.col(self.order))).over(self.ever())

    def fill(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.ever())

    # -- shifts --------------------------------------------------------------------------------------------------------
    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.spec)

    def change(self, x: Column, k: int = 1) -> Column:
        return x - self.lag(x, k)

    def growth(self, x: Column, k: int = 1) -> Column:
        return x / F.nullif(self.lag(x, k), F.lit(0.0)) - 1

    def log_change(self, x: Column, k: int = 1) -> Column:
        return log(x) - log(self.lag(x, k))

    def number(self) -> Column:
        return F.row_number().over(self.spec)

    # -- forward: regressands only -------------------------------------------------------------------------------------
    def forward_sum(self, r: Column, h: int) -> Column:
        return self.rolling(F.sum, [r], h, self.ahead(h))

    def forward_std(self, r: Column, h: int) -> Column:
        return self.rolling(F.stddev_samp, [r], h, self.ahead(h))

    def forward_correlation(self, a: Column, b: Column, h: int, share: float = 0.8) -> Column:
        return self._correlation(a, b, h, self.ahead(h), int(share * h))

    def forward_drawdown(self, r: Column, h: int) -> Column:
        """Deepest fall of equity from its running peak over the next ``h`` rows; the peak starts at the first of them."""
        path = F.collect_list(F.coalesce(r, F.lit(0.0))).over(self.ahead(h))
        start = F.struct(F.lit(1.0).alias("eq"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

        def step(s: Column, x: Column) -> Column:
            eq = s["eq"] * (1 + x)
            peak = F.greatest(s["peak"], eq)
            return F.struct(eq.alias("eq"), peak.alias("peak"), F.least(s["dd"], eq / F.nullif(peak, F.lit(0.0)) - 1).alias("dd"))

        return F.when(F.size(path) == h, F.aggregate(path, start, step, lambda s: s["dd"]))


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation of a group; null without spread, where the built-in one divides by zero."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def finite(x: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def log(x: Column) -> Column:
    """Natural logarithm, null at or below zero."""
    return F.ln(F.when(x > 0, x))


def clip(x: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Bounded value; null stays null."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def band(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the band a value falls into; a value at an edge belongs to the band above it."""
    out = F.when(x.isNull(), F.lit(None))
    for e, n in zip(edges, names):
        out = out.when(x < e, F.lit(n))
    return out.otherwise(F.lit(names[-1]))


#: The two tables of percentile bands (fixed values).
RECORD_BANDS = ([0.10, 0.30, 0.70, 0.90], ["very low", "low", "typical", "high", "very high"])
READ_BANDS = ([0.20, 0.40, 0.60, 0.80], ["very low", "low", "typical", "high", "very high"])


def sign_state(corr: Column, edge: float = 0.10) -> Column:
    """Strict on both sides: at the edge itself the state is under test."""
    return F.when(corr < -edge, F.lit("intact")).when(corr > edge, F.lit("violated")).when(corr.isNotNull(), F.lit("under_test"))


def direction(change: Column, edge: float) -> Column:
    return F.when(change > edge, F.lit("rising")).when(change < -edge, F.lit("falling")).when(change.isNotNull(), F.lit("flat"))


def tail_mass(p: Column) -> Column:
    return F.least(p, 1 - p)


def digitize(x: Column, edges: Column) -> Column:
    """Number of edges at or below the value."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: x >= e)))
