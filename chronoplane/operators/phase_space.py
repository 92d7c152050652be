"""Implausible readings per source: phase-space thresholding, stuck runs, bounds.

A reading, its first and its second difference are a point in phase space. The source's plausible readings span an
ellipsoid there; a point outside it is a spike. As spikes distort scales and the differences of their neighbours, the test
is repeated: differences are taken to the nearest plausible readings, scales from plausible readings only, until the
readings outside are those that were left out.

Half-axes are the universal threshold ``sqrt(2 ln n)`` of the source's ``n`` readings, times the source's own scales, times
``margin``. A scale is the fourth root of a third of the fourth moment: the standard deviation of a normal source, and
nearer to that of the stormy spells where a source has them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Readings of the plausible sources of sf0.1 and check_l reach 2.34 of their own half-axes at a margin of 1, the least spike there 3.37.
MARGIN = 2.8
STUCK_RUN = 6
#: Bound of the repetitions; the sources of the test tables settle in the second.
ROUNDS = 40
_NORMAL_MAD = 0.6745


def _nearest(n: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest kept readings before and after each; -1 and n where there is none."""
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(keep, at, -1))
    after = np.minimum.accumulate(np.where(keep, at, n)[::-1])[::-1]
    return np.r_[-1, before[:-1]], np.r_[after[1:], n]


def _phase(x: np.ndarray, keep: np.ndarray) -> list[np.ndarray]:
    """Value about the median, first and second difference, each to the nearest kept readings; differences missing at the ends are zero."""
    n = len(x)
    p, q = _nearest(n, keep)
    both = (p >= 0) & (q < n)
    a, b = x[np.minimum(q, n - 1)], x[np.maximum(p, 0)]
    return [x - np.median(x[keep]), np.where(both, (a - b) / 2, 0.0), np.where(both, a - 2 * x + b, 0.0)]


def _fourth(c: np.ndarray) -> float:
    top = float(np.abs(c).max(initial=0.0))
    return top * float(((c / top) ** 4).mean() / 3) ** 0.25 if top else 0.0


def _outside(x: np.ndarray, keep: np.ndarray, reach: float, axes: Sequence[int], robust: bool = False) -> np.ndarray:
    """Which readings lie outside the ellipsoid of the kept ones."""
    square = np.zeros(len(x))
    coordinates = _phase(x, keep)
    for k in axes:
        c = coordinates[k]
        scale = float(np.median(np.abs(c[keep]))) / _NORMAL_MAD if robust else 0.0
        scale = scale or _fourth(c[keep])
        if scale:
            square += np.minimum(np.abs(c) / scale, 1e150) ** 2
        elif k == 0:  # no spread, no spikes
            return np.zeros(len(x), bool)
    return square > reach * reach


def spikes(x: np.ndarray, margin: float = MARGIN, rounds: int = ROUNDS, axes: Sequence[int] = (0, 1, 2)) -> np.ndarray:
    """Which readings of one source, in order, are spikes.

    The first round takes robust scales (medians), so that spikes can't hide one another; it leaves out too much, spikes
    with their neighbours and storms. The rounds after it let back in what lies inside the ellipsoid of the rest, until
    nothing changes. A reading that is no finite number is a spike.
    """
    finite = np.isfinite(x)
    y = x[finite]
    out = np.ones(len(x), bool)
    if len(y) < 2:
        out[finite] = False
        return out
    with np.errstate(over="ignore", invalid="ignore"):
        reach = margin * np.sqrt(2 * np.log(len(y)))
        odd = _outside(y, np.ones(len(y), bool), reach, axes, robust=True)
        for _ in range(rounds):
            if odd.all():
                break
            now = _outside(y, ~odd, reach, axes)
            if (now == odd).all():
                break
            odd = now
    out[finite] = odd
    return out


def stuck(x: np.ndarray, run: int = STUCK_RUN) -> np.ndarray:
    """Which readings lie in a run of ``run`` or more equal ones."""
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
    length = np.diff(edge)
    return np.repeat(length >= run, length)


def flag_readings(
    readings: DataFrame, keys: Sequence[str], order: str, value: str, lower: float | None = None, upper: float | None = None,
    margin: float = MARGIN, run: int = STUCK_RUN, rounds: int = ROUNDS, axes: Sequence[int] = (0, 1, 2),
) -> DataFrame:
    """Adds ``spike``, ``stuck`` and ``impossible`` to the readings: one row per keys and order, no null or NaN values.

    ``lower`` and ``upper``: readings at or beyond are impossible; they take no part in scales and differences and are no
    spikes. A run of ``run`` or more equal readings in order is stuck. ``axes``: which of value, first and second
    difference span the ellipsoid. A source without spread has no spikes; at its ends, where a difference is missing, the
    value alone counts. An empty input gives no rows; further columns are ignored.

    How often a source's test must be repeated depends on its data, so a source is one Arrow group, worked off by array
    operations in memory proportional to its readings. The caller has folded repeated days: a source has at most one
    reading a day, some 36,500 a century, however many rows it was delivered in.
    """
    keys = list(keys)
    rows = readings.select(*keys, order, F.col(value).cast("double").alias(value))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "spike boolean, stuck boolean, impossible boolean"])

    def judge(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        x = group[value].to_numpy()
        impossible = np.zeros(len(x), bool)
        if lower is not None:
            impossible |= x <= lower
        if upper is not None:
            impossible |= x >= upper
        spike = np.zeros(len(x), bool)
        spike[~impossible] = spikes(x[~impossible], margin, rounds, axes)
        for name, flag in (("spike", spike), ("stuck", stuck(x, run)), ("impossible", impossible)):
            group = group.append_column(name, pa.array(flag))
        return group

    return rows.groupBy(*keys).applyInArrow(judge, schema)
