"""Order-dependent estimators along one series: plain numpy functions, and the way to run them per series on Spark.

A panel has one row per series and date, so a group is bounded by the calendar. Independent refits become groups of their
own (``windowed_refits``), so long series don't serialise them.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


# -- running on Spark --------------------------------------------------------------------------------------------------
def along_series(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], function: Callable[[pd.DataFrame], dict], result: str, spread: bool = False) -> DataFrame:
    """Keys, order and the columns of ``result`` ("name type, ..."): ``function`` gets a series in order and returns arrays of its length.

    ``spread``: small rows but long work, so the partitions are kept as many as shuffles have, instead of being merged by size.
    """
    keys = list(keys)
    names = [x.strip().split()[0] for x in result.split(",")]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, order])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable").reset_index(drop=True)
        out = group[[*keys, order]].copy()
        for name, value in function(group).items():
            out[name] = value
        return out[[*keys, order, *names]]

    rows = df.select(*keys, order, *columns)
    if spread:
        rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, {result}")


def windowed_refits(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], window: int, step: int, function: Callable[[pd.DataFrame], dict], result: str, spread: bool = False) -> DataFrame:
    """One group per series and refit: the ``window`` rows before row ``window + k * step``. Keys, ``refit`` (k), order of that row, and the result.

    A row is copied to the refits whose window holds it: ``window / step`` copies. ``spread`` as in ``along_series``.
    """
    keys = list(keys)
    along = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, *columns).withColumn("_i", F.row_number().over(along) - 1)
    at = rows.where((F.col("_i") >= window) & ((F.col("_i") - window) % step == 0)).select(*keys, ((F.col("_i") - window) / step).cast("int").alias("refit"), F.col(order).alias("_at"))
    first = F.greatest(F.ceil((F.col("_i") - window + 1) / step), F.lit(0))
    last = F.floor(F.col("_i") / step)
    # where the step is wider than the window, some rows lie in no window; a sequence from a greater to a lesser number would run backwards
    copies = rows.where(first <= last).withColumn("refit", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    if spread:
        copies = copies.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "refit")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    names = [x.strip().split()[0] for x in result.split(",")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i")
        if len(group) < window:
            return pd.DataFrame(columns=[*keys, "refit", *names])
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, "refit": group["refit"].iloc[0], **function(group)}])

    fits = copies.groupBy(*keys, "refit").applyInPandas(run, f"{kinds}, refit int, {result}")
    return at.join(fits, [*keys, "refit"]).withColumnRenamed("_at", order)


# -- ranks -------------------------------------------------------------------------------------------------------------
def expanding_rank(x: np.ndarray) -> np.ndarray:
    """Average rank of each value among those so far, over their number; missing values rank as missing and don't count."""
    seen: list[float] = []
    out = np.full(len(x), np.nan)
    for t, v in enumerate(x):
        if v == v:
            bisect.insort(seen, v)
            below, upto = bisect.bisect_left(seen, v), bisect.bisect_right(seen, v)
            out[t] = (below + upto + 1) / (2 * len(seen))
    return out


def expanding_quantile(x: np.ndarray, p: float, at_least: int = 1) -> np.ndarray:
    """Interpolated quantile of the values so far, from one sorted list that grows; missing until ``at_least`` were seen."""
    seen: list[float] = []
    out = np.full(len(x), np.nan)
    for t, v in enumerate(x):
        if v == v:
            bisect.insort(seen, v)
        if len(seen) >= max(1, at_least):
            at = p * (len(seen) - 1)
            low = int(at)
            top = seen[min(low + 1, len(seen) - 1)]
            out[t] = seen[low] + (at - low) * (top - seen[low])
    return out


# -- exponentially weighted --------------------------------------------------------------------------------------------
def ewma_vol(r: np.ndarray, lam: float = 0.94, burn_in: int = YEAR) -> np.ndarray:
    """Annualised volatility of exponentially weighted squares, seeded by the population variance of the burn-in.

    A missing return after the burn-in leaves everything after it missing.
    """
    out = np.full(len(r), np.nan)
    if len(r) <= burn_in or np.isnan(r[:burn_in]).all():
        return out
    state = float(np.nanvar(r[:burn_in]))
    for t in range(burn_in, len(r)):
        state += (1.0 - lam) * (r[t] * r[t] - state)
        out[t] = state
    return np.sqrt(out * YEAR)


def ewm_mean(x: np.ndarray, halflife: float) -> np.ndarray:
    """Weights halve every ``halflife`` rows, over all values so far; missing rows age the weights and keep the last mean."""
    decay = math.exp(-math.log(2.0) / halflife)
    top = weight = 0.0
    out = np.full(len(x), np.nan)
    for t, v in enumerate(x):
        top, weight = top * decay, weight * decay
        if v == v:
            top, weight = top + v, weight + 1.0
        if weight:
            out[t] = top / weight
    return out


def ewm_std(x: np.ndarray, halflife: float) -> np.ndarray:
    """Bias-corrected exponentially weighted deviation; missing before the second value."""
    decay = math.exp(-math.log(2.0) / halflife)
    w1 = w2 = s = q = 0.0
    out = np.full(len(x), np.nan)
    base = next((v for v in x if v == v), 0.0)  # shifted, so that sums of squares don't cancel
    for t, v in enumerate(x):
        w1, w2, s, q = w1 * decay, w2 * decay * decay, s * decay, q * decay
        if v == v:
            d = v - base
            w1, w2, s, q = w1 + 1, w2 + 1, s + d, q + d * d
        if w1 * w1 - w2 > 1e-12:
            out[t] = math.sqrt(max(q / w1 - (s / w1) ** 2, 0.0) * w1 * w1 / (w1 * w1 - w2))
    return out


def downside_features(r: np.ndarray) -> dict[str, np.ndarray]:
    """Downside deviation (half-life 10) and Sortino ratios (half-lives 20 and 60)."""
    loss = np.where(np.isnan(r), np.nan, np.minimum(r, 0.0) ** 2)
    out = {"dd10": np.sqrt(ewm_mean(loss, 10))}
    for h in (20, 60):
        down = np.sqrt(ewm_mean(loss, h))
        out[f"sortino{h}"] = np.divide(ewm_mean(r, h), down, out=np.full(len(r), np.nan), where=down > 0)
    return out


def smoothed(x: np.ndarray, lam: float = 0.94) -> np.ndarray:
    """Exponential smoothing from the first value on; a missing value carries the last level."""
    out = np.full(len(x), np.nan)
    level = math.nan
    for t, v in enumerate(x):
        if v == v:
            level = v if level != level else lam * level + (1 - lam) * v
        out[t] = level
    return out


def excitation(events: np.ndarray, beta: float) -> np.ndarray:
    """Discrete self-exciting state: past events, each fading by exp(-beta) a row."""
    fade, level = math.exp(-beta), 0.0
    out = np.empty(len(events))
    for t, e in enumerate(events):
        level = fade * level + (e if e == e else 0.0)
        out[t] = level
    return out


def hysteresis(state: np.ndarray, k: int) -> np.ndarray:
    """Changes to a new state only after ``k`` rows of it in a row; missing rows keep the state and break the count."""
    held = math.nan
    last, length = math.nan, 0
    out = np.full(len(state), np.nan)
    for t, v in enumerate(state):
        if v != v:
            last, length = math.nan, 0
        else:
            length = length + 1 if v == last else 1
            last = v
            if held != held or (length >= k and v != held):
                held = v
        out[t] = held
    return out


def bull_bear(price: np.ndarray, threshold: float = 0.2) -> np.ndarray:
    """1 between a peak and the trough after a fall of ``threshold``, 0 else; phases start the row after their turning point."""
    out = np.zeros(len(price), dtype=int)
    rising, best = True, 0
    for t in range(1, len(price)):
        gain = price[t] / price[best] - 1 if price[best] else 0.0
        if (gain > 0) if rising else (gain < 0):
            best = t
        elif (gain <= -threshold) if rising else (gain >= threshold):
            out[best + 1 :] = int(rising)
            rising, best = not rising, t
    return out


def drawdown_episodes(dates: Sequence, r: np.ndarray, n: int = 5) -> list[tuple]:
    """(peak, trough, end, depth) of the deepest falls from a running peak, each blanked out before the next is sought."""
    equity = np.cumprod(1 + np.nan_to_num(r))
    peak = np.maximum.accumulate(equity)
    left = equity / peak - 1
    found = []
    for _ in range(n):
        if not len(left) or left.min() >= 0:
            break
        low = int(left.argmin())
        top = int(np.flatnonzero(equity[: low + 1] == peak[low])[-1])
        back = np.flatnonzero(equity[low:] >= peak[low])
        end = low + int(back[0]) if len(back) else len(r) - 1
        found.append((dates[top], dates[low], dates[end], float(left[low])))
        left[top : end + 1] = 0.0
    return sorted(found, key=lambda e: e[3])


# -- optimisers --------------------------------------------------------------------------------------------------------
def nelder_mead(f: Callable[[np.ndarray], float], start: Sequence[float], scale: float = 0.25, steps: int = 400, close: float = 1e-7) -> tuple[np.ndarray, float]:
    """Simplex search for a minimum."""
    x0 = np.asarray(start, float)
    points = [x0] + [x0 + scale * np.eye(len(x0))[i] * (abs(x0[i]) if x0[i] else 1.0) for i in range(len(x0))]
    simplex = sorted(((f(p), tuple(p)) for p in points), key=lambda s: s[0])
    for _ in range(steps):
        if simplex[-1][0] - simplex[0][0] < close:
            break
        centre = np.mean([p for _, p in simplex[:-1]], axis=0)
        worst = np.asarray(simplex[-1][1])

        def at(c: float) -> tuple[float, tuple]:
            p = centre + c * (centre - worst)  # noqa: B023
            return f(p), tuple(p)

        mirrored = at(1.0)
        if mirrored[0] < simplex[0][0]:
            far = at(2.0)
            simplex[-1] = min(mirrored, far)
        elif mirrored[0] < simplex[-2][0]:
            simplex[-1] = mirrored
        else:
            near = at(0.5) if mirrored[0] < simplex[-1][0] else at(-0.5)
            if near[0] < min(mirrored[0], simplex[-1][0]):
                simplex[-1] = near
            else:
                best = np.asarray(simplex[0][1])
                simplex = [simplex[0]] + [(f(q), tuple(q)) for q in (best + 0.5 * (np.asarray(p) - best) for _, p in simplex[1:])]
        simplex.sort(key=lambda s: s[0])
    return np.asarray(simplex[0][1]), simplex[0][0]


# -- conditional variance ----------------------------------------------------------------------------------------------
def conditional_variance(e: np.ndarray, omega: float, alpha: float, beta: float, gamma: float = 0.0, start: float | None = None) -> np.ndarray:
    """Variance of each row given the rows before; ``gamma`` adds to ``alpha`` after falls."""
    rest = 1 - alpha - gamma / 2 - beta
    level = start if start is not None else (omega / rest if rest > 1e-6 else float(np.var(e)))
    news = omega + (alpha + gamma * (e[:-1] < 0)) * e[:-1] ** 2
    return np.fromiter(accumulate(news.tolist(), lambda s, x: x + beta * s, initial=level), float, len(news) + 1)[: len(e)]


def fit_garch_t(r: np.ndarray, asymmetric: bool = False, begin: dict[str, float] | None = None) -> dict[str, float]:
    """GARCH(1,1) with Student-t innovations by maximum likelihood on returns in per cent; NaN where it can't be fitted.

    ``begin``: an earlier fit whose point (``at``) the search starts from.
    """
    x = 100 * np.asarray(r, float)
    x = x[~np.isnan(x)]
    nan = dict.fromkeys(("mu", "omega", "alpha", "gamma", "beta", "nu"), math.nan)
    if len(x) < 50 or np.var(x) == 0:
        return nan
    mu0, v0 = float(np.mean(x)), float(np.var(x))

    def unpack(p: np.ndarray) -> tuple[float, ...]:
        total = 0.9999 / (1 + math.exp(-min(max(p[2], -30), 30)))
        split = 1 / (1 + math.exp(-min(max(p[3], -30), 30)))
        gamma = total * (1 - split) * 0.8 / (1 + math.exp(-min(max(p[5], -30), 30))) if asymmetric else 0.0
        return p[0], v0 * math.exp(min(max(p[1], -20), 3)), total * (1 - split) - gamma / 2, total * split, gamma, 2.05 + math.exp(min(max(p[4], -5), 5))

    def loss(p: np.ndarray) -> float:
        mu, omega, alpha, beta, gamma, nu = unpack(p)
        e = x - mu
        s2 = conditional_variance(e, omega, alpha, beta, gamma, start=v0)
        z = e * e / (s2 * (nu - 2))
        const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return -float(len(x) * const - 0.5 * np.log(s2).sum() - (nu + 1) / 2 * np.log1p(z).sum())

    p, _ = nelder_mead(loss, begin["at"] if begin and "at" in begin else [mu0, math.log(0.05), 3.0, 2.5, 1.8, *([0.0] if asymmetric else [])], steps=500, close=1e-5)
    mu, omega, alpha, beta, gamma, nu = unpack(p)
    return {"mu": mu, "omega": omega, "alpha": alpha, "gamma": gamma, "beta": beta, "nu": nu, "at": p}


def asymmetric_refits(r: np.ndarray, years: np.ndarray, first: int = YEAR) -> dict[str, np.ndarray]:
    """Conditional volatility (``vol``) and asymmetry (``gamma``) of every row: each year's rows are filtered with the parameters fitted on all rows of the years before.

    Missing while fewer than ``first`` rows lie before a year. The search of each fit starts from the fit before. ``r`` has no missing values.
    """
    vol, gamma = np.full(len(r), np.nan), np.full(len(r), np.nan)
    fit: dict | None = None
    for year in np.unique(years):
        begin, end = np.searchsorted(years, [year, year + 1])
        if begin < first:
            continue
        fit = fit_garch_t(r[:begin], asymmetric=True, begin=fit)
        if fit["mu"] == fit["mu"]:
            s2 = conditional_variance(100 * r[:end] - fit["mu"], fit["omega"], fit["alpha"], fit["beta"], fit["gamma"])
            vol[begin:end], gamma[begin:end] = np.sqrt(s2[begin:]) / 100, fit["gamma"]
    return {"gamma": gamma, "vol": vol}


def half_life(alpha: float, beta: float) -> float:
    """Rows until half of a variance shock is gone; missing unless persistence lies between 0 and 1."""
    p = alpha + beta
    return math.log(0.5) / math.log(p) if 0.0 < p < 1.0 else math.nan


# -- jump model --------------------------------------------------------------------------------------------------------
def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(-1)


def _gaps(cost: np.ndarray, penalty: float, start: float = 0.0) -> np.ndarray:
    """Of two states, how much dearer the second is at each row: the new difference plus the old one, which is never worth more than a jump."""
    steps = (cost[:, 1] - cost[:, 0]).tolist()
    walk = accumulate(steps, lambda d, x: x + (penalty if d > penalty else -penalty if d < -penalty else d), initial=start)
    return np.fromiter(walk, float, len(steps) + 1)[1:]


def forward_values(cost: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Value of each state at each row given the past: cost plus the cheaper of staying and jumping from the best state."""
    if cost.shape[1] == 2:
        d = _gaps(cost, penalty, 0.0 if start is None else float(start[1] - start[0]))
        return np.column_stack([np.maximum(-d, 0), np.maximum(d, 0)])
    v = np.empty_like(cost)
    last = np.zeros(cost.shape[1]) if start is None else np.asarray(start, float)
    for t in range(len(cost)):
        last = cost[t] + np.minimum(last, last.min() + penalty)
        last = last - last.min()
        v[t] = last
    return v


def best_path(cost: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """States of least total cost where every change of state costs ``penalty``.

    Of two states only their difference matters: where it is beyond the penalty the row's state is settled, elsewhere it
    is that of the next row; so the way back is one backward fill.
    """
    n, k = cost.shape
    if k == 2:
        d = _gaps(cost, penalty)
        settled = np.where(d > penalty, 0, np.where(d < -penalty, 1, -1))
        settled[-1] = int(d[-1] < 0)
        at = np.where(settled >= 0, np.arange(n), n - 1)
        path = settled[np.minimum.accumulate(at[::-1])[::-1]]
        return path, float(cost[np.arange(n), path].sum() + penalty * np.count_nonzero(np.diff(path)))
    came = np.zeros((n, k), dtype=int)
    value = cost[0].astype(float)
    own = np.arange(k)
    for t in range(1, n):
        cheapest = int(value.argmin())
        jump = value[cheapest] + penalty < value
        came[t] = np.where(jump, cheapest, own)
        value = cost[t] + np.where(jump, value[cheapest] + penalty, value)
    path = np.empty(n, dtype=int)
    path[-1] = int(value.argmin())
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path, float(value.min())


def fit_jump_model(x: np.ndarray, k: int = 2, penalty: float = 10.0, starts: int = 10, rounds: int = 100, seed: int = 0, reweight: int = 3) -> dict[str, np.ndarray | float]:
    """Clusters with a cost per jump: centres (in weighted space, ascending in the first feature), path, objective, feature weights.

    Alternates centres and least-cost paths from several starts, one of them at the quantiles of the first feature;
    weights then follow the separation of the centres.
    """
    x = np.asarray(x, float)
    if not np.isfinite(x).all():
        raise ValueError("a jump model needs finite features")
    rng = np.random.default_rng(seed)
    weight = np.ones(x.shape[1])
    best: tuple = ()
    for turn in range(reweight + 1):
        z = x * np.sqrt(weight)
        spread = np.quantile(z[:, 0], np.linspace(0.1, 0.9, k))
        guesses = [z[np.abs(z[:, :1] - spread).argmin(0)]] + [z[rng.choice(len(z), k, replace=False)] for _ in range(starts - 1)]
        best = ()
        for centres in guesses:
            centres = centres.copy()
            path, objective = best_path(_distances(z, centres), penalty)
            for _ in range(rounds):
                for j in np.unique(path):
                    centres[j] = z[path == j].mean(0)
                fresh, objective = best_path(_distances(z, centres), penalty)
                if (fresh == path).all():
                    break
                path = fresh
            if not best or objective < best[2]:
                best = (centres, path, objective)
        gap = np.abs(best[0].max(0) - best[0].min(0)) / np.sqrt(weight)
        if turn == reweight or len(np.unique(best[1])) < k or gap.sum() <= 0:
            break
        weight = np.maximum(gap / gap.sum() * x.shape[1], 1e-3)
    order = np.argsort(best[0][:, 0])
    return {"centres": best[0][order], "path": np.argsort(order)[best[1]], "objective": best[2], "weights": weight}


def filtered_states(x: np.ndarray, centres: np.ndarray, penalty: float, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Most likely state of each row given the past only, and the last values to chain from."""
    v = forward_values(_distances(np.asarray(x, float), centres), penalty, start)
    return v.argmin(1), (v[-1] if len(v) else np.zeros(len(centres)))


def walk_forward(r: np.ndarray, features: np.ndarray, burn: int, first: int, refit: int, grid: Sequence[float], held_out: int, k: int = 2, starts: int = 3) -> tuple[np.ndarray, list[float]]:
    """States outside the training span (-1 before), refitted every ``refit`` rows; the penalty with the best held-out Sharpe ratio is taken, the larger of equals."""
    states = np.full(len(r), -1)
    chosen: list[float] = []
    for t0 in range(burn + first, len(r), refit):
        train, gains = features[burn:t0], r[burn:t0]
        head = train[:-held_out]
        mean, dev = head.mean(0), np.where(head.std(0) > 0, head.std(0), 1.0)
        best = (-math.inf, grid[0])
        for penalty in grid:
            m = fit_jump_model((head - mean) / dev, k, penalty, starts)
            w = np.sqrt(m["weights"])
            _, last = filtered_states((head - mean) / dev * w, m["centres"], penalty)
            s, _ = filtered_states((train[-held_out:] - mean) / dev * w, m["centres"], penalty, last)
            paid = strategy_returns((k - 1 - s) / (k - 1), gains[-held_out:], 0.0)
            quality = sharpe(paid)
            if quality >= best[0]:
                best = (quality, penalty)
        mean, dev = train.mean(0), np.where(train.std(0) > 0, train.std(0), 1.0)
        m = fit_jump_model((train - mean) / dev, k, best[1], starts)
        w = np.sqrt(m["weights"])
        _, last = filtered_states((train - mean) / dev * w, m["centres"], best[1])
        block = slice(t0, min(t0 + refit, len(r)))
        states[block], _ = filtered_states((features[block] - mean) / dev * w, m["centres"], best[1], last)
        chosen.append(best[1])
    return states, chosen


# -- strategies --------------------------------------------------------------------------------------------------------
def strategy_returns(w: np.ndarray, r: np.ndarray, cash: np.ndarray | float, cost_bps: float = 10.0, delay: int = 1) -> np.ndarray:
    """Returns of weights that act ``delay`` rows later, the rest in cash, less a cost per unit traded."""
    held = np.concatenate([np.zeros(delay), np.asarray(w, float)[: len(r) - delay]]) if delay else np.asarray(w, float)
    held = np.nan_to_num(held)
    return held * r + (1 - held) * cash - np.abs(np.diff(held, prepend=0.0)) * cost_bps * 1e-4


def sharpe(r: np.ndarray) -> float:
    sd = float(np.std(r)) if len(r) else 0.0
    return float(np.mean(r)) / sd * math.sqrt(YEAR) if sd >= 1e-12 else 0.0


def vol_target(r: np.ndarray, target: float = 0.10, halflife: float = 20, cap: float = 1.0) -> np.ndarray:
    """Weight that would bring volatility to the target, between 0 and the cap; 1 where it is not known."""
    vol = ewm_std(r, halflife) * math.sqrt(YEAR)
    return np.where(np.isnan(vol) | (vol == 0), 1.0, np.clip(target / np.where(vol > 0, vol, np.nan), 0.0, cap))


# -- latent states -----------------------------------------------------------------------------------------------------
def kalman(z: np.ndarray, phi: float, q: float, noise: float) -> tuple[np.ndarray, float]:
    """Filtered level of an autoregressive level seen with noise, and the log likelihood; missing rows stay missing and don't update."""
    out = np.full(len(z), np.nan)
    seen = np.flatnonzero(np.isfinite(z))
    if not len(seen):
        return out, 0.0
    x, p, ll = float(z[seen[0]]), 1.0, 0.0
    out[seen[0]] = x
    for t in seen[1:]:
        x, p = phi * x, phi * phi * p + q
        s, gap = p + noise, z[t] - x
        ll -= 0.5 * (math.log(2 * math.pi * s) + gap * gap / s)
        x, p = x + p / s * gap, p * noise / s
        out[t] = x
    return out, ll


def fit_kalman(z: np.ndarray) -> tuple[float, float, float]:
    """Persistence, level noise and observation noise of greatest likelihood; ``z`` has no missing rows."""
    rows = np.asarray(z, float).tolist()
    free = lambda p: (1 / (1 + math.exp(-min(max(p[0], -30), 30))), math.exp(min(max(p[1], -30), 10)), math.exp(min(max(p[2], -30), 10)))

    def loss(params: np.ndarray) -> float:
        phi, q, noise = free(params)
        x, p, total = rows[0], 1.0, 0.0
        for v in rows[1:]:
            x, p = phi * x, phi * phi * p + q
            s, gap = p + noise, v - x
            total += math.log(2 * math.pi * s) + gap * gap / s
            x, p = x + p / s * gap, p * noise / s
        return 0.5 * total

    best, _ = nelder_mead(loss, [2.0, -3.0, -3.0], steps=2000, close=1e-6)
    return free(best)


def kalman_refits(z: np.ndarray, first: int, step: int) -> np.ndarray:
    """Filtered level with parameters refitted on all values so far: after the first ``first`` values, then every ``step`` rows.

    Each segment is filtered, from the start of the series on, with the parameters fitted strictly before it; the rows
    before the first segment have those of the first fit. Missing rows stay missing; fewer than ``first`` values give none.
    """
    out = np.full(len(z), np.nan)
    seen = np.flatnonzero(np.isfinite(z))
    if len(seen) < first:
        return out
    for begin in range(burn := int(seen[first - 1]) + 1, max(len(z), burn + 1), step):
        past = z[:begin]
        level = kalman(z[: begin + step], *fit_kalman(past[np.isfinite(past)]))[0]
        low = 0 if begin == burn else begin
        out[low : begin + step] = level[low:]
    return out


def hmm_log_likelihood(log_emission: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> float:
    """Log probability of a sequence under a hidden Markov model, scaled row by row."""
    total, belief = 0.0, np.asarray(initial, float)
    for row in log_emission:
        top = row.max()
        joint = belief * np.exp(row - top)
        mass = joint.sum()
        total += math.log(mass) + top
        belief = (joint / mass) @ transition
    return total


def gaussian_log_density(x: np.ndarray, means: np.ndarray, deviations: np.ndarray) -> np.ndarray:
    """Rows by states, diagonal normal densities."""
    z = (x[:, None, :] - means[None]) / deviations[None]
    return -0.5 * (z * z + np.log(2 * np.pi)).sum(-1) - np.log(deviations).sum(-1)[None]


# -- events ------------------------------------------------------------------------------------------------------------
def bernoulli_loss(u: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log likelihood of outcomes under logits."""
    return float(np.mean(np.maximum(u, 0) + np.log1p(np.exp(-np.abs(u))) - y * u))


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Logistic regression with a ridge on the slopes by Newton steps; intercept first."""
    d = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * np.eye(d.shape[1])
    penalty[0, 0] = 1e-9
    b = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ b, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(y) + penalty, d.T @ (y - p) / len(y) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b


def blocked_ridge(x: np.ndarray, y: np.ndarray, grid: Sequence[float], folds: int = 5) -> float:
    """Ridge of the logistic regression with the least loss over contiguous folds, each left out in turn."""
    edges = np.linspace(0, len(y), folds + 1).astype(int)
    loss = dict.fromkeys(grid, 0.0)
    for ridge in grid:
        for low, high in zip(edges[:-1], edges[1:]):
            b = fit_logit(np.delete(x, slice(low, high), 0), np.delete(y, slice(low, high)), ridge)
            loss[ridge] += bernoulli_loss(b[0] + x[low:high] @ b[1:], y[low:high])
    return min(grid, key=lambda ridge: loss[ridge])


def rolling_event_logit(e: np.ndarray, window: int, step: int, beta: float, grid: Sequence[float]) -> list[dict[str, float]]:
    """Logistic regression of an event on the excitation a row before: each fit on ``window`` rows is scored on the up to ``step`` rows after them.

    The ridge is chosen by blocked cross-validation within the window. ``at`` is the first row scored.
    """
    h = np.concatenate([[np.nan], excitation(e, beta)[:-1]])
    out = []
    for k, at in enumerate(range(window, len(e), step)):
        past, rest = slice(max(at - window, 1), at), slice(at, min(at + step, len(e)))
        ridge = blocked_ridge(h[past, None], e[past], grid)
        b = fit_logit(h[past, None], e[past], ridge)
        out.append({"refit": k, "at": at, "a": float(b[0]), "b": float(b[1]), "ridge": ridge, "scored": rest.stop - at, "loss": bernoulli_loss(b[0] + b[1] * h[rest], e[rest])})
    return out
