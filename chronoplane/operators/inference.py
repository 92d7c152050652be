"""Regression and resampling inference."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplane.functions.windows import corr
from chronoplane.operators.linalg import ridge_cv


def chi2_tail(statistic: float) -> float:
    """Tail probability of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2))


def independence_ratio(df: DataFrame, keys: Sequence[str], order: str, hit: str) -> DataFrame:
    """Keys and ``lr``: likelihood ratio of a first-order Markov chain of hits against independent ones."""
    before = F.lag(hit).over(Window.partitionBy(*keys).orderBy(order))
    n = df.select(*keys, before.alias("b"), F.col(hit).alias("e")).groupBy(*keys).agg(*[F.count_if((F.col("b") == b) & (F.col("e") == e)).cast("double").alias(f"n{b}{e}") for b in (0, 1) for e in (0, 1)])
    c = F.col

    def part(k: Column, of: Column) -> Column:
        return F.when(k > 0, k * F.ln(k / F.nullif(of, F.lit(0.0)))).otherwise(F.lit(0.0))

    whole = c("n00") + c("n01") + c("n10") + c("n11")
    chain = part(c("n00"), c("n00") + c("n01")) + part(c("n01"), c("n00") + c("n01")) + part(c("n10"), c("n10") + c("n11")) + part(c("n11"), c("n10") + c("n11"))
    alone = part(c("n00") + c("n10"), whole) + part(c("n01") + c("n11"), whole)
    return n.select(*keys, (2 * (chain - alone)).alias("lr"))


def newey_west(df: DataFrame, keys: Sequence[str], order: str, y: str, x: str, lags: int) -> DataFrame:
    """Keys, ``slope``, ``intercept``, ``n``, ``t_hac``: simple regression with Bartlett-weighted errors.

    Residual products at each lag are window expressions; the sandwich follows from sums, nothing is gathered.
    """
    rows = df.where(f"{y} is not null and {x} is not null")
    fit = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("_mx"), F.regr_sxx(y, x).alias("_sxx"), F.count(F.lit(1)).alias("n"))
    e = rows.join(fit, list(keys)).withColumn("_g", (F.col(x) - F.col("_mx")) * (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)))
    along = Window.partitionBy(*keys).orderBy(order)
    weight = lambda k: 1 - k / (lags + 1)
    terms = F.col("_g") * F.col("_g")
    for k in range(1, lags + 1):
        terms = terms + 2 * weight(k) * F.coalesce(F.col("_g") * F.lag("_g", k).over(along), F.lit(0.0))
    meat = e.withColumn("_t", terms).groupBy(*keys, "slope", "intercept", "n", "_sxx").agg(F.sum("_t").alias("_s"))
    return meat.select(*keys, "slope", "intercept", "n", (F.col("slope") / F.nullif(F.sqrt(F.greatest("_s", F.lit(0.0))) / F.col("_sxx"), F.lit(0.0))).alias("t_hac"))


def stambaugh(df: DataFrame, keys: Sequence[str], order: str, ret: str, predictor: str) -> DataFrame:
    """Bias-corrected slope of ret on the lagged predictor: keys, ``slope``, ``rho``, ``bias``, ``corrected``, ``n``."""
    along = Window.partitionBy(*keys).orderBy(order)
    rows = df.where(f"{predictor} is not null").withColumn("_x", F.lag(predictor).over(along)).where(f"_x is not null and {ret} is not null")
    fit = rows.groupBy(*keys).agg(
        F.regr_slope(ret, "_x").alias("slope"), F.regr_intercept(ret, "_x").alias("_a"), F.regr_slope(predictor, "_x").alias("rho"), F.regr_intercept(predictor, "_x").alias("_b"), F.count(F.lit(1)).alias("n"))
    r = rows.join(fit, list(keys)).withColumns({"_u": F.col(ret) - F.col("_a") - F.col("slope") * F.col("_x"), "_v": F.col(predictor) - F.col("_b") - F.col("rho") * F.col("_x")})
    out = r.groupBy(*keys, "slope", "rho", "n").agg((F.covar_samp("_u", "_v") / F.nullif(F.var_samp("_v"), F.lit(0.0))).alias("_phi"))
    bias = -F.col("_phi") * (1 + 3 * F.col("rho")) / F.col("n")
    return out.select(*keys, "slope", "rho", bias.alias("bias"), (F.col("slope") - bias).alias("corrected"), "n")


def normal_equations(df: DataFrame, keys: Sequence[str], y: str, x: Sequence[str]) -> DataFrame:
    """Multivariate least squares per key: ``beta`` (intercept first), ``r2``, ``n``. The sums of products are aggregates; only a small matrix per key is solved."""
    names = ["_one", *x]
    rows = df.dropna(subset=[y, *x]).withColumn("_one", F.lit(1.0))
    cross = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(*keys).agg(F.array(*cross).alias("xx"), F.array(*[F.sum(F.col(a) * F.col(y)) for a in names]).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n"))
    k = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            beta, r2 = [], []
            for xx, xy, yy, n in zip(b["xx"], b["xy"], b["yy"], b["n"]):
                m = np.zeros((k, k))
                m[np.triu_indices(k)] = np.asarray(xx, float)
                m = m + m.T - np.diag(np.diag(m))
                if n <= k or np.linalg.matrix_rank(m) < k:
                    beta.append(None)
                    r2.append(None)
                    continue
                s = np.linalg.solve(m, np.asarray(xy, float))
                total = yy - xy[0] ** 2 / n
                beta.append(s.tolist())
                r2.append(float(1 - (yy - s @ np.asarray(xy, float)) / total) if total > 0 else None)
            yield b.drop(columns=["xx", "xy", "yy"]).assign(beta=beta, r2=r2)

    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys)
    return sums.mapInPandas(solve, f"{kinds}, n long, beta array<double>, r2 double")


def variance_inflation(df: DataFrame, keys: Sequence[str], x: Sequence[str]) -> DataFrame:
    """Per key ``n`` and ``vif``, for each column the inverse of the share of its variance that all others leave; null where they leave none. Moments are aggregates; only a small matrix per key is inverted."""
    rows = df.dropna(subset=list(x))
    cells = [corr(F.col(a), F.col(b)) for i, a in enumerate(x) for b in x[i + 1 :]]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("r"))
    k = len(x)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b["r"]:
                m = np.eye(k)
                m[np.triu_indices(k, 1)] = np.asarray(r, float)
                m = np.triu(m) + np.triu(m, 1).T
                out.append(np.diag(np.linalg.inv(m)).tolist() if np.isfinite(m).all() and np.linalg.matrix_rank(m) == k else None)
            yield b.drop(columns="r").assign(vif=out)

    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys)
    return sums.mapInPandas(solve, f"{kinds}, n long, vif array<double>")


def _r2(y: np.ndarray, x: np.ndarray) -> float:
    d = np.column_stack([np.ones(len(y)), x])
    e = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - (e @ e) / total) if total > 0 else float("nan")


def placebo_gain(y: np.ndarray, base: np.ndarray, extra: np.ndarray, n: int, rng: np.random.Generator) -> tuple[float, float]:
    """Gain in R2 by ``extra`` over ``base``, and its p: the share of ``n`` placebos, first-order autoregressions with the memory and spread of ``extra``, that gain as much."""
    z = extra - extra.mean()
    below = float(z[:-1] @ z[:-1])
    memory = min(max(float(z[1:] @ z[:-1]) / below, -0.999), 0.999) if below > 0 else 0.0
    spread = float((z[1:] - memory * z[:-1]).std())
    plain = _r2(y, base)
    gain = _r2(y, np.column_stack([base, extra])) - plain
    hits = 0
    for _ in range(n):
        shock = rng.normal(0, spread, len(y))
        shock[0] /= np.sqrt(1 - memory * memory)
        path = np.fromiter(accumulate(shock.tolist(), lambda s, e: memory * s + e), float, len(y))
        hits += _r2(y, np.column_stack([base, path])) - plain >= gain
    return gain, (hits + 1) / (n + 1)


def _hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cubic spline basis that is linear beyond the outer knots."""
    cube = lambda k: np.maximum(x - k, 0.0) ** 3
    last, before = knots[-1], knots[-2]
    tail = lambda k: (cube(k) - cube(last)) / (last - k)
    return np.column_stack([x, *[tail(k) - tail(before) for k in knots[:-2]]])


def spline_score(x: np.ndarray, y: np.ndarray, x_new: np.ndarray, y_new: np.ndarray) -> float:
    """Mean squared error on new rows of a natural cubic spline with knots at five quantiles, penalty by leave-one-out error."""
    knots = np.unique(np.quantile(x, (0.05, 0.275, 0.5, 0.725, 0.95)))
    if len(knots) < 3:
        return float(((y_new - y.mean()) ** 2).mean())
    centre, scale = x.mean(), x.std()
    z, k = (x - centre) / scale, (knots - centre) / scale
    _, b = ridge_cv(_hinges(z, k), y)
    return float(((y_new - b[0] - _hinges((x_new - centre) / scale, k) @ b[1:]) ** 2).mean())


def logit_score(x: np.ndarray, y: np.ndarray, x_new: np.ndarray, y_new: np.ndarray, ridge: float = 1e-3) -> float:
    """Mean negative log likelihood on new rows of a logistic regression on one standardised column."""
    centre, scale = x.mean(), x.std()
    d = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ b))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * len(x) * np.diag([0.0, 1.0]) + 1e-12 * np.eye(2), d.T @ (y - p) - ridge * len(x) * np.array([0.0, b[1]]))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    u = b[0] + b[1] * (x_new - centre) / scale
    return float(np.mean(np.maximum(u, 0) + np.log1p(np.exp(-np.abs(u))) - y_new * u))


def replicates(spark: SparkSession, n: int, statistic: Callable[[np.random.Generator], float], seed: int = 0, slices: int | None = None) -> DataFrame:
    """``rep`` and ``value`` of a resampled statistic; the generator is seeded by replicate, so partitions don't matter.

    ``statistic`` closes over its (small, documented) sample; the replicates are spread over the cluster.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rep": b["id"], "value": [float(statistic(np.random.default_rng([seed, int(i)]))) for i in b["id"]]})

    return spark.range(0, n, 1, slices or spark.sparkContext.defaultParallelism).mapInPandas(run, "rep long, value double")


def stationary_index(rng: np.random.Generator, n: int, block: float) -> np.ndarray:
    """Row numbers of one stationary bootstrap sample with geometric blocks of mean length ``block``."""
    starts = rng.random(n) < 1 / block
    starts[0] = True
    picks = rng.integers(0, n, n)
    at = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    return (picks[at] + np.arange(n) - at) % n


def block_index(rng: np.random.Generator, n: int, block: int) -> np.ndarray:
    """Row numbers of one moving-block bootstrap sample."""
    starts = rng.integers(0, max(1, n - block + 1), -(-n // block))
    return (starts[:, None] + np.arange(min(block, n))).ravel()[:n]


def block_permutation(rng: np.random.Generator, n: int, block: int) -> np.ndarray:
    """Row numbers with whole blocks in random order."""
    blocks = [np.arange(i, min(i + block, n)) for i in range(0, n, block)]
    return np.concatenate([blocks[i] for i in rng.permutation(len(blocks))]) if n else np.arange(0)


def null_slope_p(level: np.ndarray, r: np.ndarray, paths: int, block: int, rng: np.random.Generator) -> tuple[float, float]:
    """Slope of the next return on the level, and how often paths without predictability reach it in its direction: (hits + 1) / (paths + 1).

    Blocks of joint residuals are drawn; the level is rebuilt from its own recursion. Missing under 27 rows or without spread.
    """
    n = len(r)
    if n < 27 or np.ptp(level[:-1]) == 0:
        return math.nan, math.nan
    slope = float(np.polyfit(level[:-1], r[1:], 1)[0])
    rho, c = np.polyfit(level[:-1], level[1:], 1)
    v, mean = level[1:] - c - rho * level[:-1], r[1:].mean()
    u = r[1:] - mean
    starts = rng.integers(0, max(1, len(u) - block + 1), (paths, -(-n // min(block, len(u))), 1))
    draws = (starts + np.arange(min(block, len(u)))).reshape(paths, -1)[:, :n]
    x = np.empty((paths, n))
    x[:, 0] = level[0]
    for t in range(1, n):
        x[:, t] = c + rho * x[:, t - 1] + v[draws[:, t]]
    x = x[:, :-1] - x[:, :-1].mean(1, keepdims=True)
    found = (x * (mean + u[draws[:, 1:]])).sum(1) / np.maximum((x * x).sum(1), 1e-300)
    hits = int((found <= slope).sum() if slope < 0 else (found >= slope).sum())
    return slope, (hits + 1) / (paths + 1)


def permutation_p(x: np.ndarray, y: np.ndarray, times: int, block: int, rng: np.random.Generator) -> tuple[float, float]:
    """Correlation of two series, and how often it is as far from zero with the blocks of ``y`` in random order: (hits + 1) / (times + 1)."""
    if len(x) < 2 * block or np.ptp(x) == 0 or np.ptp(y) == 0:
        return math.nan, math.nan
    a, b = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    rho = float(a @ b) / len(a)
    hits = sum(abs(float(a @ b[block_permutation(rng, len(b), block)])) / len(a) >= abs(rho) for _ in range(times))
    return rho, (hits + 1) / (times + 1)


def phase_surrogate(rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
    """Series of the same spectrum with random phases."""
    f = np.fft.rfft(x - x.mean())
    phase = rng.uniform(0, 2 * np.pi, len(f))
    phase[0] = 0
    if len(x) % 2 == 0:
        phase[-1] = 0
    return np.fft.irfft(np.abs(f) * np.exp(1j * (np.angle(f) * 0 + phase)), len(x)) + x.mean()
