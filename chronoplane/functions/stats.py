"""Aggregates beyond the built-in ones, as Column expressions for ``groupBy().agg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bias_corrected_skew(x: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(x: Column) -> Column:
    """Unbiased excess kurtosis; null below four values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n >= 4) & (F.var_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def quantile(x: Column, p: float) -> Column:
    return F.percentile(x, F.lit(p))


def compound(r: Column) -> Column:
    """Compounded return over a group; nulls are skipped."""
    return F.product(1 + r) - 1


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def annual_return(r: Column, periods: int = 252) -> Column:
    return F.avg(r) * periods


def annual_vol(r: Column, periods: int = 252) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(periods)))


def sharpe(r: Column, periods: int = 252) -> Column:
    """Mean over population deviation, annualised; zero where there is no spread."""
    return F.when(F.stddev_pop(r) < 1e-12, F.lit(0.0)).otherwise(F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0)) * F.sqrt(F.lit(float(periods))))


def herfindahl(s: Column) -> Column:
    return F.sum(s * s)


def precision(flag: Column, truth: Column) -> Column:
    return F.count_if(flag & truth) / F.nullif(F.count_if(flag), F.lit(0))


def recall(flag: Column, truth: Column) -> Column:
    return F.count_if(flag & truth) / F.nullif(F.count_if(truth), F.lit(0))


def balanced_accuracy(flag: Column, truth: Column) -> Column:
    return (recall(flag, truth) + recall(~flag, ~truth)) / 2


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - f, 2)))


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def brier(truth: Column, p: Column) -> Column:
    return F.avg(F.pow(truth.cast("double") - p, 2))


def log_loss(truth: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return -F.avg(F.when(truth, F.ln(q)).otherwise(F.ln(1 - q)))


def ols(y: Column, x: Column) -> dict[str, Column]:
    """Slope, intercept, R2, n and t of the slope from moments; null below three rows."""
    n, r2, b = F.regr_count(y, x).cast("double"), F.regr_r2(y, x), F.regr_slope(y, x)
    se = F.sqrt(F.regr_syy(y, x) * (1 - r2) / (n - 2) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)))
    return {"slope": b, "intercept": F.regr_intercept(y, x), "r2": r2, "n": F.regr_count(y, x), "t": F.when(n > 2, b / F.nullif(se, F.lit(0.0)))}


def fee_root(mean_a: Column, mean_b: Column, square_a: Column, square_b: Column, gamma: float) -> Column:
    """The fee per period that makes two return streams equal in quadratic utility: the root nearest zero.

    Utility of a stream r: mean(1+r) - g/(2(1+g)) * mean((1+r)^2); the fee is taken from stream a.
    """
    k = gamma / (2 * (1 + gamma))
    # k f^2 + (1 - 2k m_a) f - (U_a - U_b) = 0 with gross means m and U = m - k q
    ma, mb = 1 + mean_a, 1 + mean_b
    qa, qb = 1 + 2 * mean_a + square_a, 1 + 2 * mean_b + square_b
    ua, ub = ma - k * qa, mb - k * qb
    lin = 1 - 2 * k * ma
    return 2 * (ua - ub) / (lin + F.sqrt(lin * lin + 4 * k * (ua - ub)))
