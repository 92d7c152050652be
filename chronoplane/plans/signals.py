"""Signals: composed pipelines from a panel to a descriptor frame. Each takes a panel with a ``series`` column, so all regions or feeds run at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.functions import windows as w
from chronoplane.operators import calendar
from chronoplane.operators import cross_section as xs
from chronoplane.operators import sequential as seq
from chronoplane.operators.rolling import rolling_correlations


def _percentile(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the expanding percentile of a column; rows where it is null have none."""
    valid = df.where(F.col(value).isNotNull())
    p = seq.along_series(valid, ["series"], order, [value], lambda g: {name: seq.expanding_rank(g[value].to_numpy(float))}, f"{name} double")
    return df.join(p, ["series", order], "left")


def volatility(panel: DataFrame, lam: float = 0.94, burn_in: int = 252, window: int = 1260, step: int = 63) -> DataFrame:
    """series, date, mkt_ret -> vol_annual, vol_pctile, half_life, half_life_pctile (half-life by trailing fits, carried forward)."""
    ret = panel.where("mkt_ret is not null")
    vol = seq.along_series(ret, ["series"], "date", ["mkt_ret"], lambda g: {"vol_annual": seq.ewma_vol(g["mkt_ret"].to_numpy(float), lam, burn_in)}, "vol_annual double").withColumn("vol_annual", w.finite(F.col("vol_annual")))

    def fit(g):  # noqa: ANN001, ANN202
        f = seq.fit_garch_t(g["mkt_ret"].to_numpy(float))
        return {"half_life": seq.half_life(f["alpha"], f["beta"])}

    fits = seq.windowed_refits(ret, ["series"], "date", ["mkt_ret"], window, step, fit, "half_life double", spread=True).select("series", "date", w.finite(F.col("half_life")).alias("half_life"))
    a = w.Along("series", "date")
    out = ret.select("series", "date", "mkt_ret").join(vol, ["series", "date"]).join(fits, ["series", "date"], "left").withColumn("half_life", a.fill(F.col("half_life")))
    return _percentile(_percentile(out, "date", "vol_annual", "vol_pctile"), "date", "half_life", "half_life_pctile")


def stock_bond_daily(panel: DataFrame, at_least: int = 252) -> DataFrame:
    """series, date, eq, bond -> corr_126, corr_63, corr_252, level_z, state, eq_vol; rows without corr_126 dropped."""
    a = w.Along("series", "date")
    rows = panel.where("eq is not null and bond is not null").select("series", "date", "eq", "bond")
    for k in (126, 63, 252):
        rows = rolling_correlations(rows, ["series"], "date", {f"corr_{k}": ("eq", "bond")}, k)
    rows = rows.withColumns({"level_z": a.expanding_z(F.col("corr_126"), at_least), "state": w.sign_state(F.col("corr_126"))})
    vol = seq.along_series(rows, ["series"], "date", ["eq"], lambda g: {"eq_vol": seq.ewma_vol(g["eq"].to_numpy(float))}, "eq_vol double")
    return rows.join(vol, ["series", "date"]).withColumn("eq_vol", w.finite(F.col("eq_vol"))).where("corr_126 is not null")


def stock_bond_monthly(panel: DataFrame, window: int = 24, at_least: int = 60) -> DataFrame:
    """series, month, eq, bond -> corr, level_z, level_pctile, state."""
    a = w.Along("series", "month")
    rows = panel.where("eq is not null and bond is not null").withColumn("corr", a.correlation(F.col("eq"), F.col("bond"), window))
    rows = rows.withColumns({"level_z": a.expanding_z(F.col("corr"), at_least), "state": w.sign_state(F.col("corr"))})
    return _percentile(rows, "month", "corr", "level_pctile")


def valuation(panel: DataFrame, window: int = 120, at_least: int = 240, price_lag: int = 1, earnings_lag: int = 5) -> DataFrame:
    """series, month, price, earnings, cpi -> real_price, real_earn, cape, cape_pctile, cape_z; the price index is known a month late, earnings five more; rows without cape dropped last."""
    a = w.Along("series", "month")
    rows = panel.withColumn("_cpi", a.lag(F.col("cpi"), price_lag))
    rows = rows.withColumns({"real_price": F.col("price") / F.nullif("_cpi", F.lit(0.0)), "_re": F.col("earnings") / F.nullif("_cpi", F.lit(0.0))})
    rows = rows.withColumn("_rl", a.lag(F.col("_re"), earnings_lag)).withColumn("real_earn", a.mean(F.col("_rl"), window))
    rows = rows.withColumn("cape", F.col("real_price") / F.nullif("real_earn", F.lit(0.0))).withColumn("cape_z", a.expanding_z(F.col("cape"), at_least))
    return _percentile(rows, "month", "cape", "cape_pctile").where("cape is not null").select("series", "month", "real_price", "real_earn", "cape", "cape_pctile", "cape_z")


def concentration(panel: DataFrame, at_least: int = 120) -> DataFrame:
    """series, month, entity, value -> eff_n, top_share, eff_n_pctile, eff_n_z."""
    a = w.Along("series", "month")
    rows = xs.concentration(panel, ["series", "month"], "value").drop("entities")
    return _percentile(rows.withColumn("eff_n_z", a.expanding_z(F.col("eff_n"), at_least)), "month", "eff_n", "eff_n_pctile")


def credit(panel: DataFrame, at_least: int = 120, lag_months: int = 2) -> DataFrame:
    """series, month, ebp -> as_of (two months later), obs_month, ebp, ebp_pctile, ebp_z."""
    a = w.Along("series", "month")
    rows = panel.where("ebp is not null").withColumn("ebp_z", a.expanding_z(F.col("ebp"), at_least))
    return _percentile(rows, "month", "ebp", "ebp_pctile").select("series", F.last_day(F.add_months("month", lag_months)).alias("as_of"), F.col("month").alias("obs_month"), "ebp", "ebp_pctile", "ebp_z")


def tail(panel: DataFrame, start: str = "2000-01-01", at_least: int = 252) -> DataFrame:
    """series, date, skew (100 less ten times the risk-neutral skewness) -> rn_skew, rn_skew_pctile, rn_skew_z; nothing before the start enters a rank."""
    a = w.Along("series", "date")
    rows = panel.where((F.col("date") >= start) & F.col("skew").isNotNull()).withColumn("rn_skew", (100 - F.col("skew")) / 10)
    return _percentile(rows.withColumn("rn_skew_z", a.expanding_z(F.col("rn_skew"), at_least)), "date", "rn_skew", "rn_skew_pctile")


def cross_section(panel: DataFrame, columns: list[str], window: int = 21) -> DataFrame:
    """series, date, columns -> common log volatility and each column's divergence from it."""
    a = w.Along("series", "date")
    rows = panel.select("series", "date", *[v.alias(c) for c, v in xs.log_vol(a, columns, window).items()])
    c = xs.common(columns)
    return rows.select("series", "date", c.alias("common"), *[(F.col(x) - c).alias(f"div_{x}") for x in columns])


def informativeness(descriptor: DataFrame, order: str, percentile: str, threshold: float = 0.95) -> DataFrame:
    """Adds tail_mass, inside_the_tail and share_inside_the_tail (so far)."""
    a = w.Along("series", order)
    rows = descriptor.withColumn("tail_mass", w.tail_mass(F.col(percentile)))
    inside = F.coalesce(F.col("tail_mass") <= 1.0 - threshold, F.lit(False))
    return rows.withColumn("inside_the_tail", inside).withColumn("share_inside_the_tail", a.share_true(F.col("inside_the_tail")))


def bond_total_return(yield_pct: Column, before_pct: Column, steps_a_year: int) -> Column:
    """Return of a ten-year par bond from one yield to the next: carry, duration, convexity."""
    y0, n = before_pct / 100, 20
    h, dy = y0 / 2, (yield_pct - before_pct) / 100
    fade = F.pow(1 + h, F.lit(-n))
    duration = (1 - fade) / F.nullif(h, F.lit(0.0)) / 2 / (1 + h)
    convexity = (2 / F.nullif(h * h, F.lit(0.0)) * (1 - fade) - 2 * n / F.nullif(h * F.pow(1 + h, F.lit(n + 1)), F.lit(0.0))) / 4
    return y0 / steps_a_year - duration * dy + convexity * dy * dy / 2


#: Signals by name, for harnesses that run one build over many panels.
SIGNALS: dict[str, Callable[..., DataFrame]] = {
    "volatility": volatility, "stock_bond_daily": stock_bond_daily, "stock_bond_monthly": stock_bond_monthly, "valuation": valuation,
    "concentration": concentration, "credit": credit, "tail": tail, "cross_section": cross_section, "informativeness": informativeness,
}


def run_out_of_sample(build: Callable[[DataFrame], DataFrame], panels: DataFrame) -> DataFrame:
    """One build over every series of a long panel: the series is a partition key, so regions run side by side."""
    return build(panels)


# -- gates ---------------------------------------------------------------------------------------------------------------
def gates(df: DataFrame, keys: list[str], checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Keys, ``gate``, ``passed``, ``detail`` from aggregates: one row per check; a check that can't be computed fails."""
    rows = df.groupBy(*keys).agg(F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), detail.cast("string").alias("detail")) for g, (ok, detail) in checks.items()]).alias("g"))
    return rows.select(*keys, F.inline("g"))


def month_returns(panel: DataFrame, value: str) -> DataFrame:
    """series, month, compounded return."""
    return calendar.compound_months(panel, ["series"], "date", value)
