"""Recursive estimators (R), ranks (W5), regression and resampling (I) along the feeds of the daily panel."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplane.functions import stats
from chronoplane.functions import windows as w
from chronoplane.operators import inference, linalg
from chronoplane.operators import sequential as q
from chronoplane.plans.panels import bonds, bonds_sql, daily, daily_sql
from chronoplane.plans.registry import query, r6, s6
from chronoplane.plans.window_queries import EVER, SEQ, A, ahead, guarded

ORDERED = f"n AS (SELECT source_id, date, mkt_ret, row_number() {SEQ} AS i FROM p WHERE mkt_ret > -1 AND mkt_ret < 1)"


def returns(spark: SparkSession, folder: str) -> DataFrame:
    """Plausible market returns without gaps in the numbering."""
    return daily(spark, folder, "mkt_ret").where("mkt_ret > -1 and mkt_ret < 1")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """By key into as many partitions as shuffles have: small rows, long work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _nan_to_null(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(F.col(c), digits) for c in columns})


@query(f"""WITH RECURSIVE {daily_sql('mkt_ret')}, {ORDERED}, s AS (SELECT source_id, var_pop(mkt_ret) AS v FROM n WHERE i <= 252 GROUP BY ALL),
e AS (SELECT source_id, 252::BIGINT AS i, v FROM s UNION ALL SELECT e.source_id, n.i, 0.94 * e.v + 0.06 * n.mkt_ret * n.mkt_ret FROM e JOIN n ON n.source_id = e.source_id AND n.i = e.i + 1)
SELECT n.source_id, n.date, {s6('sqrt(e.v * 252)')} AS vol FROM n LEFT JOIN e ON e.source_id = n.source_id AND e.i = n.i AND e.i > 252""")
def r1_ewma_vol(spark: SparkSession, folder: str) -> DataFrame:
    out = q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], lambda g: {"vol": q.ewma_vol(g["mkt_ret"].to_numpy(float))}, "vol double")
    return _nan_to_null(out, "vol")


@query(f"""WITH {daily_sql('bond10_ret')}, n AS (SELECT source_id, date, bond10_ret AS x, row_number() {SEQ} AS i FROM p WHERE bond10_ret IS NOT NULL)
SELECT a.source_id, a.date, {s6('(count(*) FILTER (b.x < a.x) + (count(*) FILTER (b.x = a.x) + 1) / 2) / count(*)', 12)} AS pctile FROM n a JOIN n b ON a.source_id = b.source_id AND b.i <= a.i GROUP BY a.source_id, a.date""")
def w5_expanding_percentile(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder, "bond10_ret").where("bond10_ret is not null")
    out = q.along_series(rows, ["source_id"], "date", ["bond10_ret"], lambda g: {"pctile": q.expanding_rank(g["bond10_ret"].to_numpy(float))}, "pctile double")
    return _nan_to_null(out, "pctile", digits=12)


_W = "exp(-ln(2) / {h} * (a.i - b.i))"
_EWM = "sum({w} * {y}) / sum({w})"


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED} SELECT a.source_id, a.date,
{s6('sqrt(' + _EWM.format(w=_W.format(h=10), y='pow(least(b.mkt_ret, 0), 2)') + ')')} AS dd10, {s6('(' + _EWM.format(w=_W.format(h=20), y='b.mkt_ret') + ') / nullif(sqrt(' + _EWM.format(w=_W.format(h=20), y='pow(least(b.mkt_ret, 0), 2)') + '), 0)', 5)} AS sortino20
FROM n a JOIN n b ON a.source_id = b.source_id AND b.i <= a.i GROUP BY a.source_id, a.date""")
def r2_downside_features(spark: SparkSession, folder: str) -> DataFrame:
    out = q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], lambda g: q.downside_features(g["mkt_ret"].to_numpy(float)), "dd10 double, sortino20 double, sortino60 double")
    return out.select("source_id", "date", r6(F.col("dd10")).alias("dd10"), r6(F.col("sortino20"), 5).alias("sortino20"))


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, m AS (SELECT a.source_id, a.date, a.i, sum({_W.format(h=20)}) AS w1, sum(pow({_W.format(h=20)}, 2)) AS w2, sum({_W.format(h=20)} * b.mkt_ret) AS s, sum({_W.format(h=20)} * b.mkt_ret * b.mkt_ret) AS q
FROM n a JOIN n b ON a.source_id = b.source_id AND b.i <= a.i GROUP BY ALL) SELECT source_id, date, {s6('CASE WHEN i > 1 THEN sqrt(greatest(q / w1 - pow(s / w1, 2), 0) * w1 * w1 / (w1 * w1 - w2)) END')} AS ewm_std FROM m""")
def r3_ewm_std(spark: SparkSession, folder: str) -> DataFrame:
    out = q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], lambda g: {"ewm_std": q.ewm_std(g["mkt_ret"].to_numpy(float), 20)}, "ewm_std double")
    return _nan_to_null(out, "ewm_std")


def _garch(g: pd.DataFrame) -> dict:
    fit = q.fit_garch_t(g["mkt_ret"].to_numpy(float))
    return {"persistence": fit["alpha"] + fit["beta"], "half_life": q.half_life(fit["alpha"], fit["beta"])}


@query()
def r4_shock_half_life(spark: SparkSession, folder: str) -> DataFrame:
    """Half-life of a volatility shock from trailing fits of 1,260 rows, every 63; each fit is a group of its own."""
    out = q.windowed_refits(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], 1260, 63, _garch, "persistence double, half_life double", spread=True)
    return _nan_to_null(out, "persistence", "half_life")


def _gjr(g: pd.DataFrame) -> dict:
    return q.asymmetric_refits(g["mkt_ret"].to_numpy(float), pd.to_datetime(g["date"]).dt.year.to_numpy())


@query()
def r5_asymmetric_refits(spark: SparkSession, folder: str) -> DataFrame:
    """Asymmetric conditional volatility of every day, parameters refitted on all rows up to the end of the year before; null while these are under 252."""
    out = q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], _gjr, "gamma double, vol double", spread=True)
    return _nan_to_null(out, "gamma", "vol")


@query()
def r5_full_sample(spark: SparkSession, folder: str) -> DataFrame:
    """One symmetric fit on all rows of each feed: news, persistence and half-life of a shock (of the whole span, on purpose not causal)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        fit = q.fit_garch_t(g.sort_values("date")["mkt_ret"].to_numpy(float))
        return pd.DataFrame([{"source_id": g["source_id"].iloc[0], "n": len(g), "alpha": fit["alpha"], "beta": fit["beta"], "half_life": q.half_life(fit["alpha"], fit["beta"])}])

    return _nan_to_null(_spread(returns(spark, folder), "source_id").groupBy("source_id").applyInPandas(run, "source_id string, n long, alpha double, beta double, half_life double"), "alpha", "beta", "half_life")


def _features(r: np.ndarray) -> np.ndarray:
    f = q.downside_features(r)
    return np.column_stack([f["dd10"], f["sortino20"], f["sortino60"]])


def _jump(g: pd.DataFrame) -> dict:
    r = g["mkt_ret"].to_numpy(float)
    state = np.full(len(r), np.nan)
    burn = 63
    x = _features(r)[burn:] if len(r) > 2 * burn else np.empty((0, 3))
    if len(x) and np.isfinite(x).all() and (x.std(0) > 0).all():
        z = (x - x.mean(0)) / x.std(0)
        state[burn:] = q.fit_jump_model(z, 2, 25.0, starts=10)["path"]
    return {"state": state}


@query()
def r6_jump_model(spark: SparkSession, folder: str) -> DataFrame:
    """Two-state jump model per feed on downside features (63 rows of burn-in); state 1 is the stressed one."""
    return q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], _jump, "state double").withColumn("state", F.when(~F.isnan("state"), F.col("state").cast("int")))


#: Penalties, rows before the first refit, rows between refits, rows held out to choose the penalty, starts of each fit.
PENALTIES, FIRST, REFIT, HELD_OUT, STARTS = (10.0, 25.0, 50.0, 100.0, 200.0, 400.0, 800.0), 1_260, 252, 1_008, 5


def _walk(g: pd.DataFrame) -> dict:
    r = g["mkt_ret"].to_numpy(float)
    state = np.full(len(r), -1)
    if len(r) > 63 + FIRST:
        x = _features(r)
        if np.isfinite(x[63:]).all():
            state, _ = q.walk_forward(r, x, 63, FIRST, REFIT, PENALTIES, HELD_OUT, starts=STARTS)
    return {"state": state}


@query()
def r7_walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-sample states with yearly refits on the expanding history and a penalty chosen on the last 1,008 rows of it; -1 before the first refit, and so for all rows of feeds up to 1,323 rows."""
    return q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], _walk, "state int")


@query(f"""WITH RECURSIVE {daily_sql('mkt_ret')}, {ORDERED}, x AS (SELECT source_id, date, i, exp(sum(ln(1 + mkt_ret)) {SEQ}) AS px FROM n),
w AS (SELECT source_id, i, true AS rising, 1::BIGINT AS best, px AS top, NULL::BIGINT AS since, NULL::INT AS phase FROM x WHERE i = 1
UNION ALL SELECT w.source_id, x.i, CASE WHEN turn THEN NOT rising ELSE rising END, CASE WHEN better OR turn THEN x.i ELSE best END, CASE WHEN better OR turn THEN px ELSE top END, CASE WHEN turn THEN best + 1 END, CASE WHEN turn THEN rising::INT END
FROM (SELECT w.*, x.i AS j, x.px AS v, (x.px > top) = rising AND x.px <> top AS better, CASE WHEN rising THEN x.px / top - 1 <= -0.2 ELSE x.px / top - 1 >= 0.2 END AS turn FROM w JOIN x ON x.source_id = w.source_id AND x.i = w.i + 1) w JOIN x ON x.source_id = w.source_id AND x.i = w.j),
t AS (SELECT source_id, since, phase FROM w WHERE since IS NOT NULL)
SELECT x.source_id, x.date, coalesce(max_by(t.phase, t.since), 0) AS phase FROM x LEFT JOIN t ON t.source_id = x.source_id AND t.since <= x.i GROUP BY ALL""")
def r8_bull_bear(spark: SparkSession, folder: str) -> DataFrame:
    return q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], lambda g: {"phase": q.bull_bear(np.cumprod(1 + g["mkt_ret"].to_numpy(float)))}, "phase int")


@query()
def r9_kalman_level(spark: SparkSession, folder: str) -> DataFrame:
    """Filtered yield level per feed; parameters refitted on the expanding history, after 24 months and then every 12 rows."""
    out = q.along_series(bonds(spark, folder, "jp_y10"), ["source_id"], "month", ["jp_y10"], lambda g: {"level": q.kalman_refits(g["jp_y10"].to_numpy(float), 24, 12)}, "level double", spread=True)
    return _nan_to_null(out, "level")


@query(f"""WITH RECURSIVE {daily_sql('mkt_ret')}, {ORDERED}, h AS (SELECT source_id, i, (mkt_ret < -0.02)::INT::DOUBLE AS h FROM n WHERE i = 1
UNION ALL SELECT h.source_id, n.i, exp(-0.1) * h.h + (n.mkt_ret < -0.02)::INT FROM h JOIN n ON n.source_id = h.source_id AND n.i = h.i + 1) SELECT n.source_id, n.date, {s6('h.h')} AS excitation FROM n JOIN h USING (source_id, i)""")
def r10_excitation(spark: SparkSession, folder: str) -> DataFrame:
    out = q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], lambda g: {"excitation": q.excitation((g["mkt_ret"].to_numpy(float) < -0.02).astype(float), 0.1)}, "excitation double")
    return _nan_to_null(out, "excitation")


@query()
def r11_event_logit(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of a fall given excitation: rolling-origin refits on 252 rows, ridge by blocked cross-validation, and the loss over the up to 63 rows after each."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date").reset_index(drop=True)
        fits = q.rolling_event_logit((g["mkt_ret"].to_numpy(float) < -0.02).astype(float), 252, 63, 0.1, (1e-4, 1e-3, 1e-2, 1e-1))
        columns = ["source_id", "refit", "date", "a", "b", "ridge", "scored", "loss"]
        return pd.DataFrame([{**f, "source_id": g["source_id"].iloc[0], "date": g["date"].iloc[f["at"]]} for f in fits], columns=columns)

    out = _spread(returns(spark, folder), "source_id").groupBy("source_id").applyInPandas(run, "source_id string, refit int, date date, a double, b double, ridge double, scored int, loss double")
    return _nan_to_null(out, "a", "b", "loss")


def _hmm(g: pd.DataFrame) -> pd.DataFrame:
    x = g.sort_values("date")["mkt_ret"].to_numpy(float)[:, None]
    s = x.std() or 1.0
    log = q.gaussian_log_density(x, np.array([[x.mean()], [x.mean()]]), np.array([[0.7 * s], [1.8 * s]]))
    sticky = np.array([[0.98, 0.02], [0.05, 0.95]])
    return pd.DataFrame([{"source_id": g["source_id"].iloc[0], "loglik": q.hmm_log_likelihood(log, sticky, np.array([0.5, 0.5])), "wide_share": float((log.argmax(1) == 1).mean())}])


@query(f"""WITH RECURSIVE {daily_sql('mkt_ret')}, {ORDERED}, m AS (SELECT source_id, avg(mkt_ret) AS m, coalesce(nullif(stddev_pop(mkt_ret), 0), 1) AS s FROM n GROUP BY ALL),
d AS (SELECT source_id, i, -0.5 * (pow((mkt_ret - m) / (0.7 * s), 2) + ln(2 * pi())) - ln(0.7 * s) AS a, -0.5 * (pow((mkt_ret - m) / (1.8 * s), 2) + ln(2 * pi())) - ln(1.8 * s) AS b FROM n JOIN m USING (source_id)),
e AS (SELECT source_id, i, greatest(a, b) AS top, exp(a - greatest(a, b)) AS p, exp(b - greatest(a, b)) AS q, b > a AS wide FROM d),
h AS (SELECT source_id, i, ln(0.5 * p + 0.5 * q) + top AS total, p / (p + q) AS x, q / (p + q) AS y FROM e WHERE i = 1
UNION ALL SELECT h.source_id, e.i, h.total + ln((0.98 * x + 0.05 * y) * p + (0.02 * x + 0.95 * y) * q) + top, (0.98 * x + 0.05 * y) * p / ((0.98 * x + 0.05 * y) * p + (0.02 * x + 0.95 * y) * q), (0.02 * x + 0.95 * y) * q / ((0.98 * x + 0.05 * y) * p + (0.02 * x + 0.95 * y) * q)
FROM h JOIN e ON e.source_id = h.source_id AND e.i = h.i + 1)
SELECT source_id, {s6('max_by(total, i)')} AS loglik, {s6('w')} AS wide_share FROM h JOIN (SELECT source_id, avg(wide::INT) AS w FROM e GROUP BY ALL) USING (source_id) GROUP BY source_id, w""")
def r12_hidden_states(spark: SparkSession, folder: str) -> DataFrame:
    """Log likelihood under a fixed sticky two-state model, and the share of rows nearer the wide state by emission alone."""
    return _nan_to_null(returns(spark, folder).groupBy("source_id").applyInPandas(_hmm, "source_id string, loglik double, wide_share double"), "loglik", "wide_share")


@query(f"""WITH RECURSIVE {daily_sql('gold_ret')}, n AS (SELECT source_id, date, gold_ret AS x, row_number() {SEQ} AS i FROM p),
e AS (SELECT source_id, i, x AS v FROM n WHERE i = 1 UNION ALL SELECT e.source_id, n.i, CASE WHEN n.x IS NULL THEN e.v WHEN e.v IS NULL THEN n.x ELSE 0.94 * e.v + 0.06 * n.x END FROM e JOIN n ON n.source_id = e.source_id AND n.i = e.i + 1)
SELECT n.source_id, n.date, {s6('e.v', 9)} AS level FROM n JOIN e USING (source_id, i)""")
def r13_carried_smoothing(spark: SparkSession, folder: str) -> DataFrame:
    out = q.along_series(daily(spark, folder, "gold_ret"), ["source_id"], "date", ["gold_ret"], lambda g: {"level": q.smoothed(g["gold_ret"].to_numpy(float))}, "level double")
    return _nan_to_null(out, "level", digits=9)


_TREND = f"""t AS (SELECT source_id, date, last_day(date) AS month, mkt_ret, sum(ln(1 + mkt_ret)) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS mom, count(*) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS k,
stddev_samp(mkt_ret) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) * sqrt(252) AS vol FROM n),
me AS (SELECT source_id, month, max_by(CASE WHEN k = 126 AND vol > 0 THEN sign(round(mom, 12)) * least(0.4 / vol, 2.0) END, date) AS pos FROM t GROUP BY ALL)"""


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, {_TREND} SELECT t.source_id, t.date, {s6('me.pos * t.mkt_ret', 8)} AS trend_ret FROM t JOIN me ON t.source_id = me.source_id AND last_day((t.month - INTERVAL 1 MONTH)::DATE) = me.month""")
def r14_trend_proxy(spark: SparkSession, folder: str) -> DataFrame:
    """Sign of half a year's move times a capped inverse volatility, set at month end, earned in the month after."""
    r = F.col("mkt_ret")
    rows = returns(spark, folder).withColumns({"month": F.last_day("date"), "mom": A.total(F.ln(1 + r), 126), "vol": F.stddev_samp(r).over(A.last(63)) * F.sqrt(F.lit(252.0))})
    pos = F.when(F.col("vol") > 0, F.signum(F.round("mom", 12)) * F.least(F.lit(0.4) / F.nullif("vol", F.lit(0.0)), F.lit(2.0)))
    ends = rows.groupBy("source_id", "month").agg(F.max_by(F.struct(pos.alias("p")), "date").alias("e"))
    effective = ends.select("source_id", F.last_day(F.add_months("month", 1)).alias("month"), F.col("e.p").alias("pos"))
    return rows.join(effective, ["source_id", "month"]).select("source_id", "date", r6(F.col("pos") * r, 8).alias("trend_ret"))


_SMA = f"""px AS (SELECT source_id, date, mkt_ret, i, exp(sum(ln(1 + mkt_ret)) {SEQ}) AS px FROM n), sw AS (SELECT *, CASE WHEN i < 50 THEN 1.0 ELSE (round(px, 9) > round(avg(px) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9))::INT END AS w FROM px)"""


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, {_SMA}, h AS (SELECT *, coalesce(lag(w) {SEQ}, 0) AS held FROM sw) SELECT source_id, date, w::DOUBLE AS weight, {s6(f'held * mkt_ret - abs(held - coalesce(lag(held) {SEQ}, 0)) * 0.001', 9)} AS strategy_ret FROM h""")
def r15_r16_strategy_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Weight 1 above the mean price of 50 rows, acting a row later, less 10 basis points on what is traded."""
    r = F.col("mkt_ret")
    rows = returns(spark, folder).withColumns({"i": A.number(), "px": F.exp(F.sum(F.ln(1 + r)).over(A.ever()))})
    rows = rows.withColumn("w", F.when(F.col("i") < 50, F.lit(1.0)).otherwise((F.round("px", 9) > F.round(F.avg("px").over(A.last(50)), 9)).cast("double")))
    rows = rows.withColumn("held", F.coalesce(A.lag(F.col("w")), F.lit(0.0)))
    return rows.select("source_id", "date", F.col("w").alias("weight"), r6(F.col("held") * r - F.abs(F.col("held") - F.coalesce(A.lag(F.col("held")), F.lit(0.0))) * 0.001, 9).alias("strategy_ret"))


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, m AS (SELECT a.source_id, a.date, a.i, sum({_W.format(h=20)}) AS w1, sum(pow({_W.format(h=20)}, 2)) AS w2, sum({_W.format(h=20)} * b.mkt_ret) AS s, sum({_W.format(h=20)} * b.mkt_ret * b.mkt_ret) AS q
FROM n a JOIN n b ON a.source_id = b.source_id AND b.i <= a.i GROUP BY ALL), v AS (SELECT source_id, date, CASE WHEN i > 1 THEN sqrt(greatest(q / w1 - pow(s / w1, 2), 0) * w1 * w1 / (w1 * w1 - w2) * 252) END AS v FROM m)
SELECT source_id, date, {s6('CASE WHEN v > 1e-9 THEN greatest(least(0.1 / v, 1), 0) ELSE 1 END', 5)} AS weight FROM v""")
def r16_vol_target(spark: SparkSession, folder: str) -> DataFrame:
    return _nan_to_null(q.along_series(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], lambda g: {"weight": q.vol_target(g["mkt_ret"].to_numpy(float))}, "weight double"), "weight", digits=5)


def _deepest(k: int) -> str:
    """The deepest fall ``t{k}`` of what earlier ones left, from its peak to the return there, and what it leaves (``l{k}``)."""
    return f""", m{k} AS (SELECT source_id, min_by(i, struct_pack(f := fall, i := i)) AS low, min(fall) AS depth FROM l{k - 1} GROUP BY source_id HAVING min(fall) < 0),
a{k} AS (SELECT m.*, l.pk AS was FROM m{k} m JOIN l{k - 1} l ON l.source_id = m.source_id AND l.i = m.low),
t{k} AS (SELECT a.source_id, low, depth, max(i) FILTER (i <= low AND eq = was) AS top, coalesce(min(i) FILTER (i >= low AND eq >= was), max(i)) AS fin FROM a{k} a JOIN l{k - 1} l ON l.source_id = a.source_id GROUP BY a.source_id, low, depth),
l{k} AS (SELECT l.source_id, l.date, l.i, l.eq, l.pk, CASE WHEN l.i BETWEEN t.top AND t.fin THEN 0 ELSE l.fall END AS fall FROM l{k - 1} l LEFT JOIN t{k} t ON t.source_id = l.source_id)"""


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, e AS (SELECT source_id, date, i, exp(sum(ln(1 + mkt_ret)) {SEQ}) AS eq FROM n), l0 AS (SELECT *, eq / pk - 1 AS fall FROM (SELECT *, max(eq) {SEQ} AS pk FROM e)){''.join(map(_deepest, range(1, 6)))},
u AS ({' UNION ALL '.join(f'SELECT * FROM t{k}' for k in range(1, 6))})
SELECT u.source_id, row_number() OVER (PARTITION BY u.source_id ORDER BY depth, low)::INT AS place, a.date AS peak, b.date AS trough, c.date AS end, {s6('depth', 9)} AS depth FROM u JOIN n a ON a.source_id = u.source_id AND a.i = u.top JOIN n b ON b.source_id = u.source_id AND b.i = u.low JOIN n c ON c.source_id = u.source_id AND c.i = u.fin""")
def w18_drawdown_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """The five deepest falls of each feed."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        rows = q.drawdown_episodes(g["date"].tolist(), g["mkt_ret"].to_numpy(float))
        return pd.DataFrame([(g["source_id"].iloc[0], i + 1, *e) for i, e in enumerate(rows)], columns=["source_id", "place", "peak", "trough", "end", "depth"])

    return _nan_to_null(returns(spark, folder).groupBy("source_id").applyInPandas(run, "source_id string, place int, peak date, trough date, end date, depth double"), "depth", digits=9)


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, v AS (SELECT source_id, date, {guarded('stddev_samp', 'mkt_ret', 20)} AS v FROM n), r AS (SELECT source_id, date, CASE WHEN count(v) {EVER} >= 20 THEN (v > avg(v) {EVER})::INT::DOUBLE END AS raw FROM v),
g AS (SELECT *, sum(c) {SEQ} AS run FROM (SELECT *, CASE WHEN raw IS DISTINCT FROM lag(raw) {SEQ} THEN 1 ELSE 0 END AS c FROM r)), l AS (SELECT source_id, date, raw, row_number() OVER (PARTITION BY source_id, run ORDER BY date) AS k FROM g)
SELECT source_id, date, coalesce(last_value(CASE WHEN k >= 5 THEN raw END IGNORE NULLS) {EVER}, first_value(raw IGNORE NULLS) {EVER}) AS held FROM l""")
def w25_hysteresis(spark: SparkSession, folder: str) -> DataFrame:
    """High-volatility flag that changes only after five rows in a row."""
    rows = returns(spark, folder).withColumn("v", A.std(F.col("mkt_ret"), 20)).withColumn("raw", (F.col("v") > A.expanding(F.avg, F.col("v"), 20)).cast("double"))
    return q.along_series(rows, ["source_id"], "date", ["raw"], lambda g: {"held": q.hysteresis(g["raw"].to_numpy(float), 5)}, "held double").withColumn("held", r6(F.col("held")))


_FOUR = ["ind_nodur", "ind_enrgy", "ind_hitec", "ind_hlth"]


@query()
def w29_absorption_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the largest eigenvalue of the correlation matrix of the 63 rows before each 21st row."""

    def run(g: pd.DataFrame) -> dict:
        x = g[_FOUR].to_numpy(float)
        x = x[np.isfinite(x).all(1)]
        ok = len(x) > 21 and (x.std(0) > 0).all()
        return {"absorption": linalg.absorption_ratio(np.corrcoef(x.T), 0.25) if ok else np.nan}

    return _nan_to_null(q.windowed_refits(daily(spark, folder, *_FOUR), ["source_id"], "date", _FOUR, 63, 21, run, "absorption double"), "absorption")


# -- regression --------------------------------------------------------------------------------------------------------
_PAIR = f"f AS (SELECT source_id, date, CASE WHEN count(mkt_ret) {ahead(21)} = 21 THEN sum(mkt_ret) {ahead(21)} END AS y, {guarded('stddev_samp', 'mkt_ret', 21)} AS x FROM n), g AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL)"


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Next month's return against trailing volatility."""
    r = F.col("mkt_ret")
    return returns(spark, folder).select("source_id", "date", A.forward_sum(r, 21).alias("y"), A.std(r, 21).alias("x")).where("x is not null and y is not null")


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, {_PAIR} SELECT source_id, regr_count(y, x)::BIGINT AS n, {s6('regr_slope(y, x)', 5)} AS slope, {s6('regr_r2(y, x)')} AS r2,
{s6('regr_slope(y, x) / nullif(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (regr_count(y, x) - 2) / nullif(regr_sxx(y, x), 0)), 0)', 5)} AS t FROM g GROUP BY ALL HAVING regr_count(y, x) >= 87""")
def i1_ols(spark: SparkSession, folder: str) -> DataFrame:
    fit = stats.ols(F.col("y"), F.col("x"))
    out = pairs(spark, folder).groupBy("source_id").agg(*[v.alias(k) for k, v in fit.items()]).where("n >= 87")
    return out.select("source_id", "n", r6(F.col("slope"), 5).alias("slope"), r6(F.col("r2")).alias("r2"), r6(F.col("t"), 5).alias("t"))


_LAGS = " + ".join(f"2 * (1 - {k} / 22.0) * coalesce(g * lag(g, {k}) {SEQ}, 0)" for k in range(1, 22))


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, {_PAIR}, b AS (SELECT source_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS c, avg(x) AS m, regr_sxx(y, x) AS sxx, count(*) AS n FROM g GROUP BY ALL),
e AS (SELECT source_id, date, s, sxx, n, (x - m) * (y - c - s * x) AS g FROM g JOIN b USING (source_id)), l AS (SELECT source_id, s, sxx, n, g * g + {_LAGS} AS t FROM e)
SELECT source_id, n, {s6('s', 5)} AS slope, {s6('s / nullif(sqrt(greatest(sum(t), 0)) / sxx, 0)', 4)} AS t_hac FROM l GROUP BY source_id, s, sxx, n HAVING n >= 87""")
def i2_newey_west(spark: SparkSession, folder: str) -> DataFrame:
    out = inference.newey_west(pairs(spark, folder), ["source_id"], "date", "y", "x", 21).where("n >= 87")
    return out.select("source_id", "n", r6(F.col("slope"), 5).alias("slope"), r6(F.col("t_hac"), 4).alias("t_hac"))


@query(f"""WITH {bonds_sql('jp_y10', 'jp_bond10_ret')}, x AS (SELECT source_id, month, jp_bond10_ret AS r, jp_y10 AS x, lag(jp_y10) OVER (PARTITION BY source_id ORDER BY month) AS xl FROM b WHERE jp_y10 IS NOT NULL),
y AS (SELECT * FROM x WHERE xl IS NOT NULL AND r IS NOT NULL), f AS (SELECT source_id, regr_slope(r, xl) AS s, regr_intercept(r, xl) AS a, regr_slope(x, xl) AS rho, regr_intercept(x, xl) AS c, count(*) AS n FROM y GROUP BY ALL),
u AS (SELECT source_id, s, rho, n, r - a - s * xl AS u, x - c - rho * xl AS v FROM y JOIN f USING (source_id))
SELECT source_id, n, {s6('s')} AS slope, {s6('rho')} AS rho, {s6('-covar_samp(u, v) / nullif(var_samp(v), 0) * (1 + 3 * rho) / n')} AS bias, {s6('s + covar_samp(u, v) / nullif(var_samp(v), 0) * (1 + 3 * rho) / n')} AS corrected FROM u GROUP BY source_id, s, rho, n HAVING n >= 24""")
def i3_bias_correction(spark: SparkSession, folder: str) -> DataFrame:
    out = inference.stambaugh(bonds(spark, folder, "jp_y10", "jp_bond10_ret"), ["source_id"], "month", "jp_bond10_ret", "jp_y10").where("n >= 24")
    return out.select("source_id", "n", *[r6(F.col(c)).alias(c) for c in ("slope", "rho", "bias", "corrected")])


def monthly_sample(spark: SparkSession, folder: str) -> np.ndarray:
    """Mean market return by month over all feeds: one number per calendar month, which bounds what the replicates carry."""
    m = daily(spark, folder, "mkt_ret").where("mkt_ret > -1 and mkt_ret < 1").groupBy(F.last_day("date").alias("month")).agg(F.avg("mkt_ret").alias("r"))
    return np.array([x["r"] for x in m.orderBy("month").collect()])


@query()
def i4_null_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Per feed: slope of next month's mean return on the level so far, and its p from 2,000 paths under no predictability (blocks of 12 joint residuals, the regressor rebuilt from its own recursion)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values("month")["r"].to_numpy(float)
        slope, p = inference.null_slope_p(np.cumsum(r), r, 2000, 12, np.random.default_rng([7, zlib.crc32(g["source_id"].iloc[0].encode())]))
        return pd.DataFrame([(g["source_id"].iloc[0], len(r), slope, p)], columns=["source_id", "n", "slope", "p"])

    months = returns(spark, folder).groupBy("source_id", F.last_day("date").alias("month")).agg(F.avg("mkt_ret").alias("r"))
    return _nan_to_null(_spread(months, "source_id").groupBy("source_id").applyInPandas(run, "source_id string, n long, slope double, p double"), "slope", "p")


@query()
def i5_block_permutation(spark: SparkSession, folder: str) -> DataFrame:
    """Per feed: correlation of market and bond, and its p from 500 orders of the bond's blocks of 21 rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = g.sort_values("date")[["mkt_ret", "bond10_ret"]].to_numpy(float)
        d = d[np.isfinite(d).all(1)]
        rho, p = inference.permutation_p(d[:, 0], d[:, 1], 500, 21, np.random.default_rng([11, zlib.crc32(g["source_id"].iloc[0].encode())]))
        return pd.DataFrame([(g["source_id"].iloc[0], len(d), rho, p)], columns=["source_id", "n", "rho", "p"])

    rows = daily(spark, folder, "mkt_ret", "bond10_ret").where("mkt_ret > -1 and mkt_ret < 1")
    return _nan_to_null(_spread(rows, "source_id").groupBy("source_id").applyInPandas(run, "source_id string, n long, rho double, p double"), "rho", "p")


def _sharpe(x: np.ndarray) -> float:
    return float(np.mean(x) / max(np.std(x), 1e-12))


@query()
def i5_bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    """5, 50 and 95 per cent points of the Sharpe ratio under four resamplings of 500 replicates each."""
    x = monthly_sample(spark, folder)
    ways = {
        "stationary": lambda g: x[inference.stationary_index(g, len(x), 12)], "blocks": lambda g: x[inference.block_index(g, len(x), 12)],
        "iid": lambda g: x[g.integers(0, len(x), len(x))], "phase": lambda g: inference.phase_surrogate(g, x),
    }
    out = None
    for k, (name, draw) in enumerate(ways.items()):
        part = inference.replicates(spark, 500, lambda g, d=draw: _sharpe(d(g)), seed=k).withColumn("way", F.lit(name))
        out = part if out is None else out.unionByName(part)
    points = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return out.groupBy("way").agg(points.alias("q")).select("way", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("low", "median", "high"))])


_XS = ["smb", "hml", "mom"]


@query(f"""WITH {daily_sql('mkt_ret', *_XS)}, r AS (SELECT source_id, mkt_ret AS y, smb AS a, hml AS b, mom AS c FROM p WHERE mkt_ret > -1 AND mkt_ret < 1 AND smb IS NOT NULL AND hml IS NOT NULL AND mom IS NOT NULL),
q AS (SELECT source_id, count(*) AS n, avg(y) AS y, avg(a) AS a, avg(b) AS b, avg(c) AS c, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy FROM r GROUP BY ALL),
d AS (SELECT *, nullif(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac), 0) AS det, nullif(aa * bb - ab * ab, 0) AS two FROM q),
s AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS b1, (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS b2, (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS b3,
  ((ay * bb - by_ * ab) * ay + (by_ * aa - ay * ab) * by_) / two / nullif(yy, 0) AS part FROM d)
SELECT source_id, n, {', '.join(s6(f'CASE WHEN n > 4 THEN {x} END') + f' AS b{i}' for i, x in enumerate(('y - b1 * a - b2 * b - b3 * c', 'b1', 'b2', 'b3')))},
  {s6('CASE WHEN n > 4 THEN (b1 * ay + b2 * by_ + b3 * cy) / nullif(yy, 0) END')} AS r2_full, {s6('CASE WHEN n > 4 THEN (b1 * ay + b2 * by_ + b3 * cy) / nullif(yy, 0) - part END')} AS gain FROM s""")
def i6_i8_multivariate_ols(spark: SparkSession, folder: str) -> DataFrame:
    """Market return on three factors per feed, with and without the last: R2 of both and the gain."""
    rows = daily(spark, folder, "mkt_ret", *_XS).where("mkt_ret > -1 and mkt_ret < 1")
    whole = inference.normal_equations(rows, ["source_id"], "mkt_ret", _XS).select("source_id", "n", "beta", F.col("r2").alias("r2_full"))
    part = inference.normal_equations(rows.dropna(subset=_XS), ["source_id"], "mkt_ret", _XS[:2]).select("source_id", F.col("r2").alias("r2_part"))
    return whole.join(part, "source_id").select("source_id", "n", *[r6(F.get("beta", F.lit(i))).alias(f"b{i}") for i in range(4)], r6(F.col("r2_full")).alias("r2_full"), r6(F.col("r2_full") - F.col("r2_part")).alias("gain"))


@query(f"""WITH {daily_sql('mkt_ret', *_XS)} SELECT source_id, count(*) AS n, {s6('regr_slope(mkt_ret, smb)')} AS b_smb, {s6('1 / (1 - pow(corr(smb, hml), 2))')} AS vif FROM p WHERE mkt_ret > -1 AND mkt_ret < 1 AND smb IS NOT NULL AND hml IS NOT NULL GROUP BY ALL""")
def a33_variance_inflation(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder, "mkt_ret", *_XS).where("mkt_ret > -1 and mkt_ret < 1 and smb is not null and hml is not null")
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), r6(F.regr_slope("mkt_ret", "smb")).alias("b_smb"), r6(1 / (1 - F.pow(w.corr(F.col("smb"), F.col("hml")), 2))).alias("vif"))


_R3 = "corr(smb, hml) AS x, corr(smb, mom) AS y, corr(hml, mom) AS z"


@query(f"""WITH {daily_sql(*_XS)}, c AS (SELECT source_id, count(*) AS n, {_R3} FROM p WHERE smb IS NOT NULL AND hml IS NOT NULL AND mom IS NOT NULL GROUP BY ALL), d AS (SELECT *, nullif(1 - x * x - y * y - z * z + 2 * x * y * z, 0) AS det FROM c)
SELECT source_id, n, {s6('(1 - z * z) / det')} AS vif_smb, {s6('(1 - y * y) / det')} AS vif_hml, {s6('(1 - x * x) / det')} AS vif_mom FROM d WHERE n > 4""")
def a33_variance_inflation_each(spark: SparkSession, folder: str) -> DataFrame:
    """Variance inflation of each of three factors, each regressed on all others."""
    out = inference.variance_inflation(daily(spark, folder, *_XS), ["source_id"], _XS).where("n > 4")
    return out.select("source_id", "n", *[r6(F.get("vif", F.lit(i))).alias(f"vif_{c}") for i, c in enumerate(_XS)])


@query()
def i6_placebo_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Gain in R2 by the last factor, and the share of 200 placebos, first-order autoregressions of its memory and spread, that gain as much."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = g.sort_values("date")[["mkt_ret", *_XS]].to_numpy(float)
        d = d[np.isfinite(d).all(1)]
        gain, p = inference.placebo_gain(d[:, 0], d[:, 1:3], d[:, 3], 200, np.random.default_rng([13, zlib.crc32(g["source_id"].iloc[0].encode())])) if len(d) > 30 else (np.nan, np.nan)
        return pd.DataFrame([(g["source_id"].iloc[0], len(d), gain, p)], columns=["source_id", "n", "gain", "p"])

    rows = daily(spark, folder, "mkt_ret", *_XS).where("mkt_ret > -1 and mkt_ret < 1")
    return _nan_to_null(_spread(rows, "source_id").groupBy("source_id").applyInPandas(run, "source_id string, n long, gain double, p double"), "gain", "p")


@query()
def i7_spline_and_logistic(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling fits on the first four fifths of 252 rows, scored on the rest: spline of volatility for the size of the next return, logistic for a fall."""

    def run(g: pd.DataFrame) -> dict:
        r = g["mkt_ret"].to_numpy(float)
        x = pd.Series(r).rolling(21).std().to_numpy()[20:-1]
        size, fall = np.abs(r[21:]), (r[21:] < 0).astype(float)
        cut = len(x) * 4 // 5
        if not np.isfinite(x).all() or x[:cut].std() == 0:
            return {"spline_mse": np.nan, "logit_loss": np.nan}
        return {"spline_mse": inference.spline_score(x[:cut], size[:cut], x[cut:], size[cut:]), "logit_loss": inference.logit_score(x[:cut], fall[:cut], x[cut:], fall[cut:])}

    return _nan_to_null(q.windowed_refits(returns(spark, folder), ["source_id"], "date", ["mkt_ret"], 252, 126, run, "spline_mse double, logit_loss double"), "spline_mse", "logit_loss", digits=9)


@query()
def i7_ridge_out_of_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge with the penalty of least leave-one-out error, rolling refits: penalty and squared error on the window's last fifth."""

    def run(g: pd.DataFrame) -> dict:
        d = g[["mkt_ret", *_XS]].to_numpy(float)
        d = d[np.isfinite(d).all(1)]
        if len(d) < 50:
            return {"penalty": np.nan, "mse": np.nan}
        cut = len(d) * 4 // 5
        a, b = linalg.ridge_cv(d[:cut, 1:], d[:cut, 0])
        return {"penalty": a, "mse": float(((d[cut:, 0] - b[0] - d[cut:, 1:] @ b[1:]) ** 2).mean())}

    return _nan_to_null(q.windowed_refits(daily(spark, folder, "mkt_ret", *_XS), ["source_id"], "date", ["mkt_ret", *_XS], 252, 126, run, "penalty double, mse double"), "penalty", "mse", digits=9)


_STEP = "struct_pack(a := ca + caa * {0}.a + cab * {0}.b, b := cb + cba * {0}.a + cbb * {0}.b)"


@query(f"""WITH {daily_sql('mkt_ret', 'bond10_ret')}, n AS (SELECT *, row_number() {SEQ} - 1 AS i FROM p), e AS (SELECT source_id, date, i AS at, (i - 252) // 63 AS refit FROM n WHERE i >= 252 AND (i - 252) % 63 = 0),
w AS (SELECT e.source_id, e.refit, e.date, n.i, n.mkt_ret AS a, n.bond10_ret AS b FROM e JOIN n ON n.source_id = e.source_id AND n.i BETWEEN e.at - 252 AND e.at - 1 WHERE isfinite(n.mkt_ret) AND isfinite(n.bond10_ret)),
l AS (SELECT *, lag(a) OVER o AS la, lag(b) OVER o AS lb, count(*) OVER (PARTITION BY source_id, refit) AS k FROM w WINDOW o AS (PARTITION BY source_id, refit ORDER BY i)),
c AS (SELECT source_id, refit, date, k, avg(a) FILTER (la IS NOT NULL) AS ma, avg(b) FILTER (la IS NOT NULL) AS mb, avg(la) AS mla, avg(lb) AS mlb, var_pop(la) AS aa, var_pop(lb) AS bb, covar_pop(la, lb) AS ab, covar_pop(la, a) AS xa, covar_pop(lb, a) AS ya, covar_pop(la, b) AS xb, covar_pop(lb, b) AS yb, max_by(a, i) AS za, max_by(b, i) AS zb FROM l GROUP BY ALL),
d AS (SELECT *, (xa * bb - ya * ab) / (aa * bb - ab * ab) AS caa, (ya * aa - xa * ab) / (aa * bb - ab * ab) AS cab, (xb * bb - yb * ab) / (aa * bb - ab * ab) AS cba, (yb * aa - xb * ab) / (aa * bb - ab * ab) AS cbb FROM c WHERE k > 30),
f0 AS (SELECT *, ma - caa * mla - cab * mlb AS ca, mb - cba * mla - cbb * mlb AS cb, struct_pack(a := za, b := zb) AS z0 FROM d), {', '.join(f'f{k} AS (SELECT *, {_STEP.format(f"z{k - 1}")} AS z{k} FROM f{k - 1})' for k in range(1, 6))}
SELECT e.source_id, e.refit::INT AS refit, e.date, {s6('z5.a', 9)} AS mkt_ahead, {s6('z5.b', 9)} AS bond_ahead FROM e LEFT JOIN f5 USING (source_id, refit)""")
def i9_vector_autoregression(spark: SparkSession, folder: str) -> DataFrame:
    """Five rows ahead forecast of market and bond from a first-order vector autoregression on trailing windows."""

    def run(g: pd.DataFrame) -> dict:
        d = g[["mkt_ret", "bond10_ret"]].to_numpy(float)
        d = d[np.isfinite(d).all(1)]
        f = linalg.var1(d, 5)[1] if len(d) > 30 else [np.nan, np.nan]
        return {"mkt_ahead": float(f[0]), "bond_ahead": float(f[1])}

    return _nan_to_null(q.windowed_refits(daily(spark, folder, "mkt_ret", "bond10_ret"), ["source_id"], "date", ["mkt_ret", "bond10_ret"], 252, 63, run, "mkt_ahead double, bond_ahead double"), "mkt_ahead", "bond_ahead", digits=9)


@query()
def i10_mixture_and_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """Per feed: BIC of one and two normal components and the participation ratio of four columns."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g[_FOUR].to_numpy(float)
        x = x[np.isfinite(x).all(1)] * 100
        if len(x) < 60:
            row = (np.nan, np.nan, np.nan)
        else:
            row = (linalg.gaussian_mixture(x, 1)["bic"], linalg.gaussian_mixture(x, 2)["bic"], linalg.participation_ratio(x))
        return pd.DataFrame([(g["source_id"].iloc[0], *row)], columns=["source_id", "bic_1", "bic_2", "participation"])

    return _nan_to_null(daily(spark, folder, *_FOUR).groupBy("source_id").applyInPandas(run, "source_id string, bic_1 double, bic_2 double, participation double"), "bic_1", "bic_2", "participation", digits=3)


_HALVES = "h AS (SELECT *, ntile(2) OVER (PARTITION BY source_id ORDER BY date) AS half FROM p WHERE smb IS NOT NULL AND hml IS NOT NULL AND mom IS NOT NULL), a AS (SELECT source_id, avg(smb) * 1e4 AS x, avg(hml) * 1e4 AS y, avg(mom) * 1e4 AS z FROM h WHERE half = 1 GROUP BY ALL), b AS (SELECT source_id, avg(smb) * 1e4 AS u, avg(hml) * 1e4 AS v, avg(mom) * 1e4 AS w FROM h WHERE half = 2 GROUP BY ALL)"
_ORDERS = ", ".join("abs(x - {}) + abs(y - {}) + abs(z - {})".format(*o) for o in ("uvw", "uwv", "vuw", "vwu", "wuv", "wvu"))


@query(f"WITH {daily_sql(*_XS)}, {_HALVES} SELECT source_id, {s6('acos(least(abs(x * u + y * v + z * w) / (sqrt(x * x + y * y + z * z) * sqrt(u * u + v * v + w * w)), 1))', 5)} AS angle, {s6(f'least({_ORDERS})', 9)} AS cost FROM a JOIN b USING (source_id)")
def i10_angle_and_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Mean factor returns (basis points) of a feed's first and second half: the angle between them, and the least total distance when each factor of one half is matched to one of the other."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = g.sort_values("date")[_XS].to_numpy(float) * 1e4
        cut = (len(d) + 1) // 2
        if len(d) < 2:
            return pd.DataFrame(columns=["source_id", "angle", "cost"])
        a, b = d[:cut].mean(0), d[cut:].mean(0)
        cost = np.abs(a[:, None] - b[None])
        row = (float(linalg.principal_angles(a[:, None], b[:, None])[0]), float(cost[np.arange(3), linalg.assignment(cost)].sum()))
        return pd.DataFrame([(g["source_id"].iloc[0], *row)], columns=["source_id", "angle", "cost"])

    rows = daily(spark, folder, *_XS).dropna(subset=_XS)
    out = rows.groupBy("source_id").applyInPandas(run, "source_id string, angle double, cost double")
    return out.select("source_id", r6(F.col("angle"), 5).alias("angle"), r6(F.col("cost"), 9).alias("cost"))


@query()
def i11_covariance_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Equal, exponential and state-weighted covariance on trailing windows: concentration of the minimum-variance and equal-risk weights, and the loss against the last month."""

    def run(g: pd.DataFrame) -> dict:
        x = g[_FOUR].to_numpy(float)
        x = x[np.isfinite(x).all(1)] * 100
        out = {}
        if len(x) < 80:
            return {f"{a}_{b}": np.nan for a in ("equal", "fading", "alike") for b in ("gmv", "erc", "qlik")}
        past, seen = x[:-21], x[-21:]
        age = np.arange(len(past))[::-1].astype(float)
        vol = np.abs(past).mean(1)
        for name, weight in (("equal", np.ones(len(past))), ("fading", 0.94**age), ("alike", linalg.kernel_weights(vol[:, None], vol[-1:], age, float(vol.std()) or 1.0))):
            s = linalg.toward_constant_correlation(linalg.weighted_covariance(past, weight))
            out[f"{name}_gmv"] = float((linalg.minimum_variance(s) ** 2).sum())
            out[f"{name}_erc"] = float((linalg.equal_risk(s) ** 2).sum())
            out[f"{name}_qlik"] = linalg.qlik(s, np.cov(seen.T))
        return out

    names = [f"{a}_{b}" for a in ("equal", "fading", "alike") for b in ("gmv", "erc", "qlik")]
    return _nan_to_null(q.windowed_refits(daily(spark, folder, *_FOUR), ["source_id"], "date", _FOUR, 252, 126, run, ", ".join(f"{n} double" for n in names)), *names, digits=4)


@query()
def i12_exposure_match(spark: SparkSession, folder: str) -> DataFrame:
    """The slope of a dial min(max(1 - k z, 0), 1) on standardised volatility whose mean exposure is 0.8, by bisection, per feed."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        z = np.nan_to_num(g["z"].to_numpy(float))
        f = lambda k: float(np.clip(1 - k * z, 0, 1).mean()) - 0.8
        k = linalg.bisect_root(f, 0.0, 50.0) if f(0.0) * f(50.0) < 0 else np.nan
        return pd.DataFrame([(g["source_id"].iloc[0], k)], columns=["source_id", "k"])

    rows = returns(spark, folder).withColumn("v", A.std(F.col("mkt_ret"), 21)).withColumn("z", A.expanding_z(F.col("v"), 63))
    return _nan_to_null(rows.groupBy("source_id").applyInPandas(run, "source_id string, k double"), "k", digits=4)


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, v AS (SELECT source_id, date, i, mkt_ret, round({guarded('stddev_samp', 'mkt_ret', 21)}, 12) AS v FROM n),
c AS (SELECT *, count(v) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, quantile_cont(v, 0.8) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM v),
x AS (SELECT *, k >= 63 AND v > q AND NOT coalesce(lag(v > q) {SEQ}, true) AS crossing, CASE WHEN count(mkt_ret) {ahead(21)} = 21 THEN min(mkt_ret) {ahead(21)} END AS worst FROM c)
SELECT source_id, count(*) AS crossings, count(*) FILTER (worst <= -0.03) AS followed, round(1 - count(*) FILTER (worst <= -0.03) / count(*), 6) AS false_alarm_rate FROM x WHERE crossing AND worst IS NOT NULL GROUP BY ALL""")
def i13_event_study(spark: SparkSession, folder: str) -> DataFrame:
    """Volatility crossing its expanding 80 per cent quantile: how often a fall of 3 per cent follows within 21 rows."""
    r = F.col("mkt_ret")
    rows = returns(spark, folder).withColumn("v", F.round(A.std(r, 21), 12)).withColumns({"k": F.count("v").over(A.ever()), "worst": A.rolling(F.min, [r], 21, A.ahead(21))})
    level = q.along_series(rows, ["source_id"], "date", ["v"], lambda g: {"q": q.expanding_quantile(g["v"].to_numpy(float), 0.8)}, "q double")
    rows = rows.join(level, ["source_id", "date"])
    rows = rows.withColumn("above", F.col("v") > F.col("q")).withColumn("crossing", (F.col("k") >= 63) & F.col("above") & ~F.coalesce(A.lag(F.col("above")), F.lit(True)))
    hit = F.count_if(F.col("worst") <= -0.03)
    return rows.where("crossing and worst is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("crossings"), hit.alias("followed"), F.round(1 - hit / F.count(F.lit(1)), 6).alias("false_alarm_rate"))


@query(f"""WITH {daily_sql('mkt_ret')}, {ORDERED}, v AS (SELECT source_id, date, {guarded('stddev_samp', 'mkt_ret', 20)} AS v FROM n), t AS (SELECT source_id, quantile_cont(v, 0.75) AS t FROM v GROUP BY ALL)
SELECT source_id, count(v) AS n, round(avg((v > t)::INT), 6) AS stressed FROM v JOIN t USING (source_id) GROUP BY ALL""")
def i14_exposure_matched_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Threshold on volatility that calls a quarter of the feed's rows stressed (of the whole calibration span, on purpose not causal)."""
    rows = returns(spark, folder).withColumn("v", A.std(F.col("mkt_ret"), 20))
    t = F.percentile("v", F.lit(0.75)).over(Window.partitionBy("source_id"))
    return rows.withColumn("t", t).groupBy("source_id").agg(F.count("v").alias("n"), F.round(F.avg((F.col("v") > F.col("t")).cast("double")), 6).alias("stressed"))
