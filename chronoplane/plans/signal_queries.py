"""Signals, gates and validators (section 2.13 of the survey) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.functions import windows as w
from chronoplane.operators import bitemporal, runs
from chronoplane.operators import sequential as seq
from chronoplane.plans import signals
from chronoplane.plans.panels import NATION_MONTHS_SQL, bonds, bonds_sql, daily, daily_sql, nation_months
from chronoplane.plans.registry import query, r6, s6
from chronoplane.plans.relational_queries import _OHLC, ohlc
from chronoplane.plans.window_queries import EVER, SEQ, guarded
from chronoplane.tables import table


def returns(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret", *more).where("mkt_ret > -1 and mkt_ret < 1").withColumnRenamed("source_id", "series")


def rank_sql(rows: str, key: str, order: str, value: str) -> str:
    """CTEs ``k`` (numbered non-null rows) and ``rk`` (their expanding average rank)."""
    return f"""k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i_ FROM {rows} WHERE {value} IS NOT NULL),
rk AS (SELECT a.{key}, a.{order}, round((count(*) FILTER (c.{value} < a.{value}) + (count(*) FILTER (c.{value} = a.{value}) + 1) / 2) / count(*), 9) AS pctile FROM k a JOIN k c ON a.{key} = c.{key} AND c.i_ <= a.i_ GROUP BY ALL)"""


@query()
def sig_volatility(spark: SparkSession, folder: str) -> DataFrame:
    out = signals.volatility(returns(spark, folder))
    return out.select("series", "date", "mkt_ret", *[r6(F.col(c)).alias(c) for c in ("vol_annual", "vol_pctile", "half_life", "half_life_pctile")])


def _c(k: int) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} THEN corr(mkt_ret, bond10_ret) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END"


@query(f"""WITH {daily_sql('mkt_ret', 'bond10_ret')}, q AS (SELECT * FROM p WHERE mkt_ret > -1 AND mkt_ret < 1 AND bond10_ret IS NOT NULL), c AS (SELECT source_id, date, {_c(126)} AS c126, {_c(63)} AS c63, {_c(252)} AS c252 FROM q),
z AS (SELECT *, CASE WHEN count(c126) {EVER} >= 252 THEN (c126 - avg(c126) {EVER}) / nullif(stddev_samp(c126) {EVER}, 0) END AS z FROM (SELECT source_id, date, CASE WHEN isfinite(c126) THEN c126 END AS c126, c63, c252 FROM c))
SELECT source_id AS series, date, {s6('c126', 5)} AS corr_126, {s6('c63', 5)} AS corr_63, {s6('c252', 5)} AS corr_252, {s6('z', 4)} AS level_z, CASE WHEN c126 < -0.1 THEN 'intact' WHEN c126 > 0.1 THEN 'violated' ELSE 'under_test' END AS state FROM z WHERE c126 IS NOT NULL""")
def sig_stock_bond_daily(spark: SparkSession, folder: str) -> DataFrame:
    panel = returns(spark, folder, "bond10_ret").select("series", "date", F.col("mkt_ret").alias("eq"), F.col("bond10_ret").alias("bond"))
    out = signals.stock_bond_daily(panel)
    return out.select("series", "date", *[r6(F.col(f"corr_{k}"), 5).alias(f"corr_{k}") for k in (126, 63, 252)], r6(F.col("level_z"), 4).alias("level_z"), "state")


_SBM = f"""{bonds_sql('jp_bond10_ret', 'de_bond10_ret')}, q AS (SELECT source_id, month, jp_bond10_ret AS e, de_bond10_ret AS d FROM b WHERE jp_bond10_ret IS NOT NULL AND de_bond10_ret IS NOT NULL),
c AS (SELECT source_id, month, CASE WHEN count(*) OVER w = 24 THEN corr(e, d) OVER w END AS corr FROM q WINDOW w AS (PARTITION BY source_id ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, CASE WHEN count(corr) OVER w >= 60 THEN (corr - avg(corr) OVER w) / nullif(stddev_samp(corr) OVER w, 0) END AS z FROM c WINDOW w AS (PARTITION BY source_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_SBM}, {rank_sql('z', 'source_id', 'month', 'corr')} SELECT z.source_id AS series, z.month, {s6('corr', 5)} AS corr, {s6('z', 4)} AS level_z, pctile AS level_pctile, CASE WHEN corr < -0.1 THEN 'intact' WHEN corr > 0.1 THEN 'violated' WHEN corr IS NOT NULL THEN 'under_test' END AS state FROM z LEFT JOIN rk USING (source_id, month)")
def sig_stock_bond_monthly(spark: SparkSession, folder: str) -> DataFrame:
    panel = bonds(spark, folder, "jp_bond10_ret", "de_bond10_ret").select(F.col("source_id").alias("series"), "month", F.col("jp_bond10_ret").alias("eq"), F.col("de_bond10_ret").alias("bond"))
    return signals.stock_bond_monthly(panel).select("series", "month", r6(F.col("corr"), 5).alias("corr"), r6(F.col("level_z"), 4).alias("level_z"), r6(F.col("level_pctile"), 9).alias("level_pctile"), "state")


_VAL = """m AS (SELECT n_name AS series, last_day(o_orderdate::DATE) AS month, sum(o_totalprice) AS price, avg(o_totalprice) AS earnings, count(*)::DOUBLE AS cpi FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
l AS (SELECT *, lag(cpi) OVER w AS c FROM m WINDOW w AS (PARTITION BY series ORDER BY month)), r AS (SELECT *, lag(earnings / c, 5) OVER w AS rl FROM l WINDOW w AS (PARTITION BY series ORDER BY month)),
e AS (SELECT series, month, price / c AS real_price, CASE WHEN count(rl) OVER w = 12 THEN avg(rl) OVER w END AS real_earn FROM r WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, round(real_price / real_earn, 9) AS cape FROM e),
z AS (SELECT *, CASE WHEN count(cape) OVER w >= 24 THEN (cape - avg(cape) OVER w) / nullif(stddev_samp(cape) OVER w, 0) END AS z FROM v WINDOW w AS (PARTITION BY series ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_VAL}, {rank_sql('z', 'series', 'month', 'cape')} SELECT z.series, z.month, round(real_price, 6) AS real_price, round(real_earn, 6) AS real_earn, round(cape, 9) AS cape, pctile AS cape_pctile, {s6('z', 4)} AS cape_z FROM z JOIN rk USING (series, month)")
def sig_valuation(spark: SparkSession, folder: str) -> DataFrame:
    """Order value against trailing mean order size, per nation, with both publication lags (windows of 12 and 24 months)."""
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    panel = rows.groupBy(F.col("n_name").alias("series"), F.last_day(F.to_date("o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("price"), F.avg("o_totalprice").alias("earnings"), F.count(F.lit(1)).cast("double").alias("cpi"))
    out = signals.valuation(panel, 12, 24)
    return out.select("series", "month", F.round("real_price", 6).alias("real_price"), F.round("real_earn", 6).alias("real_earn"), F.round("cape", 9).alias("cape"), r6(F.col("cape_pctile"), 9).alias("cape_pctile"), r6(F.col("cape_z"), 4).alias("cape_z"))


_CON = f"""{NATION_MONTHS_SQL}, s AS (SELECT month, revenue / sum(revenue) OVER (PARTITION BY month) AS s FROM nm), c AS (SELECT 'all' AS series, month, 1 / sum(s * s) AS eff_n, max(s) AS top_share FROM s GROUP BY month),
z AS (SELECT *, CASE WHEN count(eff_n) OVER w >= 24 THEN (eff_n - avg(eff_n) OVER w) / nullif(stddev_samp(eff_n) OVER w, 0) END AS z FROM c WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_CON}, {rank_sql('z', 'series', 'month', 'eff_n')} SELECT z.series, z.month, {s6('eff_n')} AS eff_n, {s6('top_share')} AS top_share, pctile AS eff_n_pctile, {s6('z', 4)} AS eff_n_z, least(pctile, 1 - pctile) <= 1.0 - 0.95 AS inside_the_tail, round(avg((least(pctile, 1 - pctile) <= 1.0 - 0.95)::INT) OVER (ORDER BY z.month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS share_inside_the_tail FROM z JOIN rk USING (series, month)")
def sig_concentration_informativeness(spark: SparkSession, folder: str) -> DataFrame:
    panel = nation_months(spark, folder).select(F.lit("all").alias("series"), "month", F.col("n_name").alias("entity"), F.col("revenue").alias("value"))
    rows = signals.concentration(panel, 24).withColumn("eff_n_pctile", F.round("eff_n_pctile", 9))
    out = signals.informativeness(rows, "month", "eff_n_pctile")
    return out.select("series", "month", r6(F.col("eff_n")).alias("eff_n"), r6(F.col("top_share")).alias("top_share"), "eff_n_pctile", r6(F.col("eff_n_z"), 4).alias("eff_n_z"), "inside_the_tail", r6(F.col("share_inside_the_tail")).alias("share_inside_the_tail"))


_CRE = f"""{bonds_sql('jp_y10')}, q AS (SELECT source_id, month, jp_y10 AS ebp FROM b WHERE jp_y10 IS NOT NULL), z AS (SELECT *, CASE WHEN count(ebp) OVER w >= 120 THEN (ebp - avg(ebp) OVER w) / nullif(stddev_samp(ebp) OVER w, 0) END AS z FROM q WINDOW w AS (PARTITION BY source_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_CRE}, {rank_sql('z', 'source_id', 'month', 'ebp')} SELECT z.source_id AS series, last_day((z.month + INTERVAL 2 MONTH)::DATE) AS as_of, z.month AS obs_month, ebp, pctile AS ebp_pctile, {s6('z', 5)} AS ebp_z FROM z JOIN rk USING (source_id, month)")
def sig_credit(spark: SparkSession, folder: str) -> DataFrame:
    panel = bonds(spark, folder, "jp_y10").select(F.col("source_id").alias("series"), "month", F.col("jp_y10").alias("ebp"))
    return signals.credit(panel).select("series", "as_of", "obs_month", "ebp", r6(F.col("ebp_pctile"), 9).alias("ebp_pctile"), r6(F.col("ebp_z"), 5).alias("ebp_z"))


_TAIL = f"""{daily_sql('gold_ret')}, q AS (SELECT source_id, date, (100 - (100 + 1000 * gold_ret)) / 10 AS s FROM p WHERE gold_ret IS NOT NULL AND date >= DATE '2000-01-01'), q2 AS (SELECT source_id, date, round(s, 6) AS s FROM q), z AS (SELECT *, CASE WHEN count(s) {EVER} >= 252 THEN (s - avg(s) {EVER}) / nullif(stddev_samp(s) {EVER}, 0) END AS z FROM q2)"""


@query(f"WITH {_TAIL}, {rank_sql('z', 'source_id', 'date', 's')} SELECT z.source_id AS series, z.date, s + 0.0 AS rn_skew, pctile AS rn_skew_pctile, {s6('z', 5)} AS rn_skew_z FROM z JOIN rk USING (source_id, date)")
def sig_tail(spark: SparkSession, folder: str) -> DataFrame:
    panel = daily(spark, folder, "gold_ret").select(F.col("source_id").alias("series"), "date", F.round(100 + 1000 * F.col("gold_ret"), 5).alias("skew"))
    out = signals.tail(panel.withColumn("skew", F.col("skew")))
    return out.select("series", "date", r6(F.col("rn_skew")).alias("rn_skew"), r6(F.col("rn_skew_pctile"), 9).alias("rn_skew_pctile"), r6(F.col("rn_skew_z"), 5).alias("rn_skew_z"))


_F = ["ind_nodur", "ind_enrgy", "ind_hitec", "ind_hlth"]
_LOGV = {c: f"ln(CASE WHEN count({c}) OVER w = 21 AND stddev_samp({c}) OVER w > 1e-9 THEN stddev_samp({c}) OVER w * sqrt(252) END)" for c in _F}


@query(f"WITH {daily_sql(*_F)}, v AS (SELECT source_id, date, " + ", ".join(f"{x} AS {c}" for c, x in _LOGV.items()) + f" FROM p WINDOW w AS (PARTITION BY source_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)), c AS (SELECT *, ({' + '.join(_F)}) / 4 AS m FROM v) SELECT source_id AS series, date, {s6('m')} AS common, " + ", ".join(f"{s6(f'{c} - m')} AS div_{c}" for c in _F) + " FROM c")
def sig_cross_section(spark: SparkSession, folder: str) -> DataFrame:
    out = signals.cross_section(daily(spark, folder, *_F).withColumnRenamed("source_id", "series"), _F)
    return out.select("series", "date", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


_BOND = "b2 AS (SELECT source_id, month, jp_y10, lag(jp_y10) OVER (PARTITION BY source_id ORDER BY month) AS y FROM b WHERE jp_y10 IS NOT NULL), b3 AS (SELECT source_id, month, y / 100 AS y0, y / 200 AS h, (jp_y10 - y) / 100 AS dy, pow(1 + y / 200, -20) AS f FROM b2 WHERE y IS NOT NULL)"


@query(f"WITH {bonds_sql('jp_y10')}, {_BOND} SELECT source_id, month, {s6('y0 / 12 - (1 - f) / nullif(h, 0) / 2 / (1 + h) * dy + (2 / nullif(h * h, 0) * (1 - f) - 40 / nullif(h * pow(1 + h, 21), 0)) / 4 * dy * dy / 2', 8)} AS total_return FROM b3")
def fn_bond_total_return(spark: SparkSession, folder: str) -> DataFrame:
    a = w.Along("source_id", "month")
    rows = bonds(spark, folder, "jp_y10").where("jp_y10 is not null").withColumn("y", a.lag(F.col("jp_y10"))).where("y is not null")
    return rows.select("source_id", "month", r6(signals.bond_total_return(F.col("jp_y10"), F.col("y"), 12), 8).alias("total_return"))


@query(f"WITH {daily_sql('mkt_ret')}, v AS (SELECT source_id, date, {guarded('stddev_samp', 'mkt_ret', 21)} * sqrt(252) AS vol FROM p WHERE mkt_ret > -1 AND mkt_ret < 1) SELECT source_id AS series, max(date) AS date, round(max_by(vol, date), 6) AS vol FROM v WHERE vol IS NOT NULL GROUP BY ALL")
def run_out_of_sample(spark: SparkSession, folder: str) -> DataFrame:
    """One build over the feeds of every region at once: the latest reading of each."""
    build = lambda p: p.select("series", "date", w.Along("series", "date").realized_vol(F.col("mkt_ret")).alias("vol"))
    out = signals.run_out_of_sample(build, returns(spark, folder)).where("vol is not null")
    return out.groupBy("series").agg(F.max("date").alias("date"), r6(F.max_by("vol", "date")).alias("vol"))


# -- gates and validators ------------------------------------------------------------------------------------------------
@query(f"""WITH {daily_sql('mkt_ret', 'ind_other')}, a AS (SELECT source_id, min(date) AS d0, max(date) AS d1, corr(mkt_ret, ind_other) FILTER (mkt_ret > -1 AND mkt_ret < 1 AND ind_other IS NOT NULL) AS c, (avg(mkt_ret) FILTER (mkt_ret > -1 AND mkt_ret < 1 AND ind_other IS NOT NULL) - avg(ind_other) FILTER (mkt_ret > -1 AND mkt_ret < 1)) * 252 AS d FROM p GROUP BY ALL)
SELECT source_id, 'coverage' AS gate, d1 - d0 >= 365 AS passed, (d1 - d0)::VARCHAR AS detail FROM a UNION ALL SELECT source_id, 'overlap_corr', coalesce(c >= 0.5, false), CASE WHEN isfinite(c) THEN round(c, 4)::VARCHAR END FROM a UNION ALL SELECT source_id, 'overlap_drift', coalesce(abs(d) <= 0.5, false), round(d, 3)::VARCHAR FROM a""")
def gate_market(spark: SparkSession, folder: str) -> DataFrame:
    """Span, agreement with a second source and drift against it, per feed."""
    rows = daily(spark, folder, "mkt_ret", "ind_other")
    m, o = F.col("mkt_ret"), F.col("ind_other")
    both = (m > -1) & (m < 1) & o.isNotNull()
    x, y = F.when(both, m), F.when(both, o)
    span, c, d = F.datediff(F.max("date"), F.min("date")), w.corr(x, y), (F.avg(x) - F.avg(y)) * 252
    return signals.gates(rows, ["source_id"], {"coverage": (span >= 365, span), "overlap_corr": (c >= 0.5, F.round(c, 4)), "overlap_drift": (F.abs(d) <= 0.5, F.round(d, 3))})


@query(f"""WITH {_OHLC} SELECT year(date) AS y, min(date) AS first, max(date) AS last, count(*) AS n, round(avg(ln(high / low)), 6) AS mean_log_hl_range, count(*) FILTER (ln(high / low) <= 0) AS nonpositive_ranges FROM o GROUP BY ALL""")
def gate_ohlc(spark: SparkSession, folder: str) -> DataFrame:
    x = F.ln(F.col("high") / F.col("low"))
    return ohlc(spark, folder).groupBy(F.year("date").cast("long").alias("y")).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean_log_hl_range"), F.count_if(x <= 0).alias("nonpositive_ranges"))


@query(f"""WITH {NATION_MONTHS_SQL}, s AS (SELECT month, revenue / sum(revenue) OVER (PARTITION BY month) AS s FROM nm), c AS (SELECT month, 1 / sum(s * s) AS e, abs(sum(s) - 1) AS err, count(*) AS n FROM s GROUP BY ALL)
SELECT 'share_sum' AS gate, max(err) < 1e-9 AS passed FROM c UNION ALL SELECT 'eff_n_range', min(e) >= 1 AND max(e) <= max(n) FROM c UNION ALL SELECT 'gapless', count(*) = date_diff('month', min(month), max(month)) + 1 FROM c""")
def gate_concentration(spark: SparkSession, folder: str) -> DataFrame:
    from chronoplane.operators import cross_section as xs

    rows = xs.shares(nation_months(spark, folder), ["month"], "revenue").groupBy("month").agg((1 / F.sum(F.col("share") * F.col("share"))).alias("e"), F.abs(F.sum("share") - 1).alias("err"), F.count(F.lit(1)).alias("n"))
    span = F.months_between(F.trunc(F.max("month"), "month"), F.trunc(F.min("month"), "month")) + 1
    out = signals.gates(rows, [], {"share_sum": (F.max("err") < 1e-9, F.max("err")), "eff_n_range": ((F.min("e") >= 1) & (F.max("e") <= F.max("n")), F.max("e")), "gapless": (F.count(F.lit(1)) == span, span)})
    return out.select("gate", "passed")


@query(f"WITH {bonds_sql('jp_bond10_ret')}, v AS (SELECT source_id, stddev_samp(jp_bond10_ret) * sqrt(12) AS vol FROM b GROUP BY ALL) SELECT source_id, round(vol, 6) AS vol, coalesce(vol BETWEEN 0.01 AND 0.2, false) AS passed FROM v")
def gate_bond_vol_band(spark: SparkSession, folder: str) -> DataFrame:
    v = F.stddev_samp("jp_bond10_ret") * F.sqrt(F.lit(12.0))
    return bonds(spark, folder, "jp_bond10_ret").groupBy("source_id").agg(F.round(v, 6).alias("vol"), F.coalesce(v.between(0.01, 0.2), F.lit(False)).alias("passed"))


_BAND = "CASE WHEN {0} < 0.1 THEN 0 WHEN {0} < 0.3 THEN 1 WHEN {0} < 0.7 THEN 2 WHEN {0} < 0.9 THEN 3 ELSE 4 END"
_PCTILE = "(2 * count(*) FILTER (y.{0} < x.{0}) + count(*) FILTER (y.{0} = x.{0}) + 1) / (2.0::DOUBLE * count(*))"


@query(f"""WITH RECURSIVE {daily_sql('mkt_ret')}, n AS (SELECT source_id, date, mkt_ret, row_number() {SEQ} AS i FROM p WHERE mkt_ret > -1 AND mkt_ret < 1), s AS (SELECT source_id, var_pop(mkt_ret) AS v FROM n WHERE i <= 252 GROUP BY ALL),
e AS (SELECT source_id, 252::BIGINT AS i, v AS a, v AS b FROM s UNION ALL SELECT e.source_id, n.i, e.a + 0.06 * (n.mkt_ret * n.mkt_ret - e.a), e.b + 0.03 * (n.mkt_ret * n.mkt_ret - e.b) FROM e JOIN n ON n.source_id = e.source_id AND n.i = e.i + 1),
v AS (SELECT source_id, i, sqrt(a * 252) AS a, sqrt(b * 252) AS b FROM e WHERE i > 252),
r AS (SELECT x.source_id, x.i, x.a, x.b, {_PCTILE.format('a')} AS pa, {_PCTILE.format('b')} AS pb FROM v x JOIN v y ON y.source_id = x.source_id AND y.i <= x.i GROUP BY ALL)
SELECT source_id AS series, count(*) AS n, {s6('corr(a, b)')} AS rho, {s6(f"avg(({_BAND.format('pa')} = {_BAND.format('pb')})::INT)")} AS same_band, {s6('avg(pa)')} AS mean_percentile FROM r GROUP BY ALL""")
def validate_volatility(spark: SparkSession, folder: str) -> DataFrame:
    """Per feed: agreement of two decay rates (correlation, share of rows in the same percentile band) and of squared-return with realised volatility."""
    rows = returns(spark, folder)

    def run(g):  # noqa: ANN001, ANN202
        r = g["mkt_ret"].to_numpy(float)
        a, b = seq.ewma_vol(r, 0.94), seq.ewma_vol(r, 0.97)
        return {"a": a, "b": b, "pa": seq.expanding_rank(a), "pb": seq.expanding_rank(b)}

    v = seq.along_series(rows, ["series"], "date", ["mkt_ret"], run, "a double, b double, pa double, pb double").select("series", "date", *[w.finite(F.col(c)).alias(c) for c in ("a", "b", "pa", "pb")]).where("a is not null")
    same = (w.band(F.col("pa"), *w.RECORD_BANDS) == w.band(F.col("pb"), *w.RECORD_BANDS)).cast("double")
    return v.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(w.corr(F.col("a"), F.col("b"))).alias("rho"), r6(F.avg(same)).alias("same_band"), r6(F.avg("pa")).alias("mean_percentile"))


@query(f"""WITH {daily_sql('mkt_ret', 'bond10_ret')}, e AS (SELECT source_id, date, {guarded('stddev_samp', 'mkt_ret', 21)} AS v FROM p WHERE mkt_ret > -1 AND mkt_ret < 1), q AS (SELECT *, quantile_cont(v, 0.9) OVER (PARTITION BY source_id) AS t, row_number() {SEQ} AS i FROM e),
h AS (SELECT * FROM q WHERE v > t), k AS (SELECT *, CASE WHEN coalesce(i - lag(i) {SEQ} > 63, true) THEN 1 ELSE 0 END AS f FROM h) SELECT source_id, sum(f)::BIGINT AS episodes, sum(f) >= 2 AS passed FROM k GROUP BY ALL""")
def gate_episode_count(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes of high volatility (above its own 90 per cent quantile, gaps of over 63 rows) per feed."""
    from pyspark.sql import Window

    a = w.Along("source_id", "date")
    rows = daily(spark, folder, "mkt_ret").where("mkt_ret > -1 and mkt_ret < 1").withColumn("v", a.std(F.col("mkt_ret"), 21))
    rows = rows.withColumn("t", F.percentile("v", F.lit(0.9)).over(Window.partitionBy("source_id")))
    out = runs.episodes(rows, ["source_id"], "date", F.col("v") > F.col("t"), 63)
    return out.groupBy("source_id").agg(F.count(F.lit(1)).alias("episodes"), (F.count(F.lit(1)) >= 2).alias("passed"))


@query("""WITH v AS (SELECT series, snapshot_no, wayback_timestamp, max(rows)::DOUBLE AS rows FROM vintage_manifest WHERE rows IS NOT NULL GROUP BY ALL), t AS (SELECT series, max(snapshot_no) AS z FROM v GROUP BY ALL), n AS (SELECT v.series, wayback_timestamp, rows AS now FROM v JOIN t ON v.series = t.series AND snapshot_no = z),
j AS (SELECT v.series, snapshot_no, rows, now, rank() OVER w1 + (count(*) OVER (PARTITION BY v.series, snapshot_no, rows) - 1) / 2 AS a, rank() OVER w2 + (count(*) OVER (PARTITION BY v.series, snapshot_no, now) - 1) / 2 AS b FROM v JOIN n USING (series, wayback_timestamp) WINDOW w1 AS (PARTITION BY v.series, snapshot_no ORDER BY rows), w2 AS (PARTITION BY v.series, snapshot_no ORDER BY now))
SELECT series, snapshot_no, count(*) AS n, CASE WHEN isfinite(corr(a, b)) THEN round(corr(a, b), 6) END AS spearman, round(max(abs(now - rows)), 6) AS largest_revision FROM j GROUP BY ALL HAVING count(*) >= 3""")
def validate_credit_vintages(spark: SparkSession, folder: str) -> DataFrame:
    """Rank agreement and largest revision of every vintage against the last one, on the observations both have."""
    from pyspark.sql import Window

    v = table(spark, folder, "vintage_manifest").where("rows is not null").groupBy("series", "snapshot_no", "wayback_timestamp").agg(F.max("rows").cast("double").alias("rows"))
    last = v.withColumn("z", F.max("snapshot_no").over(Window.partitionBy("series"))).where("snapshot_no = z").select("series", "wayback_timestamp", F.col("rows").alias("now"))
    j = v.join(last, ["series", "wayback_timestamp"])
    part = ["series", "snapshot_no"]
    rank = lambda c: F.rank().over(Window.partitionBy(*part).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*part, c)) - 1) / 2
    out = j.withColumns({"a": rank("rows"), "b": rank("now")}).groupBy(*part).agg(F.count(F.lit(1)).alias("n"), r6(w.corr(F.col("a"), F.col("b"))).alias("spearman"), F.round(F.max(F.abs(F.col("now") - F.col("rows"))), 6).alias("largest_revision"))
    return out.where("n >= 3")


# -- map of axes ---------------------------------------------------------------------------------------------------------
_MAP_VIEW = "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region, signal, as_of ORDER BY available_at::TIMESTAMPTZ DESC, record_id DESC) AS w FROM observation_log) WHERE w = 1)"


@query(f"""WITH {_MAP_VIEW}, {_CON}, {rank_sql('z', 'series', 'month', 'eff_n')},
x AS (SELECT 'admitted' AS admission, region, signal AS axis, as_of, rarity.level_percentile AS p, CASE WHEN reading.value < -0.1 THEN 'intact' WHEN reading.value > 0.1 THEN 'violated' WHEN reading.value IS NOT NULL THEN 'under_test' END AS s FROM v WHERE rarity.level_percentile IS NOT NULL
  UNION ALL SELECT 'candidate', 'all', 'concentration', strftime(month, '%Y-%m-%d'), pctile, NULL FROM rk),
r AS (SELECT *, least(p, 1 - p) <= 0.05 AS f, row_number() OVER o AS i, count(*) OVER q AS n, last_value(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now, sum((NOT least(p, 1 - p) <= 0.05)::INT) OVER o AS run FROM x WINDOW q AS (PARTITION BY admission, region, axis), o AS (PARTITION BY admission, region, axis ORDER BY as_of)),
sp AS (SELECT admission, region, axis, median(k) AS median_spell, max(k) AS longest_spell FROM (SELECT admission, region, axis, run, count(*) AS k FROM r WHERE f GROUP BY ALL) GROUP BY ALL),
m AS (SELECT admission, region, axis, max(as_of) AS as_of, max(n) AS readings, any_value(now) AS status, max_by(p, as_of) AS p, max_by(f, as_of) AS inside, max(n) - coalesce(max(i) FILTER (NOT f), 0) AS spell_now, max(n) - max(i) FILTER (f) AS since_inside,
  max(n) - coalesce(max(i) FILTER (s IS DISTINCT FROM now), 0) AS since_status, max_by(p, as_of) - max(p) FILTER (i = n - 12) AS moved FROM r GROUP BY ALL)
SELECT admission, region, axis, as_of, status, round(p, 6) AS percentile, round(least(p, 1 - p), 6) AS tail_mass, inside, readings, spell_now, median_spell, longest_spell, since_status, since_inside, round(moved, 6) + 0.0 AS moved FROM m LEFT JOIN sp USING (admission, region, axis)""")
def b19_axis_map(spark: SparkSession, folder: str) -> DataFrame:
    """Standing and novelty of every axis of the log, and of the candidate that has no log of its own (concentration, built from the monthly panel)."""
    from chronoplane.plans.bitemporal_queries import SERIES, at, log

    rows = log(spark, folder).withColumns({"p": F.col("rarity.level_percentile"), "value": F.col("reading.value")})
    view = bitemporal.current_view(rows, SERIES, at(), "record_id", ["p", "value"])
    held = view.select(F.lit("admitted").alias("admission"), "region", F.col("signal").alias("axis"), "as_of", "p", w.sign_state(F.col("value")).alias("s"))
    panel = nation_months(spark, folder).select(F.lit("all").alias("series"), "month", F.col("n_name").alias("entity"), F.col("revenue").alias("value"))
    fresh = signals.concentration(panel, 24).select(F.lit("candidate").alias("admission"), F.lit("all").alias("region"), F.lit("concentration").alias("axis"), F.date_format("month", "yyyy-MM-dd").alias("as_of"), F.round("eff_n_pctile", 9).alias("p"), F.lit(None).cast("string").alias("s"))
    out = bitemporal.axis_map(held.unionByName(fresh), ["admission", "region", "axis"], "as_of", "p", "s")
    digits = {c: F.round(c, 6) + F.lit(0.0) for c in ("percentile", "tail_mass", "moved")}
    return out.withColumns(digits).select("admission", "region", "axis", "as_of", "status", "percentile", "tail_mass", "inside", "readings", "spell_now", "median_spell", "longest_spell", "since_status", "since_inside", "moved")
