"""Aggregations (A) and cross-sectional operators (X)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplane.functions import stats
from chronoplane.functions import windows as w
from chronoplane.operators import calendar, rolling, runs
from chronoplane.operators import cross_section as xs
from chronoplane.plans.panels import INDUSTRIES, NATION_MONTHS_SQL, bonds, bonds_sql, daily, daily_sql, nation_months
from chronoplane.plans.registry import query, r6, s6
from chronoplane.plans.window_queries import _EQUITY, _RUNS_SQL, _STATE_SQL, A, EVER, SEQ, equity, guarded, last, plausible, states
from chronoplane.tables import table

def R() -> Column:  # noqa: N802
    return F.col("mkt_ret")


def B() -> Column:  # noqa: N802
    return F.col("bond10_ret")


@query(f"""WITH {daily_sql('mkt_ret')} SELECT source_id, count(mkt_ret) AS n, {s6('avg(mkt_ret)', 13)} AS mean, {s6('stddev_samp(mkt_ret)')} AS std, {s6('var_samp(mkt_ret)')} AS var, min(mkt_ret) AS low, max(mkt_ret) AS high, {s6('sum(mkt_ret)')} AS total,
{s6('stddev_pop(mkt_ret)')} AS std_pop, {s6('var_pop(mkt_ret)')} AS var_pop FROM p GROUP BY source_id""")
def a1_a2_moments(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").groupBy("source_id").agg(
        F.count(R()).alias("n"), r6(F.avg(R()), 13).alias("mean"), r6(F.stddev_samp(R())).alias("std"), r6(F.var_samp(R())).alias("var"), F.min(R()).alias("low"), F.max(R()).alias("high"),
        r6(F.sum(R())).alias("total"), r6(F.stddev_pop(R())).alias("std_pop"), r6(F.var_pop(R())).alias("var_pop"))


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')} SELECT source_id, {s6('corr(mkt_ret, bond10_ret)')} AS rho FROM p WHERE mkt_ret IS NOT NULL AND bond10_ret IS NOT NULL GROUP BY source_id")
def a3_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret", "bond10_ret").dropna(subset=["mkt_ret", "bond10_ret"]).groupBy("source_id").agg(r6(w.corr(R(), B())).alias("rho"))


_RANKS = "rank() OVER (PARTITION BY source_id ORDER BY {0}) + (count(*) OVER (PARTITION BY source_id, {0}) - 1) / 2"


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')}, k AS (SELECT source_id, {_RANKS.format('mkt_ret')} AS a, {_RANKS.format('bond10_ret')} AS b FROM p WHERE mkt_ret IS NOT NULL AND bond10_ret IS NOT NULL) SELECT source_id, {s6('corr(a, b)')} AS rho FROM k GROUP BY source_id")
def a4_spearman(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder, "mkt_ret", "bond10_ret").dropna(subset=["mkt_ret", "bond10_ret"])
    rank = lambda c: F.rank().over(Window.partitionBy("source_id").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("source_id", c)) - 1) / 2
    return rows.withColumns({"a": rank("mkt_ret"), "b": rank("bond10_ret")}).groupBy("source_id").agg(r6(w.corr(F.col("a"), F.col("b"))).alias("rho"))


_M = "avg(mkt_ret) OVER (PARTITION BY source_id)"


@query(f"""WITH {daily_sql('mkt_ret')}, d AS (SELECT source_id, mkt_ret - {_M} AS e FROM p WHERE mkt_ret IS NOT NULL),
m AS (SELECT source_id, count(*)::DOUBLE AS n, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM d GROUP BY ALL)
SELECT source_id, {s6('m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2)')} AS skew, {s6('(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)')} AS kurtosis FROM m""")
def a6_bias_corrected_shape(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").groupBy("source_id").agg(r6(stats.bias_corrected_skew(R())).alias("skew"), r6(stats.bias_corrected_kurtosis(R())).alias("kurtosis"))


@query(f"WITH {daily_sql('mkt_ret')} SELECT source_id, {s6('quantile_cont(mkt_ret, 0.05)')} AS q05, {s6('quantile_cont(mkt_ret, 0.95)')} AS q95, {s6('median(mkt_ret)')} AS median FROM p GROUP BY source_id")
def a7_a8_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").groupBy("source_id").agg(r6(stats.quantile(R(), 0.05)).alias("q05"), r6(stats.quantile(R(), 0.95)).alias("q95"), r6(stats.quantile(R(), 0.5)).alias("median"))


_MONTHS = f"""mr AS (SELECT source_id, last_day(date) AS month, product(1 + CASE WHEN mkt_ret > -1 AND mkt_ret < 1 THEN mkt_ret END) - 1 AS ret FROM p GROUP BY ALL),
e AS (SELECT source_id, min(date) AS a, max(date) AS z FROM p GROUP BY ALL), g AS (SELECT source_id, last_day(unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH))::DATE) AS month FROM e),
m AS (SELECT g.source_id, g.month, coalesce(ret, 0.0) AS ret FROM g LEFT JOIN mr USING (source_id, month))"""


def months(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.compound_months(daily(spark, folder, "mkt_ret").withColumn("ret", plausible(R())), ["source_id"], "date", "ret")


@query(f"WITH {daily_sql('mkt_ret')}, {_MONTHS} SELECT source_id, month, {s6('ret', 9)} AS ret FROM m")
def a9_a10_month_compounding(spark: SparkSession, folder: str) -> DataFrame:
    return months(spark, folder).select("source_id", "month", r6(F.col("ret"), 9).alias("ret"))


@query("SELECT region, clock, count(*) AS n, count(reading.value) AS defined, round(avg(rarity.level_percentile), 6) AS mean_percentile FROM (SELECT DISTINCT * FROM observation_log) GROUP BY ALL")
def a11_group_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observation_log").select("record_id", "region", "clock", F.col("reading.value").alias("v"), F.col("rarity.level_percentile").alias("q")).distinct()
    return rows.groupBy("region", "clock").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("defined"), F.round(F.avg("q"), 6).alias("mean_percentile"))


_ASSETS = ["mkt_ret", "bond10_ret", "gold_ret"]
_SB = f"""{daily_sql(*_ASSETS)}, {_STATE_SQL}, sb AS (SELECT s.*, mkt_ret, bond10_ret, gold_ret FROM s JOIN p USING (source_id, date))"""


def state_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = rolling.rolling_correlations(daily(spark, folder, *_ASSETS), ["source_id"], "date", {"c": ("mkt_ret", "bond10_ret")}, 63)
    return rows.withColumn("state", w.sign_state(F.col("c"))).where("state is not null")


@query("WITH " + _SB + ", l AS (" + " UNION ALL ".join(f"SELECT state, '{a}' AS asset, {a} AS r FROM sb WHERE {a} IS NOT NULL" for a in _ASSETS) + f") SELECT state, asset, count(*) AS n, {s6('avg(r) * 252')} AS ann_ret, {s6('stddev_samp(r) * sqrt(252)')} AS ann_vol, {s6('avg(r) / nullif(stddev_pop(r), 0) * sqrt(252)')} AS sharpe FROM l GROUP BY ALL HAVING count(*) >= 120")
def a12_asset_behaviour_by_state(spark: SparkSession, folder: str) -> DataFrame:
    r = F.col("r")
    long = xs.to_long(state_rows(spark, folder), ["state"], _ASSETS, "asset", "r").where("r is not null")
    return long.groupBy("state", "asset").agg(F.count(F.lit(1)).alias("n"), r6(stats.annual_return(r)).alias("ann_ret"), r6(stats.annual_vol(r)).alias("ann_vol"), r6(stats.sharpe(r)).alias("sharpe")).where("n >= 120")


@query(f"WITH {_SB} SELECT state, count(*) AS n, {s6('avg((bond10_ret < 0)::INT)')} AS share_also_fell, {s6('avg(bond10_ret)', 9)} AS mean_hedge FROM sb WHERE mkt_ret < 0 AND bond10_ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 60")
def a13_hedge_by_state(spark: SparkSession, folder: str) -> DataFrame:
    rows = state_rows(spark, folder).where("mkt_ret < 0 and bond10_ret is not null")
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), r6(stats.share(B() < 0)).alias("share_also_fell"), r6(F.avg(B()), 9).alias("mean_hedge")).where("n >= 60")


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')}, {_STATE_SQL}, k AS (SELECT source_id, count(*) FILTER (state = 'intact') AS intact, count(*) FILTER (state = 'under_test') AS under_test, count(*) FILTER (state = 'violated') AS violated FROM s GROUP BY ALL) SELECT *, intact >= 24 AND under_test >= 24 AND violated >= 24 AS passed FROM k")
def a14_power_gate(spark: SparkSession, folder: str) -> DataFrame:
    n = {s: F.count_if(F.col("state") == s) for s in ("intact", "under_test", "violated")}
    return states(spark, folder).groupBy("source_id").agg(*[c.alias(s) for s, c in n.items()]).withColumn("passed", F.least("intact", "under_test", "violated") >= 24)


@query("WITH y AS (SELECT region, year(as_of::DATE) AS y, avg(rarity.level_percentile) AS v FROM (SELECT DISTINCT * FROM observation_log) GROUP BY ALL), u AS (SELECT region, v >= lag(v) OVER (PARTITION BY region ORDER BY y) - 1e-12 AS up FROM y) SELECT region, coalesce(bool_and(up), true) AS monotone FROM u GROUP BY ALL")
def a15_monotone_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observation_log").select("record_id", "region", F.year(F.to_date("as_of")).alias("y"), F.col("rarity.level_percentile").alias("q")).distinct()
    return runs.monotone(rows.groupBy("region", "y").agg(F.avg("q").alias("v")), ["region"], "y", "v")


@query("WITH n AS (SELECT clock, maturity, count(*) AS n FROM (SELECT DISTINCT record_id, clock, maturity FROM observation_log) GROUP BY ALL) SELECT clock, maturity, n, round(n / sum(n) OVER (PARTITION BY clock), 6) AS share FROM n")
def a16_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "observation_log").select("record_id", "clock", "maturity").distinct().groupBy("clock", "maturity").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("clock")), 6))


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')}, {_STATE_SQL}, t AS (SELECT lag(state) {SEQ} AS was, state AS now FROM s), c AS (SELECT was, now, count(*) AS n FROM t WHERE was IS NOT NULL GROUP BY ALL) SELECT was, now, n, round(n / sum(n) OVER (PARTITION BY was), 6) AS share FROM c")
def a17_transition_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return runs.transitions(states(spark, folder), ["source_id"], "date", "state").withColumn("share", F.round("share", 6))


@query(f"WITH {daily_sql('mkt_ret', 'gold_ret')} SELECT source_id, min_by(date, struct_pack(v := mkt_ret, d := date)) AS worst_day, max_by(date, struct_pack(v := mkt_ret, d := date)) AS best_day, min(date) FILTER (gold_ret IS NOT NULL) AS gold_from FROM p WHERE mkt_ret IS NOT NULL GROUP BY ALL")
def a18_argmin_argmax(spark: SparkSession, folder: str) -> DataFrame:
    at = F.struct("mkt_ret", "date")
    return daily(spark, folder, "mkt_ret", "gold_ret").where("mkt_ret is not null").groupBy("source_id").agg(F.min_by("date", at).alias("worst_day"), F.max_by("date", at).alias("best_day"), F.min(F.when(F.col("gold_ret").isNotNull(), F.col("date"))).alias("gold_from"))


@query("SELECT source_id, date, min(load_id) AS first_load, count(DISTINCT load_id) AS loads FROM assets_daily GROUP BY ALL")
def a19_keep_first_load(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "assets_daily").groupBy("source_id", "date").agg(F.min("load_id").alias("first_load"), F.countDistinct("load_id").alias("loads"))


_SPANS = ["mkt_ret", "bond10_ret", "gold_ret", "smb"]


@query(f"WITH {daily_sql(*_SPANS)} " + " UNION ALL ".join(f"SELECT source_id, '{c}' AS \"column\", min(date) FILTER ({c} IS NOT NULL) AS first_valid, max(date) FILTER ({c} IS NOT NULL) AS last_valid, count(*) FILTER ({c} IS NULL) AS nulls FROM p GROUP BY source_id" for c in _SPANS))
def a20_column_spans(spark: SparkSession, folder: str) -> DataFrame:
    d = F.when(F.col("x").isNotNull(), F.col("date"))
    long = xs.to_long(daily(spark, folder, *_SPANS), ["source_id", "date"], _SPANS, "column")
    return long.groupBy("source_id", "column").agg(F.min(d).alias("first_valid"), F.max(d).alias("last_valid"), F.count_if(F.col("x").isNull()).alias("nulls"))


@query(f"WITH {NATION_MONTHS_SQL}, s AS (SELECT month, revenue / sum(revenue) OVER (PARTITION BY month) AS s FROM nm) SELECT month, {s6('1 / sum(s * s)')} AS eff_n, {s6('max(s)')} AS top_share, count(*) AS entities FROM s GROUP BY ALL")
def a21_effective_number(spark: SparkSession, folder: str) -> DataFrame:
    return xs.concentration(nation_months(spark, folder), ["month"], "revenue").select("month", r6(F.col("eff_n")).alias("eff_n"), r6(F.col("top_share")).alias("top_share"), "entities")


@query(f"WITH {daily_sql('mkt_ret')}, c AS (SELECT source_id, date, avg((mkt_ret > 0)::INT) {EVER} AS s, count(mkt_ret) {EVER} AS n FROM p WHERE mkt_ret IS NOT NULL) SELECT source_id, date, CASE WHEN n >= 63 THEN round(s, 12) END AS share_up FROM c")
def a22_share_with_minimum(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").where("mkt_ret is not null").select("source_id", "date", r6(A.expanding(F.avg, (R() > 0).cast("double"), 63), 12).alias("share_up"))


@query(f"WITH {_SB}, g AS (SELECT state, count(*) AS n, avg(gold_ret) AS m FROM sb WHERE gold_ret IS NOT NULL GROUP BY ALL), t AS (SELECT avg(gold_ret) AS m, var_pop(gold_ret) * count(*) AS ss FROM sb WHERE gold_ret IS NOT NULL) SELECT {s6('sum(g.n * (g.m - t.m) * (g.m - t.m)) / max(t.ss)', 8)} AS eta2 FROM g, t")
def a23_correlation_ratio(spark: SparkSession, folder: str) -> DataFrame:
    rows = state_rows(spark, folder).where("gold_ret is not null").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("gold_ret").alias("s"), F.sum(F.col("gold_ret") * F.col("gold_ret")).alias("q"))
    total = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    centre = F.col("s") * F.col("s") / F.col("n")
    return total.select(r6((F.col("between") - centre) / (F.col("q") - centre), 8).alias("eta2"))


_DETECT = "x AS (SELECT source_id, mkt_ret < -0.01 AS truth, lag(mkt_ret) OVER (PARTITION BY source_id ORDER BY date) < 0 AS flag FROM p)"


def detections(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").select("source_id", (R() < -0.01).alias("truth"), (A.lag(R()) < 0).alias("flag"))


@query(f"""WITH {daily_sql('mkt_ret')}, {_DETECT} SELECT source_id, {s6('count(*) FILTER (flag AND truth) / nullif(count(*) FILTER (flag), 0)')} AS precision, {s6('count(*) FILTER (flag AND truth) / nullif(count(*) FILTER (truth), 0)')} AS recall,
{s6('(count(*) FILTER (flag AND truth) / nullif(count(*) FILTER (truth), 0) + count(*) FILTER (NOT flag AND NOT truth) / nullif(count(*) FILTER (NOT truth), 0)) / 2')} AS bac FROM x WHERE flag IS NOT NULL AND truth IS NOT NULL GROUP BY ALL""")
def a24_detector_scores(spark: SparkSession, folder: str) -> DataFrame:
    f, t = F.col("flag"), F.col("truth")
    return detections(spark, folder).dropna(subset=["flag", "truth"]).groupBy("source_id").agg(r6(stats.precision(f, t)).alias("precision"), r6(stats.recall(f, t)).alias("recall"), r6(stats.balanced_accuracy(f, t)).alias("bac"))


_FC = f"fc AS (SELECT source_id, date, mkt_ret AS y, {guarded('avg', 'mkt_ret', 21)} AS f0 FROM p), fo AS (SELECT source_id, y, lag(f0) OVER (PARTITION BY source_id ORDER BY date) AS f, 1 / (1 + exp(-100 * lag(f0) OVER (PARTITION BY source_id ORDER BY date))) AS q FROM fc)"


@query(f"""WITH {daily_sql('mkt_ret')}, {_FC} SELECT source_id, {s6('sqrt(avg((y - f) * (y - f)))')} AS rmse, {s6('avg(abs(y - f))')} AS mae, {s6('1 - sum((y - f) * (y - f)) / nullif(var_pop(y) * count(*), 0)')} AS r2,
{s6('avg(pow((y > 0)::INT - q, 2))')} AS brier, {s6('-avg(CASE WHEN y > 0 THEN ln(greatest(least(q, 1 - 1e-12), 1e-12)) ELSE ln(1 - greatest(least(q, 1 - 1e-12), 1e-12)) END)')} AS log_loss FROM fo WHERE y > -1 AND f IS NOT NULL GROUP BY ALL""")
def a25_forecast_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder, "mkt_ret").withColumn("f0", A.mean(R(), 21)).select("source_id", R().alias("y"), A.lag(F.col("f0")).alias("f")).where("y > -1 and f is not null").withColumn("q", 1 / (1 + F.exp(-100 * F.col("f"))))
    y, f, q, up = F.col("y"), F.col("f"), F.col("q"), F.col("y") > 0
    return rows.groupBy("source_id").agg(r6(stats.rmse(y, f)).alias("rmse"), r6(stats.mae(y, f)).alias("mae"), r6(1 - F.sum(F.pow(y - f, 2)) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"), r6(stats.brier(up, q)).alias("brier"), r6(stats.log_loss(up, q)).alias("log_loss"))


@query(f"""WITH {daily_sql('mkt_ret')}, {_FC}, k AS (SELECT source_id, y > 0 AS up, rank() OVER (PARTITION BY source_id ORDER BY f) + (count(*) OVER (PARTITION BY source_id, f) - 1) / 2 AS r FROM (SELECT source_id, y, round(f, 12) AS f FROM fo WHERE y IS NOT NULL AND f IS NOT NULL))
SELECT source_id, {s6('(sum(r) FILTER (up) - count(*) FILTER (up) * (count(*) FILTER (up) + 1) / 2) / nullif(count(*) FILTER (up) * count(*) FILTER (NOT up), 0)')} AS auc FROM k GROUP BY ALL""")
def a25_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Area under the curve by rank sum, ties at their mean rank."""
    rows = daily(spark, folder, "mkt_ret").withColumn("f0", A.mean(R(), 21)).select("source_id", (R() > 0).alias("up"), F.round(A.lag(F.col("f0")), 12).alias("f")).dropna(subset=["up", "f"])
    rank = F.rank().over(Window.partitionBy("source_id").orderBy("f")) + (F.count(F.lit(1)).over(Window.partitionBy("source_id", "f")) - 1) / 2
    n1, n0 = F.count_if("up"), F.count_if(~F.col("up"))
    return rows.withColumn("r", rank).groupBy("source_id").agg(r6((F.sum(F.when(F.col("up"), F.col("r"))) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0))).alias("auc"))


@query("""WITH c AS (SELECT clock AS a, maturity AS b, count(*) AS n FROM (SELECT DISTINCT record_id, clock, maturity FROM observation_log WHERE clock IS NOT NULL AND maturity IS NOT NULL) GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS i, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS j, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT round((ij - i * j / t) / nullif((i + j) / 2 - i * j / t, 0), 6) + 0.0 AS ari FROM s""")
def a26_adjusted_rand(spark: SparkSession, folder: str) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency table."""
    c = table(spark, folder, "observation_log").where("clock is not null and maturity is not null").select("record_id", "clock", "maturity").distinct()
    n = c.groupBy("clock", "maturity").agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    ij = n.agg(F.sum(two(F.col("n"))).alias("ij"), two(F.sum("n")).alias("t"))
    side = lambda k, name: n.groupBy(k).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(name))
    s = ij.unionByName(side("clock", "i"), allowMissingColumns=True).unionByName(side("maturity", "j"), allowMissingColumns=True).agg(*[F.sum(c).alias(c) for c in ("ij", "t", "i", "j")])
    by_chance = F.col("i") * F.col("j") / F.col("t")
    return s.select(r6((F.col("ij") - by_chance) / F.nullif((F.col("i") + F.col("j")) / 2 - by_chance, F.lit(0.0))).alias("ari"))


@query(f"""WITH {daily_sql('mkt_ret', 'bond10_ret')}, q AS (SELECT source_id, date, mkt_ret * 100 AS a, bond10_ret * 100 AS b, (mkt_ret > bond10_ret)::INT AS l FROM p WHERE mkt_ret IS NOT NULL AND bond10_ret IS NOT NULL),
d AS (SELECT x.source_id, x.date, x.l, y.l AS m, sum(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) AS total, count(*) AS n FROM q x JOIN q y USING (source_id) GROUP BY ALL),
s AS (SELECT source_id, date, max(CASE WHEN l = m AND n > 1 THEN total / (n - 1) END) AS own, min(CASE WHEN l <> m THEN total / n END) AS other FROM d GROUP BY ALL)
SELECT source_id, count(*) AS n, {s6('avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / nullif(greatest(own, other), 0) END)')} AS silhouette FROM s WHERE other IS NOT NULL GROUP BY ALL""")
def a26_silhouette(spark: SparkSession, folder: str) -> DataFrame:
    """Mean silhouette of the days on which the market or the bond did better, by their two returns in per cent."""
    rows = daily(spark, folder, "mkt_ret", "bond10_ret").where("mkt_ret is not null and bond10_ret is not null")
    rows = rows.select("source_id", "date", (R() * 100).alias("a"), (B() * 100).alias("b"), (R() > B()).cast("int").alias("l"))
    return xs.silhouettes(rows, ["source_id"], "date", ["a", "b"], "l").select("source_id", "n", r6(F.col("silhouette")).alias("silhouette"))


@query(f"WITH {daily_sql('mkt_ret')}, {_EQUITY}, d AS (SELECT source_id, eq / max(eq) {EVER} - 1 AS dd FROM e) SELECT source_id, {s6('min(dd)')} AS max_drawdown FROM d GROUP BY ALL")
def a27_max_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    e = equity(daily(spark, folder, "mkt_ret")).withColumn("dd", F.col("eq") / F.max("eq").over(A.ever()) - 1)
    return e.groupBy("source_id").agg(r6(F.min("dd")).alias("max_drawdown"))


@query(f"WITH {daily_sql('mkt_ret', 'rf')} SELECT source_id, {s6('CASE WHEN stddev_pop(mkt_ret - rf) < 1e-12 THEN 0 ELSE avg(mkt_ret - rf) / stddev_pop(mkt_ret - rf) * sqrt(252) END')} AS sharpe FROM p GROUP BY ALL")
def a28_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret", "rf").groupBy("source_id").agg(r6(stats.sharpe(R() - F.col("rf"))).alias("sharpe"))


_FEE = """q AS (SELECT source_id, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS qa, avg(b * b) AS qb FROM (SELECT source_id, mkt_ret AS a, bond10_ret AS b FROM p WHERE mkt_ret > -1 AND mkt_ret < 1 AND bond10_ret > -1 AND bond10_ret < 1) GROUP BY ALL),
u AS (SELECT source_id, 5 / 12.0 AS k, 1 + ma AS ga, (1 + ma) - 5 / 12.0 * (1 + 2 * ma + qa) AS ua, (1 + mb) - 5 / 12.0 * (1 + 2 * mb + qb) AS ub FROM q)"""


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')}, {_FEE} SELECT source_id, {s6('(-(1 - 2 * k * ga) + sqrt(pow(1 - 2 * k * ga, 2) + 4 * k * (ua - ub))) / (2 * k)', 7)} AS fee FROM u")
def a29_utility_fee(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder, "mkt_ret", "bond10_ret").where("mkt_ret > -1 and mkt_ret < 1 and bond10_ret > -1 and bond10_ret < 1")
    return rows.groupBy("source_id").agg(F.avg(R()).alias("ma"), F.avg(B()).alias("mb"), F.avg(R() * R()).alias("qa"), F.avg(B() * B()).alias("qb")).select("source_id", r6(stats.fee_root(F.col("ma"), F.col("mb"), F.col("qa"), F.col("qb"), 5.0), 7).alias("fee"))


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')}, {_RUNS_SQL} SELECT source_id, count(*) - 1 AS switches, {s6('(count(*) - 1) * 252 / sum(length)')} AS per_year, {s6('avg(length)')} AS mean_dwell, median(length) AS median_dwell FROM u GROUP BY ALL")
def a30_switches_and_dwell(spark: SparkSession, folder: str) -> DataFrame:
    return runs.switches(states(spark, folder), ["source_id"], "date", "state").select("source_id", "switches", r6(F.col("per_year")).alias("per_year"), r6(F.col("mean_dwell")).alias("mean_dwell"), "median_dwell")


@query("SELECT assumption_monitored, region, count(DISTINCT signal) AS signals, count(DISTINCT maturity) > 1 AS conflict FROM observation_log GROUP BY ALL")
def a31_group_with_conflict(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observation_log").groupBy("assumption_monitored", "region").agg(F.countDistinct("signal").alias("signals"), (F.countDistinct("maturity") > 1).alias("conflict"))


_HITS = "h AS (SELECT source_id, (mkt_ret < -0.02)::INT AS e, lag((mkt_ret < -0.02)::INT) OVER (PARTITION BY source_id ORDER BY date) AS b FROM p WHERE mkt_ret IS NOT NULL)"
_LL = "CASE WHEN {0} > 0 THEN {0} * ln({1}) ELSE 0 END"


@query(f"""WITH {daily_sql('mkt_ret')}, {_HITS}, n AS (SELECT source_id, (count(*) FILTER (b = 0 AND e = 0))::DOUBLE AS n00, (count(*) FILTER (b = 0 AND e = 1))::DOUBLE AS n01, (count(*) FILTER (b = 1 AND e = 0))::DOUBLE AS n10, (count(*) FILTER (b = 1 AND e = 1))::DOUBLE AS n11 FROM h GROUP BY ALL)
SELECT source_id, {s6('2 * (' + ' + '.join(_LL.format(a, b) for a, b in (('n00', 'n00 / (n00 + n01)'), ('n01', 'n01 / (n00 + n01)'), ('n10', 'n10 / (n10 + n11)'), ('n11', 'n11 / (n10 + n11)'))) + ' - ' + _LL.format('(n00 + n10)', '(n00 + n10) / (n00 + n01 + n10 + n11)') + ' - ' + _LL.format('(n01 + n11)', '(n01 + n11) / (n00 + n01 + n10 + n11)') + ')')} AS lr FROM n""")
def a32_independence_test(spark: SparkSession, folder: str) -> DataFrame:
    """Likelihood ratio of first-order dependence of exceedances; its tail probability is ``inference.chi2_tail``."""
    from chronoplane.operators.inference import independence_ratio

    rows = daily(spark, folder, "mkt_ret").where("mkt_ret is not null").withColumn("e", (R() < -0.02).cast("int"))
    return independence_ratio(rows, ["source_id"], "date", "e").withColumn("lr", r6(F.col("lr")))


# -- cross-section -----------------------------------------------------------------------------------------------------
_IND_SUM = " + ".join(INDUSTRIES)


@query(f"WITH {daily_sql(*INDUSTRIES)} SELECT source_id, date, {s6(f'({_IND_SUM}) / 10', 9)} AS common, {s6(f'ind_hitec - ({_IND_SUM}) / 10', 9)} AS divergence_hitec FROM p")
def x1_x2_common_and_divergence(spark: SparkSession, folder: str) -> DataFrame:
    c = xs.common(INDUSTRIES)
    return daily(spark, folder, *INDUSTRIES).select("source_id", "date", r6(c, 9).alias("common"), r6(F.col("ind_hitec") - c, 9).alias("divergence_hitec"))


FOUR = ["ind_nodur", "ind_enrgy", "ind_hitec", "ind_hlth"]
_FULL4 = " AND ".join(f"{c} IS NOT NULL" for c in FOUR)
_PAIRS = [(a, b) for n, a in enumerate(FOUR) for b in FOUR[n + 1 :]]
_PAIR_SQL = "pr AS (" + " UNION ALL ".join(f"SELECT source_id, date, '{a}' AS i, '{b}' AS j, CASE WHEN count(CASE WHEN {_FULL4} THEN 1 END) {last(63)} = 63 THEN corr({a}, {b}) {last(63)} END AS rho FROM p" for a, b in _PAIRS) + ")"


@query(f"WITH {daily_sql(*FOUR)}, {_PAIR_SQL} SELECT source_id, date, i, j, {s6('rho', 5)} AS rho FROM pr")
def w23_rolling_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return xs.pairwise_correlation(daily(spark, folder, *FOUR), ["source_id"], "date", FOUR, 63).withColumn("rho", r6(F.col("rho"), 5))


@query(f"""WITH {daily_sql(*FOUR)}, {_PAIR_SQL}, q AS (SELECT source_id, date, CASE WHEN isfinite(rho) THEN rho END AS rho FROM pr), m AS (SELECT source_id, date, count(rho) AS n, avg(rho) AS r, sum(rho * rho) AS s FROM q GROUP BY ALL)
SELECT source_id, date, {s6('CASE WHEN n = 6 THEN r END', 5)} AS mean_rho, {s6('CASE WHEN n = 6 THEN CASE WHEN 2 * s < 1e-12 THEN 0 ELSE sqrt(greatest(s - 6 * r * r, 0) / s) END END', 4)} AS residual_share, {s6('CASE WHEN n = 6 THEN atanh(r) END', 4)} AS z FROM m""")
def x3_x4_matrix_measures(spark: SparkSession, folder: str) -> DataFrame:
    pairs = xs.pairwise_correlation(daily(spark, folder, *FOUR), ["source_id"], "date", FOUR, 63)
    return xs.matrix_measures(pairs, ["source_id", "date"]).select("source_id", "date", r6(F.col("mean_rho"), 5).alias("mean_rho"), r6(F.col("residual_share"), 4).alias("residual_share"), r6(F.col("z"), 4).alias("z"))


_LV = {c: f"ln(CASE WHEN CASE WHEN count({c}) {last(21)} = 21 THEN stddev_samp({c}) {last(21)} END > 1e-9 THEN stddev_samp({c}) {last(21)} * sqrt(252) END)" for c in FOUR}


@query(f"WITH {daily_sql(*FOUR)} SELECT source_id, date, " + ", ".join(f"{s6(v)} AS {c}" for c, v in _LV.items()) + " FROM p")
def x5_log_vol_panel(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, *FOUR).select("source_id", "date", *[r6(v).alias(c) for c, v in xs.log_vol(A, FOUR).items()])


@query("SELECT i.range AS i, j.range AS j, n.n, r.r::DOUBLE AS rho, CASE WHEN i.range = j.range THEN 1.0 ELSE r.r END::DOUBLE AS x FROM (VALUES (3), (5)) n(n), (VALUES (-0.05), (0.0), (0.5)) r(r), range(5) i, range(5) j WHERE i.range < n.n AND j.range < n.n")
def x6_equicorrelation(spark: SparkSession, folder: str) -> DataFrame:
    """Matrices with ones on the diagonal and one correlation elsewhere, for fixed sizes and correlations."""
    grid = spark.sql("SELECT i, j, n, rho FROM VALUES (3), (5) AS n(n) LATERAL VIEW explode(array(-0.05d, 0.0d, 0.5d)) AS rho LATERAL VIEW explode(sequence(0L, n - 1L)) AS i LATERAL VIEW explode(sequence(0L, n - 1L)) AS j")
    return grid.withColumn("x", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("rho")))


_PRICE = "pp AS (SELECT source_id, date, " + ", ".join(f"CASE WHEN {c} > -1 THEN exp(sum(CASE WHEN {c} > -1 THEN ln(1 + {c}) END) {EVER}) END AS {c}" for c in FOUR) + " FROM p)"
_ABOVE = ", ".join(f"CASE WHEN {c} IS NOT NULL AND count({c}) {last(50)} = 50 THEN ({c} > avg({c}) {last(50)})::INT END AS {c}" for c in FOUR)


@query(f"WITH {daily_sql(*FOUR)}, {_PRICE}, f AS (SELECT source_id, date, {_ABOVE} FROM pp) SELECT source_id, date, round(({' + '.join(f'coalesce({c}, 0)' for c in FOUR)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in FOUR)}, 0), 6) AS breadth FROM f")
def x7_x11_breadth(spark: SparkSession, folder: str) -> DataFrame:
    rows = xs.with_prices(daily(spark, folder, *FOUR), ["source_id"], "date", FOUR)
    return rows.select("source_id", "date", r6(xs.breadth(rows, ["source_id"], "date", FOUR, 50)).alias("breadth"))


_CUM = {c: f"abs(exp(CASE WHEN count(CASE WHEN {c} > -1 THEN 1 END) {last(20)} = 20 THEN sum(CASE WHEN {c} > -1 THEN ln(1 + {c}) END) {last(20)} END) - 1)" for c in FOUR}


@query(f"WITH {daily_sql(*FOUR)}, c AS (SELECT source_id, date, " + ", ".join(f"{v} AS {c}" for c, v in _CUM.items()) + f" FROM p) SELECT source_id, date, {s6('(' + ' + '.join(f'{c} * {c}' for c in FOUR) + ') / nullif(pow(' + ' + '.join(FOUR) + ', 2), 0)')} AS herfindahl FROM c")
def x8_leadership_herfindahl(spark: SparkSession, folder: str) -> DataFrame:
    cum = {c: F.abs(F.exp(A.total(F.log1p(F.when(F.col(c) > -1, F.col(c))), 20)) - 1) for c in FOUR}
    rows = daily(spark, folder, *FOUR).select("source_id", "date", *[v.alias(c) for c, v in cum.items()])
    total, squares = sum((F.col(c) for c in FOUR[1:]), F.col(FOUR[0])), sum((F.col(c) * F.col(c) for c in FOUR[1:]), F.col(FOUR[0]) * F.col(FOUR[0]))
    return rows.select("source_id", "date", r6(squares / F.nullif(total * total, F.lit(0.0))).alias("herfindahl"))


_IND_LONG = "l AS (" + " UNION ALL ".join(f"SELECT source_id, date, {c} AS x FROM p" for c in INDUSTRIES) + ")"


@query(f"WITH {daily_sql(*INDUSTRIES)}, {_IND_LONG}, d AS (SELECT source_id, date, stddev_samp(x) AS s FROM l GROUP BY ALL) SELECT source_id, date, {s6('s')} AS dispersion, {s6(guarded('avg', 's', 20))} AS dispersion_20 FROM d")
def x9_dispersion(spark: SparkSession, folder: str) -> DataFrame:
    """Spread across the columns of a row: their moments are taken row by row, without unpivoting."""
    x = F.filter(F.array(*INDUSTRIES), lambda v: v.isNotNull())
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    rows = daily(spark, folder, *INDUSTRIES).withColumn("s", F.when(n > 1, F.sqrt(square / F.nullif(n - 1, F.lit(0)))))
    return rows.select("source_id", "date", r6(F.col("s")).alias("dispersion"), r6(A.mean(F.col("s"), 20)).alias("dispersion_20"))


@query(f"WITH {NATION_MONTHS_SQL}, v AS (SELECT n_name, avg(revenue) AS m FROM nm GROUP BY ALL), k AS (SELECT n_name, m, row_number() OVER (ORDER BY m, n_name) - 1 AS i FROM v) SELECT n_name, least(floor(i * 3 / 25), 2)::INT AS third FROM k")
def x12_rank_merge(spark: SparkSession, folder: str) -> DataFrame:
    """25 entities (a fixed set) merged into three by rank of their mean."""
    v = nation_months(spark, folder).groupBy("n_name").agg(F.avg("revenue").alias("m"))
    i = F.row_number().over(Window.orderBy("m", "n_name")) - 1
    return v.select("n_name", F.least(F.floor(i * 3 / 25), F.lit(2)).cast("int").alias("third"))


@query(f"WITH {daily_sql('mkt_ret')}, q AS (SELECT source_id, quantile_cont(mkt_ret, 1 / 3.0) AS a, quantile_cont(mkt_ret, 2 / 3.0) AS b FROM p GROUP BY ALL) SELECT p.source_id, date, CASE WHEN mkt_ret IS NOT NULL THEN (mkt_ret >= round(a, 9))::INT + (mkt_ret >= round(b, 9))::INT END AS tercile FROM p JOIN q USING (source_id)")
def x13_terciles(spark: SparkSession, folder: str) -> DataFrame:
    whole = Window.partitionBy("source_id")
    edges = F.transform(F.percentile("mkt_ret", F.array(F.lit(1 / 3.0), F.lit(2 / 3.0))).over(whole), lambda e: F.round(e, 9))
    return daily(spark, folder, "mkt_ret").select("source_id", "date", w.digitize(R(), edges).alias("tercile"))


# -- calendar ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {bonds_sql('jp_y10')}, n AS (SELECT source_id, count(*) AS rows, count(DISTINCT month) AS months, date_diff('month', min(month), max(month)) + 1 AS span FROM b GROUP BY ALL)
SELECT source_id, 'no_gap' AS gate, months = span AS passed, months || '/' || span AS detail FROM n UNION ALL SELECT source_id, 'no_duplicate', rows = months, rows || '/' || months FROM n""")
def tg5_contiguous_grid(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.grid_gaps(bonds(spark, folder, "jp_y10"), ["source_id"], "month")


@query("""WITH d AS (SELECT DISTINCT as_of::DATE AS d FROM observation_log)
SELECT d AS day, strftime(last_day(d) + 15, '%Y-%m-%d') || 'T14:00:00Z' AS month_15, strftime(d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END, '%Y-%m-%d') || 'T13:00:00Z' AS next_business_day,
strftime(last_day(d) + 35, '%Y-%m-%d') || 'T13:30:00Z' AS month_end_35, strftime(last_day(d) + 20, '%Y-%m-%d') || 'T12:00:00Z' AS month_20, strftime(last_day(last_day(d) + 1), '%Y-%m-%d') || 'T12:00:00Z' AS next_month_end FROM d""")
def b1_availability_policies(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "observation_log").select(F.to_date("as_of").alias("day")).distinct()
    return days.select("day", *[calendar.available_at(F.col("day"), p).alias(p) for p in calendar.POLICIES])


@query(f"WITH {daily_sql('gold_ret')} SELECT source_id, last_day(date) AS month, max_by(gold_ret, date) AS gold_ret FROM p WHERE gold_ret IS NOT NULL GROUP BY ALL")
def a10_last_of_month(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.last_of_month(daily(spark, folder, "gold_ret"), ["source_id"], "date", "gold_ret")


@query("SELECT n_name, c_mktsegment, count(*) AS n, grouping_id(n_name, c_mktsegment) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def a34_cube(spark: SparkSession, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).cube("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


@query("SELECT n_name, c_mktsegment, count(*) AS n, grouping_id(n_name, c_mktsegment) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def a34_rollup(spark: SparkSession, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())")
def a34_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    sets = [[F.col("c_nationkey")], [F.col("c_mktsegment")], []]
    return table(spark, folder, "customer").groupingSets(sets, "c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT region, count(DISTINCT sha256) AS exact, true AS near FROM observation_log GROUP BY ALL")
def a34_approximate_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct digests per region, and whether the sketch (two per cent of deviation) comes within eight per cent or two."""
    exact, near = F.countDistinct("sha256"), F.approx_count_distinct("sha256", 0.02)
    out = table(spark, folder, "observation_log").groupBy("region").agg(exact.alias("exact"), near.alias("about"))
    return out.select("region", "exact", (F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.08 * F.col("exact"))).alias("near"))
