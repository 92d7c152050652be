"""Window functions (W) along the feeds of the daily panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplane.functions import windows as w
from chronoplane.operators import rolling, runs
from chronoplane.operators import sequential as seq
from chronoplane.plans.panels import bonds, bonds_sql, daily, daily_sql
from chronoplane.plans.registry import query, r6, s6

A = w.Along("source_id", "date")
KEYS = ["source_id", "date"]


def last(k: int) -> str:
    return f"OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def ahead(k: int) -> str:
    return f"OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"


EVER = "OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SEQ = "OVER (PARTITION BY source_id ORDER BY date)"


def guarded(agg: str, col: str, k: int) -> str:
    return f"CASE WHEN count({col}) {last(k)} = {k} THEN {agg}({col}) {last(k)} END"


VOL21 = f"{guarded('stddev_samp', 'mkt_ret', 21)} * sqrt(252)"


@query(f"WITH {daily_sql('mkt_ret')} SELECT source_id, date, {s6(VOL21)} AS vol FROM p")
def w1_realized_vol(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").select(*KEYS, r6(A.realized_vol(F.col("mkt_ret"))).alias("vol"))


@query(f"""WITH {daily_sql('mkt_ret')} SELECT source_id, date, {s6(guarded('avg', 'mkt_ret', 12), 13)} AS mean_12, {s6(guarded('sum', 'mkt_ret', 12))} AS sum_12,
{s6(guarded('avg', 'mkt_ret', 200), 13)} AS mean_200, {s6(f'sum(mkt_ret) {EVER}')} AS running FROM p""")
def w2_rolling_mean_sum(spark: SparkSession, folder: str) -> DataFrame:
    r = F.col("mkt_ret")
    return daily(spark, folder, "mkt_ret").select(*KEYS, r6(A.mean(r, 12), 13).alias("mean_12"), r6(A.total(r, 12)).alias("sum_12"), r6(A.mean(r, 200), 13).alias("mean_200"), r6(F.sum(r).over(A.ever())).alias("running"))


def _corr_sql(k: int) -> str:
    both = "CASE WHEN mkt_ret IS NOT NULL AND bond10_ret IS NOT NULL THEN"
    return f"CASE WHEN count({both} 1 END) {last(k)} = {k} THEN corr(mkt_ret, bond10_ret) {last(k)} END"


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')} SELECT source_id, date, {s6(_corr_sql(63), 5)} AS corr_63, {s6(_corr_sql(126), 5)} AS corr_126 FROM p")
def w3_rolling_corr(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder, "mkt_ret", "bond10_ret")
    for k in (63, 126):
        rows = rolling.rolling_correlations(rows, ["source_id"], "date", {f"corr_{k}": ("mkt_ret", "bond10_ret")}, k)
    return rows.select(*KEYS, *[r6(F.col(f"corr_{k}"), 5).alias(f"corr_{k}") for k in (63, 126)])


@query(f"WITH {daily_sql('mkt_ret')} SELECT source_id, date, {s6(f'CASE WHEN count(mkt_ret) {EVER} >= 252 THEN (mkt_ret - avg(mkt_ret) {EVER}) / nullif(stddev_samp(mkt_ret) {EVER}, 0) END')} AS z FROM p")
def w4_expanding_z(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").select(*KEYS, r6(A.expanding_z(F.col("mkt_ret"))).alias("z"))


@query(f"WITH {daily_sql('mkt_ret')} SELECT source_id, date, {s6('rank() OVER (PARTITION BY source_id ORDER BY mkt_ret) + (count(*) OVER (PARTITION BY source_id, mkt_ret) - 1) / 2')} AS rank, {s6('(rank() OVER (PARTITION BY source_id ORDER BY mkt_ret) + (count(*) OVER (PARTITION BY source_id, mkt_ret) - 1) / 2) / count(*) OVER (PARTITION BY source_id)')} AS pct FROM p WHERE mkt_ret IS NOT NULL")
def w6_full_sample_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder, "mkt_ret").where("mkt_ret is not null")
    whole = Window.partitionBy("source_id")
    rank = F.rank().over(whole.orderBy("mkt_ret")) + (F.count(F.lit(1)).over(Window.partitionBy("source_id", "mkt_ret")) - 1) / 2
    return rows.select(*KEYS, r6(rank).alias("rank"), r6(rank / F.count(F.lit(1)).over(whole)).alias("pct"))


@query(f"WITH {bonds_sql('jp_bond10_ret')} SELECT source_id, month, CASE WHEN count(jp_bond10_ret) OVER w >= 24 THEN round(quantile_cont(jp_bond10_ret, 0.8) OVER w, 6) + 0.0 END AS q80 FROM b WINDOW w AS (PARTITION BY source_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w7_expanding_quantile(spark: SparkSession, folder: str) -> DataFrame:
    out = seq.along_series(bonds(spark, folder, "jp_bond10_ret"), ["source_id"], "month", ["jp_bond10_ret"], lambda g: {"q80": seq.expanding_quantile(g["jp_bond10_ret"].to_numpy(float), 0.8, 24)}, "q80 double")
    return out.withColumn("q80", r6(F.col("q80")))


@query(f"WITH {daily_sql('mkt_ret')} SELECT source_id, date, {s6(f'avg((mkt_ret < 0)::INT) {EVER}', 12)} AS share_down FROM p")
def w8_expanding_share(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").select(*KEYS, r6(A.share_true(F.col("mkt_ret") < 0), 12).alias("share_down"))


@query(f"""WITH {daily_sql('mkt_ret', 'gold_ret')} SELECT source_id, date, lag(mkt_ret) {SEQ} AS lag_1, lead(mkt_ret) {SEQ} AS lead_1, {s6(f'mkt_ret - lag(mkt_ret, 5) {SEQ}')} AS diff_5,
{s6(f'(1 + gold_ret) / nullif(lag(1 + gold_ret) {SEQ}, 0) - 1')} AS growth, {s6(f'CASE WHEN gold_ret > -1 THEN ln(1 + gold_ret) END - lag(CASE WHEN gold_ret > -1 THEN ln(1 + gold_ret) END) {SEQ}')} AS log_diff FROM p""")
def w9_shifts(spark: SparkSession, folder: str) -> DataFrame:
    r, g = F.col("mkt_ret"), 1 + F.col("gold_ret")
    return daily(spark, folder, "mkt_ret", "gold_ret").select(*KEYS, A.lag(r).alias("lag_1"), F.lead(r).over(A.spec).alias("lead_1"), r6(A.change(r, 5)).alias("diff_5"), r6(A.growth(g)).alias("growth"), r6(A.log_change(g)).alias("log_diff"))


@query(f"WITH {bonds_sql('jp_y10')} SELECT source_id, month, lag(jp_y10, 1) OVER w AS known_1, lag(jp_y10, 5) OVER w AS known_5 FROM b WINDOW w AS (PARTITION BY source_id ORDER BY month)")
def w10_publication_lag(spark: SparkSession, folder: str) -> DataFrame:
    m = w.Along("source_id", "month")
    return bonds(spark, folder, "jp_y10").select("source_id", "month", m.lag(F.col("jp_y10"), 1).alias("known_1"), m.lag(F.col("jp_y10"), 5).alias("known_5"))


@query(f"WITH {daily_sql('gold_ret')} SELECT source_id, date, last_value(gold_ret IGNORE NULLS) {EVER} AS gold_ret FROM p")
def w11_forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "gold_ret").select(*KEYS, A.fill(F.col("gold_ret")).alias("gold_ret"))


_STATE_SQL = f"""s0 AS (SELECT source_id, date, {_corr_sql(63)} AS c FROM p),
s AS (SELECT source_id, date, c, CASE WHEN c < -0.1 THEN 'intact' WHEN c > 0.1 THEN 'violated' ELSE 'under_test' END AS state FROM s0 WHERE c IS NOT NULL AND NOT isnan(c))"""
_RUNS_SQL = f"""{_STATE_SQL},
g AS (SELECT *, sum(f) {SEQ} AS run FROM (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) {SEQ} THEN 1 ELSE 0 END AS f FROM s)),
u AS (SELECT source_id, run, state, min(date) AS start, max(date) AS "end", count(*) AS length FROM g GROUP BY ALL)"""


def states(spark: SparkSession, folder: str) -> DataFrame:
    rows = rolling.rolling_correlations(daily(spark, folder, "mkt_ret", "bond10_ret"), ["source_id"], "date", {"c": ("mkt_ret", "bond10_ret")}, 63)
    return rows.withColumn("state", w.sign_state(F.col("c"))).where("state is not null")


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')}, {_RUNS_SQL} SELECT source_id, run::INT AS run, state, start, \"end\", length FROM u")
def w12_contiguous_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.contiguous_runs(states(spark, folder), ["source_id"], "date", "state").withColumn("run", F.col("run").cast("int")).select("source_id", "run", "state", "start", "end", "length")


@query(f"""WITH {daily_sql('mkt_ret', 'bond10_ret')}, {_STATE_SQL}, t AS (SELECT source_id, date, state = 'violated' AS flag FROM s),
g AS (SELECT *, sum(f) {SEQ} AS run FROM (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) {SEQ} THEN 1 ELSE 0 END AS f FROM t)),
u AS (SELECT source_id, run, flag, count(*) AS length FROM g GROUP BY ALL), m AS (SELECT source_id, max(run) AS run FROM u GROUP BY ALL)
SELECT source_id, count(*) FILTER (flag) AS spells, median(length) FILTER (flag) AS median_length, max(length) FILTER (flag) AS longest,
  max(CASE WHEN u.run = m.run THEN CASE WHEN flag THEN length ELSE 0 END END) AS current,
  CASE WHEN count(*) FILTER (flag) > 0 THEN max(CASE WHEN u.run = m.run THEN CASE WHEN flag THEN 0 ELSE length END END) END AS rows_since
FROM u JOIN m USING (source_id) GROUP BY source_id""")
def w13_spells(spark: SparkSession, folder: str) -> DataFrame:
    flags = states(spark, folder).withColumn("flag", F.col("state") == "violated")
    return runs.spells(flags, ["source_id"], "date", "flag").drop("last_row")


@query(f"""WITH {daily_sql('mkt_ret')}, n AS (SELECT *, row_number() {SEQ} AS i FROM p), h AS (SELECT * FROM n WHERE mkt_ret < -0.02),
e AS (SELECT *, sum(f) {SEQ} AS episode FROM (SELECT *, CASE WHEN coalesce(i - lag(i) {SEQ} > 63, true) THEN 1 ELSE 0 END AS f FROM h))
SELECT source_id, episode::INT AS episode, min(date) AS start, max(date) AS "end", count(*) AS hot_rows FROM e GROUP BY ALL""")
def w14_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return runs.episodes(daily(spark, folder, "mkt_ret"), ["source_id"], "date", F.col("mkt_ret") < -0.02).withColumn("episode", F.col("episode").cast("int"))


@query(f"""WITH {daily_sql('mkt_ret')} SELECT source_id, date, {s6(f'CASE WHEN count(mkt_ret) {ahead(21)} = 21 THEN sum(mkt_ret) {ahead(21)} END')} AS next_sum,
{s6(f'CASE WHEN count(mkt_ret) {ahead(21)} = 21 THEN stddev_samp(mkt_ret) {ahead(21)} END')} AS next_std FROM p""")
def w15_forward_window(spark: SparkSession, folder: str) -> DataFrame:
    r = F.col("mkt_ret")
    return daily(spark, folder, "mkt_ret").select(*KEYS, r6(A.forward_sum(r, 21)).alias("next_sum"), r6(A.forward_std(r, 21)).alias("next_std"))


_BOTH = "CASE WHEN mkt_ret IS NOT NULL AND bond10_ret IS NOT NULL THEN 1 END"


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret')} SELECT source_id, date, {s6(f'CASE WHEN count({_BOTH}) {ahead(63)} >= 50 THEN corr(mkt_ret, bond10_ret) {ahead(63)} END', 5)} AS next_corr FROM p")
def w16_forward_corr(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret", "bond10_ret").select(*KEYS, r6(A.forward_correlation(F.col("mkt_ret"), F.col("bond10_ret"), 63), 5).alias("next_corr"))


@query(f"""WITH {daily_sql('mkt_ret')}, n AS (SELECT *, row_number() {SEQ} AS i FROM p),
f AS (SELECT a.source_id, a.date, b.i - a.i AS k, product(1 + coalesce(CASE WHEN b.mkt_ret > -1 AND b.mkt_ret < 1 THEN b.mkt_ret END, 0)) OVER (PARTITION BY a.source_id, a.date ORDER BY b.i) AS eq
      FROM n a JOIN n b ON a.source_id = b.source_id AND b.i BETWEEN a.i + 1 AND a.i + 21),
d AS (SELECT source_id, date, k, eq / max(eq) OVER (PARTITION BY source_id, date ORDER BY k) - 1 AS dd FROM f),
m AS (SELECT source_id, date, min(dd) AS dd FROM d GROUP BY ALL HAVING count(*) = 21)
SELECT p.source_id, p.date, {s6('CASE WHEN m.dd IS NOT NULL THEN least(m.dd, 0) END', 11)} AS next_drawdown FROM p LEFT JOIN m USING (source_id, date)""")
def w17_forward_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").select(*KEYS, r6(A.forward_drawdown(plausible(F.col("mkt_ret")), 21), 11).alias("next_drawdown"))


_EQUITY = f"e AS (SELECT source_id, date, product(1 + coalesce(CASE WHEN mkt_ret > -1 AND mkt_ret < 1 THEN mkt_ret END, 0)) {EVER} AS eq FROM p)"


def plausible(r: Column) -> Column:
    """Impossible returns (a total loss or a doubling in a day) are no returns."""
    return F.when((r > -1) & (r < 1), r)


def equity(rows: DataFrame) -> DataFrame:
    """Compounded value."""
    return rows.withColumn("eq", F.product(1 + F.coalesce(plausible(F.col("mkt_ret")), F.lit(0.0))).over(A.ever()))


@query(f"WITH {daily_sql('mkt_ret')}, {_EQUITY} SELECT source_id, date, {s6(f'eq / max(eq) {EVER} - 1', 10)} AS drawdown FROM e")
def w18_drawdown_path(spark: SparkSession, folder: str) -> DataFrame:
    e = equity(daily(spark, folder, "mkt_ret"))
    return e.select(*KEYS, r6(F.col("eq") / F.max("eq").over(A.ever()) - 1, 10).alias("drawdown"))


@query(f"""WITH {daily_sql('mkt_ret')}, v AS (SELECT source_id, date, {guarded('avg', 'mkt_ret', 21)} * 100 AS x FROM p), n AS (SELECT * FROM v WHERE x IS NOT NULL),
c AS (SELECT *, round(x - lag(x, 10) {SEQ}, 9) AS d FROM n)
SELECT source_id, date, {s6('d')} AS change, CASE WHEN d > 0.03 THEN 'rising' WHEN d < -0.03 THEN 'falling' WHEN d IS NOT NULL THEN 'flat' END AS direction FROM c""")
def w19_trend(spark: SparkSession, folder: str) -> DataFrame:
    valid = daily(spark, folder, "mkt_ret").withColumn("x", A.mean(F.col("mkt_ret"), 21) * 100).where("x is not null")
    moved = valid.withColumn("d", F.round(A.change(F.col("x"), 10), 9))
    return moved.select(*KEYS, r6(F.col("d")).alias("change"), w.direction(F.col("d"), 0.03).alias("direction"))


@query(f"""WITH {daily_sql('mkt_ret')}, v AS (SELECT * FROM p WHERE mkt_ret IS NOT NULL)
SELECT source_id, date, (sum((mkt_ret >= 0.02)::INT) {EVER})::BIGINT AS above, {s6(f'avg((mkt_ret >= 0.02)::INT) {EVER}', 12)} AS share, max(CASE WHEN mkt_ret >= 0.02 THEN date END) {EVER} AS last_date FROM v""")
def w20_extremes_to_date(spark: SparkSession, folder: str) -> DataFrame:
    hot = F.col("mkt_ret") >= 0.02
    return daily(spark, folder, "mkt_ret").where("mkt_ret is not null").select(*KEYS, A.count_true(hot).cast("long").alias("above"), r6(A.share_true(hot), 12).alias("share"), A.last_true(hot).alias("last_date"))


@query(f"""WITH {daily_sql('mkt_ret', 'bond10_ret')}, {_RUNS_SQL}, k AS (SELECT g.source_id, g.date, g.run, row_number() OVER (PARTITION BY g.source_id, g.run ORDER BY date) AS sofar FROM g),
j AS (SELECT k.source_id, k.date, CASE WHEN u.run = k.run THEN sofar ELSE u.length END AS len FROM k JOIN u ON u.source_id = k.source_id AND u.run <= k.run AND u.state = 'violated')
SELECT k.source_id, k.date, median(len) AS median_run, max(len) AS longest_run FROM k LEFT JOIN (SELECT * FROM j WHERE len >= 12) j USING (source_id, date) GROUP BY ALL""")
def w21_runs_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Median and longest violated run (12 rows or more) known at each date: finished runs before, the current one cut at the date.

    The finished lengths are carried along as a list per run, not per row.
    """
    s = states(spark, folder)
    along = Window.partitionBy("source_id").orderBy("date")
    numbered = s.withColumn("run", F.sum((~F.col("state").eqNullSafe(F.lag("state").over(along))).cast("int")).over(along))
    numbered = numbered.withColumn("sofar", F.row_number().over(Window.partitionBy("source_id", "run").orderBy("date")).cast("long"))
    finished = numbered.groupBy("source_id", "run", "state").agg(F.count(F.lit(1)).alias("length"))
    long = F.when((F.col("state") == "violated") & (F.col("length") >= 12), F.col("length"))
    before = finished.select("source_id", "run", F.collect_list(long).over(Window.partitionBy("source_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("known"))
    now = F.when((F.col("state") == "violated") & (F.col("sofar") >= 12), F.array("sofar")).otherwise(F.array().cast("array<bigint>"))
    rows = numbered.join(before, ["source_id", "run"]).withColumn("l", F.array_sort(F.concat("known", now)))
    n = F.size("l")
    middle = (F.get("l", F.floor((n - 1) / 2).cast("int")) + F.get("l", F.floor(n / 2).cast("int"))) / 2
    return rows.select(*KEYS, F.when(n > 0, middle).alias("median_run"), F.when(n > 0, F.array_max("l")).alias("longest_run"))


@query(f"WITH {daily_sql('mkt_ret')}, q AS (SELECT source_id, date, percent_rank() OVER (PARTITION BY source_id ORDER BY mkt_ret) AS pr FROM p WHERE mkt_ret IS NOT NULL) SELECT source_id, date, {s6('least(pr, 1 - pr)')} AS tail_mass, least(pr, 1 - pr) <= 0.05 AS inside FROM q")
def w22_tail_mass(spark: SparkSession, folder: str) -> DataFrame:
    pr = F.percent_rank().over(Window.partitionBy("source_id").orderBy("mkt_ret"))
    return daily(spark, folder, "mkt_ret").where("mkt_ret is not null").withColumn("pr", pr).select(*KEYS, r6(w.tail_mass(F.col("pr"))).alias("tail_mass"), (w.tail_mass(F.col("pr")) <= 0.05).alias("inside"))


@query(f"WITH {daily_sql('mkt_ret')}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY abs(mkt_ret) DESC, date) AS place FROM p WHERE mkt_ret IS NOT NULL) SELECT source_id, date, mkt_ret, place FROM r WHERE place <= 10")
def w24_largest_moves(spark: SparkSession, folder: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.abs("mkt_ret").desc(), "date"))
    return daily(spark, folder, "mkt_ret").where("mkt_ret is not null").withColumn("place", place.cast("long")).where("place <= 10")


@query(f"""WITH {daily_sql('mkt_ret')}, v AS (SELECT * FROM p WHERE mkt_ret IS NOT NULL), n AS (SELECT source_id, date, mkt_ret, row_number() {SEQ} AS i FROM v)
SELECT source_id, min(date) AS first_date, max(date) AS last_date, max(i) AS n, max_by(mkt_ret, date) AS latest FROM n GROUP BY ALL""")
def w26_first_last_latest(spark: SparkSession, folder: str) -> DataFrame:
    n = daily(spark, folder, "mkt_ret").where("mkt_ret is not null").withColumn("i", A.number())
    return n.groupBy("source_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("i").cast("long").alias("n"), F.max_by("mkt_ret", "date").alias("latest"))


@query(f"""WITH {daily_sql('mkt_ret')}, n AS (SELECT *, row_number() {SEQ} AS i, CASE WHEN mkt_ret < 0 THEN 'down' WHEN mkt_ret >= 0 THEN 'up' END AS bucket FROM p)
SELECT source_id, date, CASE WHEN count(mkt_ret) OVER w >= 20 THEN round(avg(mkt_ret) OVER w, 13) + 0.0 END AS bucket_mean FROM n WHERE bucket IS NOT NULL
WINDOW w AS (PARTITION BY source_id, bucket ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 21 PRECEDING)""")
def w27_bucket_mean_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Mean per bucket over what was finished 21 rows ago: the forecast a bucket would have given."""
    r = F.col("mkt_ret")
    n = daily(spark, folder, "mkt_ret").withColumn("i", A.number()).withColumn("bucket", F.when(r < 0, "down").when(r >= 0, "up")).where("bucket is not null")
    frame = Window.partitionBy("source_id", "bucket").orderBy("i").rangeBetween(Window.unboundedPreceding, -21)
    return n.select(*KEYS, F.when(F.count(r).over(frame) >= 20, r6(F.avg(r).over(frame), 13)).alias("bucket_mean"))


_OHLC_SQL = """o AS (SELECT o_orderdate::DATE AS date, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL)"""


@query(f"""WITH {_OHLC_SQL}, q AS (SELECT date, year(date) AS y, pow(ln(high / low), 2) / (4 * ln(2)) AS x FROM o)
SELECT date, CASE WHEN count(x) OVER w = 21 THEN round(sqrt(avg(x) OVER w * 252), 6) END AS vol FROM q WINDOW w AS (PARTITION BY y ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def w28_range_vol(spark: SparkSession, folder: str) -> DataFrame:
    from chronoplane.tables import table

    o = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")).withColumn("y", F.year("date"))
    y = w.Along("y", "date")
    return o.select("date", r6(y.range_vol(F.col("high"), F.col("low"))).alias("vol"))
