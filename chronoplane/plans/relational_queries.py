"""Projections and filters (PF), joins and alignment (J), sorts, limits and set operations (S)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplane.functions import windows as w
from chronoplane.functions.instants import nan_to_null
from chronoplane.operators import calendar
from chronoplane.plans.panels import ASSETS, INDUSTRIES, bonds, bonds_sql, daily, daily_sql
from chronoplane.plans.registry import query, r6, s6
from chronoplane.sources.files import consecutive_loads
from chronoplane.tables import table

SEQ = "OVER (PARTITION BY source_id ORDER BY date)"


@query(f"WITH {daily_sql('mkt_ret', 'ind_nodur', 'ind_other')} SELECT source_id AS feed, date AS day, mkt_ret AS a_mkt_ret, ind_nodur AS a_ind_nodur, ind_other AS a_ind_other FROM p")
def pf1_select_rename_prefix(spark: SparkSession, folder: str) -> DataFrame:
    df = daily(spark, folder, "mkt_ret", "ind_nodur", "ind_other")
    return df.withColumnsRenamed({"source_id": "feed", "date": "day"} | {c: f"a_{c}" for c in df.columns[2:]})


@query(f"WITH {daily_sql('mkt_ret', 'rf', 'bond10_ret')} SELECT source_id, date, {s6('mkt_ret - rf', 9)} AS excess, {s6('(mkt_ret + rf) / 100', 9)} AS scaled, {s6('mkt_ret / nullif(bond10_ret, 0) - 1')} AS ratio FROM p")
def pf2_column_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    m, rf, b = F.col("mkt_ret"), F.col("rf"), F.col("bond10_ret")
    return daily(spark, folder, "mkt_ret", "rf", "bond10_ret").select("source_id", "date", r6(m - rf, 9).alias("excess"), r6((m + rf) / 100, 9).alias("scaled"), r6(m / F.nullif(b, F.lit(0.0)) - 1).alias("ratio"))


@query("SELECT DISTINCT source_id, date, load_id, CASE WHEN NOT isnan(mkt_ret) THEN mkt_ret END AS mkt_ret FROM assets_daily WHERE date BETWEEN DATE '2008-01-01' AND DATE '2010-12-31'")
def pf3_date_slice(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "assets_daily").where(F.col("date").between("2008-01-01", "2010-12-31"))
    return rows.select("source_id", "date", "load_id", nan_to_null(F.col("mkt_ret")).alias("mkt_ret")).distinct()


@query("SELECT load_id, file, CASE WHEN bytes < 0 THEN NULL ELSE bytes END AS bytes, nullif(rows, 0) AS rows, nullif(sha256, '') AS sha256 FROM (SELECT DISTINCT load_id, file, bytes, rows, sha256 FROM panel_manifest)")
def pf4_sentinel_to_null(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "panel_manifest").select("load_id", "file", "bytes", "rows", "sha256").distinct()
    return rows.select("load_id", "file", F.when(F.col("bytes") >= 0, F.col("bytes")).alias("bytes"), F.nullif("rows", F.lit(0)).alias("rows"), F.nullif("sha256", F.lit("")).alias("sha256"))


@query(f"WITH {daily_sql('mkt_ret', 'bond10_ret', 'gold_ret')} SELECT source_id, date, mkt_ret, bond10_ret, gold_ret FROM p WHERE mkt_ret IS NOT NULL AND bond10_ret IS NOT NULL AND gold_ret IS NOT NULL")
def pf5_complete_cases(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret", "bond10_ret", "gold_ret").dropna(subset=["mkt_ret", "bond10_ret", "gold_ret"])


@query(f"WITH {daily_sql('mkt_ret', 'smb')} SELECT source_id, date, CASE WHEN mkt_ret < 0 THEN smb END AS smb_down, CASE WHEN date >= DATE '2010-01-01' THEN smb END AS smb_late FROM p")
def pf6_where_mask(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret", "smb").select("source_id", "date", F.when(F.col("mkt_ret") < 0, F.col("smb")).alias("smb_down"), F.when(F.col("date") >= "2010-01-01", F.col("smb")).alias("smb_late"))


_OHLC = "o AS (SELECT o_orderdate::DATE AS date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close FROM orders GROUP BY ALL)"


def ohlc(spark: SparkSession, folder: str) -> DataFrame:
    """Opening, highest, lowest and closing order value of a day."""
    return table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"))


@query(f"WITH {_OHLC} SELECT date, open, high, low, close FROM o WHERE high >= greatest(open, close, low) AND low <= least(open, close, high) AND low > 0")
def pf7_ohlc_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return ohlc(spark, folder).where((F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high")) & (F.col("low") > 0))


@query("SELECT load_id, count(*) AS n, sum(rows)::BIGINT AS rows FROM panel_manifest WHERE rows > -99 GROUP BY load_id")
def pf8_sentinel_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "panel_manifest").where("rows > -99").groupBy("load_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))


@query(f"WITH {daily_sql('mkt_ret')}, n AS (SELECT *, row_number() {SEQ} AS i FROM p) SELECT source_id, date, mkt_ret FROM n WHERE i > 63")
def pf9_burn_in_trim(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").withColumn("i", w.Along("source_id", "date").number()).where("i > 63").drop("i")


_SHARE = " + ".join(f"({c} IS NOT NULL)::INT" for c in ASSETS)


@query(f"WITH {daily_sql(*ASSETS)}, f AS (SELECT source_id, min(date) AS start FROM p WHERE ({_SHARE}) >= 0.9 * {len(ASSETS)} GROUP BY ALL) SELECT p.source_id, p.date, mkt_ret FROM p JOIN f ON p.source_id = f.source_id AND p.date >= f.start")
def pf10_coverage_trim(spark: SparkSession, folder: str) -> DataFrame:
    """From the first date on which nine tenths of the columns are present."""
    rows = daily(spark, folder, *ASSETS)
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in ASSETS])
    start = F.min(F.when(present >= 0.9 * len(ASSETS), F.col("date"))).over(Window.partitionBy("source_id"))
    return rows.withColumn("start", start).where("date >= start").select("source_id", "date", "mkt_ret")


@query(f"WITH {daily_sql('mkt_ret')}, n AS (SELECT *, row_number() {SEQ} AS i FROM p) SELECT source_id, date, mkt_ret FROM n WHERE (i - 1) % 21 = 0")
def pf11_every_hth_row(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").withColumn("i", w.Along("source_id", "date").number()).where("(i - 1) % 21 = 0").drop("i")


@query("""SELECT DISTINCT record_id, rarity.level_percentile AS p, CASE WHEN rarity.level_percentile IS NULL THEN NULL WHEN rarity.level_percentile < 0.1 THEN 'very low' WHEN rarity.level_percentile < 0.3 THEN 'low' WHEN rarity.level_percentile < 0.7 THEN 'typical' WHEN rarity.level_percentile < 0.9 THEN 'high' ELSE 'very high' END AS record_band,
CASE WHEN rarity.level_percentile IS NULL THEN NULL WHEN rarity.level_percentile < 0.2 THEN 'very low' WHEN rarity.level_percentile < 0.4 THEN 'low' WHEN rarity.level_percentile < 0.6 THEN 'typical' WHEN rarity.level_percentile < 0.8 THEN 'high' ELSE 'very high' END AS read_band,
CASE WHEN reading.value < -0.1 THEN 'intact' WHEN reading.value > 0.1 THEN 'violated' WHEN reading.value IS NOT NULL THEN 'under_test' END AS state FROM observation_log""")
def pf12_bands_and_states(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("rarity.level_percentile")
    return table(spark, folder, "observation_log").select("record_id", p.alias("p"), w.band(p, *w.RECORD_BANDS).alias("record_band"), w.band(p, *w.READ_BANDS).alias("read_band"), w.sign_state(F.col("reading.value")).alias("state")).distinct()


@query("SELECT source_id, count(*) AS n FROM (SELECT DISTINCT source_id, region, date FROM assets_daily) WHERE region IN ('us', 'japan', 'uk') AND NOT (date BETWEEN DATE '2008-01-01' AND DATE '2010-12-31') GROUP BY ALL")
def pf13_isin_and_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "assets_daily").where(F.col("region").isin("us", "japan", "uk") & ~F.col("date").between("2008-01-01", "2010-12-31"))
    return rows.select("source_id", "region", "date").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {daily_sql('mkt_ret')} SELECT source_id, date, CASE WHEN mkt_ret IS NOT NULL THEN greatest(least(mkt_ret, 0.02), -0.02) END AS clipped FROM p")
def pf14_clip(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").select("source_id", "date", w.clip(F.col("mkt_ret"), -0.02, 0.02).alias("clipped"))


# -- joins -------------------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, o_custkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j1_left_join(spark: SparkSession, folder: str) -> DataFrame:
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "o_custkey", "c_name", "n_name")


@query(f"WITH {bonds_sql('jp_bond10_ret', 'de_bond10_ret')} SELECT source_id, month, jp_bond10_ret AS a, de_bond10_ret AS b FROM b WHERE jp_bond10_ret IS NOT NULL AND de_bond10_ret IS NOT NULL")
def j2_align_and_drop(spark: SparkSession, folder: str) -> DataFrame:
    rows = bonds(spark, folder, "jp_bond10_ret", "de_bond10_ret")
    a = rows.where("jp_bond10_ret is not null").select("source_id", "month", F.col("jp_bond10_ret").alias("a"))
    b = rows.where("de_bond10_ret is not null").select("source_id", "month", F.col("de_bond10_ret").alias("b"))
    return a.join(b, ["source_id", "month"])


_O_DAYS = "SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS orders FROM orders GROUP BY ALL"
_L_DAYS = "SELECT l_shipdate::DATE AS day, sum(l_extendedprice * (1 - l_discount)) AS shipped FROM lineitem GROUP BY ALL"


@query(f"SELECT coalesce(a.day, b.day) AS day, round(orders, 4) AS orders, round(shipped, 4) AS shipped FROM ({_O_DAYS}) a FULL JOIN ({_L_DAYS}) b ON a.day = b.day")
def j3_full_outer_concat(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 4).alias("orders"))
    b = table(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("shipped"))
    return a.join(b, "day", "full")


@query(f"WITH {bonds_sql('jp_y10')}, m AS (SELECT last_day(o_orderdate::DATE) AS month, count(*) AS n FROM orders GROUP BY ALL) SELECT source_id, month, jp_y10, n FROM b JOIN m USING (month)")
def j4_inner_join(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return bonds(spark, folder, "jp_y10").join(m, "month").select("source_id", "month", "jp_y10", "n")


@query(f"""WITH {bonds_sql('jp_bond10_ret')}, e AS (SELECT source_id, min(month) AS a, max(month) AS z FROM b GROUP BY ALL),
g AS (SELECT source_id, last_day(unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH))::DATE) AS month FROM e)
SELECT g.source_id, g.month, coalesce(jp_bond10_ret, 0.0) AS jp_bond10_ret FROM g LEFT JOIN b USING (source_id, month)""")
def j5_reindex_onto_calendar(spark: SparkSession, folder: str) -> DataFrame:
    rows = bonds(spark, folder, "jp_bond10_ret")
    return calendar.month_grid(rows, ["source_id"], "month").join(rows, ["source_id", "month"], "left").withColumn("jp_bond10_ret", F.coalesce("jp_bond10_ret", F.lit(0.0)))


@query(f"""WITH {daily_sql('mkt_ret', 'gold_ret')}, q AS (SELECT source_id, date + 10 AS known, gold_ret FROM p WHERE gold_ret IS NOT NULL)
SELECT p.source_id, p.date, q.gold_ret FROM p ASOF LEFT JOIN q ON p.source_id = q.source_id AND p.date >= q.known""")
def j6_asof_backward(spark: SparkSession, folder: str) -> DataFrame:
    """Each day with the latest value whose release, ten days after its date, had come."""
    rows = daily(spark, folder, "mkt_ret", "gold_ret")
    released = rows.where("gold_ret is not null").select("source_id", F.date_add("date", 10).alias("known"), "gold_ret")
    return calendar.asof_backward(rows.select("source_id", "date"), released, ["source_id"], "date", "known", "gold_ret")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j7_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT record_id, region, signal FROM observation_log o WHERE NOT EXISTS (SELECT 1 FROM vintage_capture c WHERE c.region = o.region AND c.signal = o.signal AND c.captured_at >= o.available_at::TIMESTAMPTZ)")
def j8_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Records of series without a later capture: reduced to the last capture per series first, so no pairs of rows arise."""
    from chronoplane.functions.instants import instant_micros

    o = table(spark, folder, "observation_log").select("record_id", "region", "signal", instant_micros(F.col("available_at")).alias("at")).distinct()
    last = table(spark, folder, "vintage_capture").groupBy("region", "signal").agg(F.max(F.unix_micros("captured_at")).alias("last"))
    return o.join(last, (o.region == last.region) & (o.signal == last.signal) & (o["at"] <= last["last"]), "left_anti").select("record_id", "region", "signal")


@query("""WITH v AS (SELECT series, snapshot_no, wayback_timestamp, max(rows) AS rows FROM vintage_manifest GROUP BY ALL), t AS (SELECT series, max(snapshot_no) AS today FROM v GROUP BY ALL),
n AS (SELECT v.series, v.wayback_timestamp, v.rows FROM v JOIN t ON v.series = t.series AND v.snapshot_no = t.today)
SELECT v.series, v.snapshot_no, count(*) AS shared, sum(n.rows - v.rows)::BIGINT AS revision, max(v.wayback_timestamp) AS latest FROM v JOIN n USING (series, wayback_timestamp) GROUP BY ALL""")
def j9_vintage_against_today(spark: SparkSession, folder: str) -> DataFrame:
    """Every earlier snapshot of a series against its last one, on the captures both have."""
    v = table(spark, folder, "vintage_manifest").groupBy("series", "snapshot_no", "wayback_timestamp").agg(F.max("rows").alias("rows"))
    today = v.groupBy("series", "wayback_timestamp").agg(F.max_by(F.struct("snapshot_no", "rows"), "snapshot_no").alias("t"))
    last = v.groupBy("series").agg(F.max("snapshot_no").alias("today"))
    n = today.join(last, "series").where("t.snapshot_no = today").select("series", "wayback_timestamp", F.col("t.rows").alias("now"))
    return v.join(n, ["series", "wayback_timestamp"]).groupBy("series", "snapshot_no").agg(F.count(F.lit(1)).alias("shared"), F.sum(F.col("now") - F.col("rows")).alias("revision"), F.max("wayback_timestamp").alias("latest"))


CRISES = [("a", "2000-03-01", "2002-10-31"), ("b", "2007-10-01", "2009-03-31"), ("c", "2020-02-15", "2020-04-30")]
_CRISES = "c(name, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in CRISES) + ")"


@query(f"WITH {daily_sql('mkt_ret')}, {_CRISES} SELECT source_id, name, count(mkt_ret) AS n, min(mkt_ret) AS worst FROM p JOIN c ON date BETWEEN a AND b GROUP BY ALL")
def j10_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Days in named windows; the three windows are constants, so they are broadcast."""
    c = spark.createDataFrame(CRISES, "name string, a string, b string").select("name", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    rows = daily(spark, folder, "mkt_ret").join(F.broadcast(c), F.col("date").between(F.col("a"), F.col("b")))
    return rows.groupBy("source_id", "name").agg(F.count("mkt_ret").alias("n"), F.min("mkt_ret").alias("worst"))


_LONG = " UNION ALL ".join(f"SELECT source_id, date, '{c}' AS c, {c} AS x FROM p WHERE {c} IS NOT NULL" for c in INDUSTRIES)


@query(f"WITH {daily_sql(*INDUSTRIES)}, l AS ({_LONG}) SELECT a.source_id, a.c AS i, b.c AS j, count(*) AS n, {s6('corr(a.x, b.x)', 5)} AS rho FROM l a JOIN l b ON a.source_id = b.source_id AND a.date = b.date AND a.c < b.c GROUP BY ALL")
def j11_self_join_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of the ten columns: a fixed number of aggregates in one pass, no join."""
    pairs = [(a, b) for a in INDUSTRIES for b in INDUSTRIES if a < b]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    aggs = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.count(F.when(both(a, b), 1)).alias("n"), w.corr(F.col(a), F.col(b)).alias("rho")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]
    wide = daily(spark, folder, *INDUSTRIES).groupBy("source_id").agg(*aggs)
    return wide.select("source_id", F.inline(F.array(*[f"p{k}" for k in range(len(pairs))]))).where("n > 0").withColumn("rho", r6(F.col("rho"), 5))


@query(f"""WITH {daily_sql('mkt_ret', 'bond10_ret')}, e AS (SELECT source_id, date FROM p WHERE mkt_ret < -0.03), m AS (SELECT source_id, date AS d FROM p WHERE bond10_ret > 0.006)
SELECT e.source_id, e.date, min(m.d) AS first_mark FROM e LEFT JOIN m ON e.source_id = m.source_id AND m.d < e.date AND e.date - m.d <= 30 GROUP BY ALL""")
def j12_nearest_prior_crossing(spark: SparkSession, folder: str) -> DataFrame:
    rows = daily(spark, folder, "mkt_ret", "bond10_ret")
    return calendar.nearest_prior(rows.where("mkt_ret < -0.03"), rows.where("bond10_ret > 0.006"), ["source_id"], "date", 30)


# -- sorts, limits, sets -----------------------------------------------------------------------------------------------
@query("SELECT region, signal, as_of, available_at, record_id FROM observation_log ORDER BY ALL")
def s1_s4_order(spark: SparkSession, folder: str) -> DataFrame:
    """The whole log in one order."""
    columns = ["region", "signal", "as_of", "available_at", "record_id"]
    return table(spark, folder, "observation_log").select(*columns).orderBy(*columns)


@query(f"WITH {daily_sql('mkt_ret')}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY date DESC) AS i FROM p) SELECT source_id, date, mkt_ret FROM n WHERE i <= 13")
def s2_tail_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("date").desc()))
    return daily(spark, folder, "mkt_ret").withColumn("i", n).where("i <= 13").drop("i")


@query(f"WITH {daily_sql('mkt_ret')} SELECT source_id, date, mkt_ret FROM p WHERE mkt_ret IS NOT NULL ORDER BY mkt_ret, source_id, date LIMIT 10")
def s3_smallest(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder, "mkt_ret").where("mkt_ret is not null").orderBy("mkt_ret", "source_id", "date").limit(10)


@query("SELECT DISTINCT region, signal FROM observation_log INTERSECT SELECT region, signal FROM vintage_capture")
def s5_intersection(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observation_log").select("region", "signal").intersect(table(spark, folder, "vintage_capture").select("region", "signal"))


@query("""WITH l AS (SELECT load_id AS prior, lead(load_id) OVER (ORDER BY load_id) AS load_id FROM (SELECT DISTINCT load_id FROM panel_manifest WHERE load_id IS NOT NULL))
SELECT l.load_id, file FROM panel_manifest p JOIN l ON p.load_id = l.prior WHERE l.load_id IS NOT NULL EXCEPT SELECT load_id, file FROM panel_manifest""")
def s6_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Files that the load before each load had and it hasn't."""
    p = table(spark, folder, "panel_manifest").select("load_id", "file")
    had = p.join(consecutive_loads(p, "load_id"), "load_id").where("following is not null").select(F.col("following").alias("load_id"), "file")
    return had.subtract(p)


@query("SELECT region, signal, 'log' AS kind, count(*) AS n FROM observation_log GROUP BY ALL UNION ALL SELECT region, signal, 'capture', count(*) FROM vintage_capture GROUP BY ALL")
def s7_union(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda t, k: table(spark, folder, t).groupBy("region", "signal").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k))
    return count("observation_log", "log").unionByName(count("vintage_capture", "capture"))


@query("SELECT region, signal, as_of, max(record_id) AS record_id, max_by(available_at, record_id) AS available_at FROM observation_log GROUP BY ALL")
def s8_keyed_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observation_log").groupBy("region", "signal", "as_of").agg(F.max("record_id").alias("record_id"), F.max_by("available_at", "record_id").alias("available_at"))
