"""Scalar function families (section 2.11 of the survey) and the composites left over from other sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.functions import windows as w
from chronoplane.operators import cross_section as xs
from chronoplane.plans.panels import INDUSTRIES, bonds, bonds_sql, daily, daily_sql
from chronoplane.plans.registry import query, r6, s6
from chronoplane.plans.window_queries import A, EVER, guarded
from chronoplane.tables import table


@query(f"""WITH {bonds_sql('jp_y10')} SELECT source_id, month, {s6('sqrt(abs(jp_y10))')} AS root, {s6('ln(greatest(jp_y10, 1e-6))')} AS log, {s6('ln(1 + abs(jp_y10))')} AS log1p, {s6('exp(jp_y10 / 10) - 1')} AS expm1, sign(jp_y10)::DOUBLE AS sign, {s6('pow(jp_y10, 3)')} AS cube,
floor(jp_y10 * 10)::BIGINT AS tenths, {s6('tanh(jp_y10 / 10)')} AS tanh, {s6('atanh(jp_y10 / 100)')} AS atanh, {s6('greatest(jp_y10, 0) + ln(1 + exp(-abs(jp_y10)))')} AS softplus, {s6('1 / (1 + exp(-jp_y10))')} AS sigmoid FROM b WHERE jp_y10 IS NOT NULL""")
def fn_math(spark: SparkSession, folder: str) -> DataFrame:
    y = F.col("jp_y10")
    return bonds(spark, folder, "jp_y10").where("jp_y10 is not null").select(
        "source_id", "month", r6(F.sqrt(F.abs(y))).alias("root"), r6(F.ln(F.greatest(y, F.lit(1e-6)))).alias("log"), r6(F.log1p(F.abs(y))).alias("log1p"), r6(F.expm1(y / 10)).alias("expm1"), F.signum(y).alias("sign"), r6(F.pow(y, 3)).alias("cube"),
        F.floor(y * 10).alias("tenths"), r6(F.tanh(y / 10)).alias("tanh"), r6(F.atanh(y / 100)).alias("atanh"), r6(F.greatest(y, F.lit(0.0)) + F.log1p(F.exp(-F.abs(y)))).alias("softplus"), r6(1 / (1 + F.exp(-y))).alias("sigmoid"))


@query("""WITH d AS (SELECT DISTINCT as_of::DATE AS d FROM observation_log) SELECT d AS day, last_day(d) AS month_end, last_day(make_date(year(d), (quarter(d) * 3)::INT, 1)) AS quarter_end, make_date(year(d), 12, 31) AS year_end, last_day((d + INTERVAL 7 MONTH)::DATE) AS seven_months,
(last_day(d) + 15) AS mid_next, (d - DATE '1990-01-01')::INT AS days, year(d)::INT AS y, (isodow(d) - 1)::INT AS weekday, strftime(d, '%Y%m%d') AS compact FROM d""")
def fn_dates(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("day")
    return table(spark, folder, "observation_log").select(F.to_date("as_of").alias("day")).distinct().select(
        "day", F.last_day(d).alias("month_end"), F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1))).alias("quarter_end"), F.make_date(F.year(d), F.lit(12), F.lit(31)).alias("year_end"), F.last_day(F.add_months(d, 7)).alias("seven_months"),
        F.date_add(F.last_day(d), 15).alias("mid_next"), F.datediff(d, F.lit("1990-01-01").cast("date")).alias("days"), F.year(d).alias("y"), F.weekday(d).alias("weekday"), F.date_format(d, "yyyyMMdd").alias("compact"))


@query(r"""SELECT DISTINCT file, lower(trim(file)) AS low, split_part(file, '_', 1) AS head, replace(file, '.csv', '') AS stem, file LIKE 'industry%' AS is_industry, regexp_extract(file, '(\d+)\.csv$', 1) AS number, regexp_matches(file, '_daily_') AS daily, length(file)::INT AS n, substr(file, 1, 4) AS four, replace(replace(replace(coalesce("first", '<none>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM panel_manifest WHERE file IS NOT NULL""")
def fn_strings(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("file")
    safe = F.replace(F.replace(F.replace(F.coalesce("first", F.lit("<none>")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return table(spark, folder, "panel_manifest").where("file is not null").select(
        "file", F.lower(F.trim(f)).alias("low"), F.split_part(f, F.lit("_"), F.lit(1)).alias("head"), F.replace(f, F.lit(".csv"), F.lit("")).alias("stem"), f.startswith("industry").alias("is_industry"), F.regexp_extract(f, r"(\d+)\.csv$", 1).alias("number"),
        f.contains("_daily_").alias("daily"), F.length(f).alias("n"), F.substring(f, 1, 4).alias("four"), safe.alias("escaped")).distinct()


@query("SELECT event_id, sha256(props) AS digest, (props::JSON ->> 'k')::INT AS k FROM events")
def fn_hash_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.sha2("props", 256).alias("digest"), F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 5) AS norm2, list_contains(list_transform(embedding, lambda x: x > 0), true) AS any_up, len(list_filter(embedding, lambda x: x > 0))::INT AS ups FROM embeddings")
def fn_arrays(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x), 5).alias("norm2"), F.exists(e, lambda x: x > 0).alias("any_up"), F.size(F.filter(e, lambda x: x > 0)).alias("ups"))


@query(f"""WITH {daily_sql('gold_ret')} SELECT source_id, date, gold_ret IS NULL AS missing, coalesce(gold_ret, 0.0) AS filled, last_value(gold_ret IGNORE NULLS) {EVER} AS forward,
first_value(gold_ret IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward, nullif(gold_ret, 0) AS nonzero FROM p""")
def fn_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Missing values: tests, fills forward and (for panels that are not causal) backward. The backward fill runs forward over the turned order."""
    from pyspark.sql import Window

    g = F.col("gold_ret")
    turned = Window.partitionBy("source_id").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return daily(spark, folder, "gold_ret").select("source_id", "date", g.isNull().alias("missing"), F.coalesce(g, F.lit(0.0)).alias("filled"), A.fill(g).alias("forward"), F.last(g, ignorenulls=True).over(turned).alias("backward"), F.nullif(g, F.lit(0.0)).alias("nonzero"))


_FOUR = ["ind_nodur", "ind_enrgy", "ind_hitec", "ind_hlth"]
_PX = "pp AS (SELECT source_id, date, " + ", ".join(f"CASE WHEN {c} > -1 THEN exp(sum(CASE WHEN {c} > -1 THEN ln(1 + {c}) END) {EVER}) END AS {c}, {c} AS r_{c}" for c in _FOUR) + " FROM p)"
_UP = ", ".join(f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER w50 = 50 THEN ({c} > avg({c}) OVER w50)::INT END AS u_{c}, abs(exp(CASE WHEN count(CASE WHEN r_{c} > -1 THEN 1 END) OVER w20 = 20 THEN sum(CASE WHEN r_{c} > -1 THEN ln(1 + r_{c}) END) OVER w20 END) - 1) AS c_{c}" for c in _FOUR)


def _z(x: str) -> str:
    return f"CASE WHEN count({x}) {EVER} >= 63 THEN ({x} - avg({x}) {EVER}) / nullif(stddev_samp({x}) {EVER}, 0) END"


@query(f"""WITH {daily_sql(*_FOUR)}, {_PX}, f AS (SELECT source_id, date, {_UP} FROM pp WINDOW w50 AS (PARTITION BY source_id ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY source_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
g AS (SELECT source_id, date, -({' + '.join(f'coalesce(u_{c}, 0)' for c in _FOUR)}) / nullif({' + '.join(f'(u_{c} IS NOT NULL)::INT' for c in _FOUR)}, 0) AS b, ({' + '.join(f'c_{c} * c_{c}' for c in _FOUR)}) / nullif(pow({' + '.join(f'c_{c}' for c in _FOUR)}, 2), 0) AS h FROM f)
SELECT source_id, date, {s6(_z('b') + ' + ' + _z('h'), 4)} AS g FROM g""")
def x10_composite(spark: SparkSession, folder: str) -> DataFrame:
    """z of falling breadth plus z of leadership concentration, both expanding."""
    rows = xs.with_prices(daily(spark, folder, *_FOUR), ["source_id"], "date", _FOUR)
    cum = [F.abs(F.exp(A.total(F.log1p(F.when(F.col(c) > -1, F.col(c))), 20)) - 1) for c in _FOUR]
    rows = rows.select("source_id", "date", (-xs.breadth(rows, ["source_id"], "date", _FOUR, 50)).alias("b"), *[c.alias(f"c{i}") for i, c in enumerate(cum)])
    total, squares = sum((F.col(f"c{i}") for i in range(1, 4)), F.col("c0")), sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(1, 4)), F.col("c0") * F.col("c0"))
    rows = rows.withColumn("h", squares / F.nullif(total * total, F.lit(0.0)))
    return rows.select("source_id", "date", r6(A.expanding_z(F.col("b"), 63) + A.expanding_z(F.col("h"), 63), 4).alias("g"))


_PAST = "OVER (PARTITION BY source_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)"
_OK = " AND ".join(f"{c} IS NOT NULL" for c in _FOUR[:2])


@query(f"WITH {daily_sql(*_FOUR[:2])} SELECT source_id, date, {s6(f'CASE WHEN count(CASE WHEN {_OK} THEN 1 END) {_PAST} = 63 THEN atanh(corr({_FOUR[0]}, {_FOUR[1]}) {_PAST}) END', 4)} AS corr_z FROM p")
def w29_realized_corr_z(spark: SparkSession, folder: str) -> DataFrame:
    """Fisher z of the correlation over the 63 rows before each row, that row not among them."""
    a, b = F.col(_FOUR[0]), F.col(_FOUR[1])
    return daily(spark, folder, *_FOUR[:2]).select("source_id", "date", r6(F.atanh(A._correlation(a, b, 63, A.past(63), 63)), 4).alias("corr_z"))


_ALL_OK = " AND ".join(f"{c} IS NOT NULL" for c in INDUSTRIES)
_MEAN_RHO = "(" + " + ".join(f"corr({a}, {b}) {_PAST}" for i, a in enumerate(INDUSTRIES) for b in INDUSTRIES[i + 1 :]) + ") / 45"


@query(f"""WITH {daily_sql(*INDUSTRIES)}, o AS (SELECT source_id, date, {_ALL_OK} AS ok, {', '.join(f'CASE WHEN {_ALL_OK} THEN {c} END AS {c}' for c in INDUSTRIES)} FROM p),
m AS (SELECT source_id, date, CASE WHEN count(CASE WHEN ok THEN 1 END) {_PAST} = 63 THEN {_MEAN_RHO} END AS rho FROM o) SELECT source_id, date, {s6('CASE WHEN isfinite(rho) THEN atanh(greatest(least(rho, 0.999), -0.999)) END', 4)} AS corr_z FROM m""")
def w29_mean_corr_z(spark: SparkSession, folder: str) -> DataFrame:
    """Fisher z of the mean correlation of all pairs of the ten industries over the 63 rows before each row (``w29_realized_corr_z`` is the one pair of its SQL)."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in INDUSTRIES])
    rows = daily(spark, folder, *INDUSTRIES).select("source_id", "date", *[F.when(whole, F.col(c)).alias(c) for c in INDUSTRIES])
    past = A.past(63)
    parts = [F.count(INDUSTRIES[0]).over(past).alias("k"), *[F.stddev_pop(c).over(past).alias(f"s_{c}") for c in INDUSTRIES]]
    pairs = [(a, b) for i, a in enumerate(INDUSTRIES) for b in INDUSTRIES[i + 1 :]]
    parts += [F.covar_pop(a, b).over(past).alias(f"c_{a}_{b}") for a, b in pairs]
    rho = reduce(lambda x, y: x + y, [F.col(f"c_{a}_{b}") / F.nullif(F.col(f"s_{a}") * F.col(f"s_{b}"), F.lit(0.0)) for a, b in pairs]) / len(pairs)
    z = F.when((F.col("k") == 63) & F.col("rho").isNotNull(), F.atanh(F.greatest(F.least("rho", F.lit(0.999)), F.lit(-0.999))))
    return rows.select("source_id", "date", *parts).select("source_id", "date", "k", rho.alias("rho")).select("source_id", "date", r6(z, 4).alias("corr_z"))




@query(f"WITH {daily_sql('mkt_ret')}, v AS (SELECT source_id, date, mkt_ret, {guarded('stddev_samp', 'mkt_ret', 21)} AS v FROM p), s AS (SELECT source_id, date, CASE WHEN v > 0.02 THEN 'stressed' WHEN v > 0.008 THEN 'normal' WHEN v IS NOT NULL THEN 'calm' END AS b, mkt_ret FROM v) SELECT b AS bucket, count(*) AS n, {s6('avg(greatest(-mkt_ret, 0))')} AS mean_loss, {s6('avg((mkt_ret < -0.02)::INT)')} AS fall_share FROM s WHERE b IS NOT NULL AND mkt_ret IS NOT NULL GROUP BY ALL")
def fn_covariates_by_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Negative parts and falls by volatility bucket."""
    r = F.col("mkt_ret")
    v = F.col("v")
    rows = daily(spark, folder, "mkt_ret").withColumn("v", A.std(r, 21)).withColumn("bucket", F.when(v > 0.02, "stressed").when(v > 0.008, "normal").when(v.isNotNull(), "calm")).where("bucket is not null and mkt_ret is not null")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.greatest(-r, F.lit(0.0)))).alias("mean_loss"), r6(F.avg((r < -0.02).cast("double"))).alias("fall_share"))
