"""Queries on the bitemporal log (B) and on file sources and sinks (SC, SK)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplane.functions import windows as w
from chronoplane.functions.instants import day_number, instant_micros
from chronoplane.operators import bitemporal as bi
from chronoplane.operators import sequential as seq
from chronoplane.plans import signals
from chronoplane.plans.panels import bonds, bonds_sql, daily, daily_sql
from chronoplane.plans.registry import query, r6, s6
from chronoplane.session import materialise
from chronoplane.session import scratch_folder as scratch
from chronoplane.sources import files, text_panels
from chronoplane.tables import table

SERIES = ["region", "signal"]


def at() -> Column:
    return instant_micros(F.col("available_at"))


def log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observation_log")


_VIEW = "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region, signal, as_of ORDER BY available_at::TIMESTAMPTZ DESC, record_id DESC) AS n FROM observation_log {where}) WHERE n = 1)"


@query("SELECT region, signal, available_at, max(as_of) AS as_of FROM (SELECT DISTINCT region, signal, as_of::DATE AS as_of, strftime(last_day(as_of::DATE) + 35, '%Y-%m-%d') || 'T13:30:00Z' AS available_at FROM observation_log) GROUP BY ALL")
def b2_vintage_grid(spark: SparkSession, folder: str) -> DataFrame:
    days = log(spark, folder).select(*SERIES, F.to_date("as_of").alias("as_of"))
    return bi.vintage_grid(days, SERIES, "as_of", "month_end_35").select(*SERIES, "available_at", "as_of")


_REC = f"""{bonds_sql('jp_y10')}, x AS (SELECT source_id, month, jp_y10 AS v, row_number() OVER (PARTITION BY source_id ORDER BY month) AS i FROM b WHERE jp_y10 IS NOT NULL),
r AS (SELECT a.source_id, a.month, a.v, a.i, (count(*) FILTER (c.v < a.v) + (count(*) FILTER (c.v = a.v) + 1) / 2) / count(*) AS p FROM x a JOIN x c ON a.source_id = c.source_id AND c.i <= a.i GROUP BY ALL)"""


def ranked_yields(spark: SparkSession, folder: str) -> DataFrame:
    rows = bonds(spark, folder, "jp_y10").where("jp_y10 is not null")
    ranked = seq.along_series(rows, ["source_id"], "month", ["jp_y10"], lambda g: {"p": seq.expanding_rank(g["jp_y10"].to_numpy(float)), "v": g["jp_y10"].to_numpy(float)}, "p double, v double")
    return ranked


@query(f"""WITH {_REC}, d AS (SELECT *, round(p - lag(p, 12) OVER w, 9) AS ch FROM r WINDOW w AS (PARTITION BY source_id ORDER BY i)), g AS (SELECT source_id, strftime(last_day(month) + 35, '%Y-%m-%d') || 'T13:30:00Z' AS available_at, max(month) AS month FROM d GROUP BY ALL),
f AS (SELECT *, CASE WHEN p < 0.1 THEN 'very low' WHEN p < 0.3 THEN 'low' WHEN p < 0.7 THEN 'typical' WHEN p < 0.9 THEN 'high' ELSE 'very high' END AS context_band, CASE WHEN ch > 0.05 THEN 'rising' WHEN ch < -0.05 THEN 'falling' WHEN ch IS NOT NULL THEN 'flat' END AS direction,
  sum((p >= 0.95)::INT) OVER w AS above, avg((p >= 0.95)::INT) OVER w AS share, max(CASE WHEN p >= 0.95 THEN month END) OVER w AS last_such FROM d WINDOW w AS (PARTITION BY source_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT f.source_id, f.month AS as_of, available_at, v AS value, round(p, 12) AS level_percentile, context_band, ch AS level_percentile_change, direction, above::BIGINT AS observations_at_or_above, round(share, 6) AS share_of_history, last_such AS most_recent_such_date FROM f JOIN g USING (source_id, month)""")
def b3_b17_build_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of every vintage of a monthly series: expanding statistics once, then the freshest row of each publication instant."""
    rows = bi.descriptor_records(ranked_yields(spark, folder), "source_id", "month", "v", "p")
    grid = bi.vintage_grid(rows.select("source_id", "as_of"), ["source_id"], "as_of", "month_end_35")
    out = rows.join(grid, ["source_id", "as_of"])
    return out.select("source_id", "as_of", "available_at", "value", F.round("level_percentile", 12).alias("level_percentile"), "context_band", "level_percentile_change", "direction", "observations_at_or_above", F.round("share_of_history", 6).alias("share_of_history"), "most_recent_such_date")


@query(f"WITH {_VIEW.format(where='')} SELECT region, signal, as_of, record_id, reading.value AS value FROM v")
def b4_current_view(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder).withColumn("value", F.col("reading.value"))
    return bi.current_view(rows, SERIES, at(), "record_id", ["value"]).select(*SERIES, "as_of", "record_id", "value")


KNOWN = "2015-06-30T12:00:00Z"
KNOWN_MICROS = 1_435_665_600_000_000
_WHERE = f"WHERE available_at::TIMESTAMPTZ <= TIMESTAMPTZ '{KNOWN}'"


@query(f"WITH {_VIEW.format(where=_WHERE)}, l AS (SELECT *, row_number() OVER (PARTITION BY region, signal ORDER BY as_of DESC) AS m FROM v) SELECT region, signal, as_of, record_id, reading.value AS value FROM l WHERE m = 1")
def b5_known_at(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder).withColumn("value", F.col("reading.value"))
    return bi.known_at(rows, KNOWN_MICROS, SERIES, at(), "record_id", ["value"]).select(*SERIES, "as_of", "record_id", "value")


@query("""WITH a AS (SELECT DISTINCT region, signal, as_of, available_at, sha256 FROM observation_log WHERE record_id % 2 = 0), f AS (SELECT DISTINCT region, signal, as_of, available_at, sha256 FROM observation_log)
SELECT region, signal, count(*) FILTER (a.sha256 IS NULL) AS appended, count(*) FILTER (a.sha256 <> f.sha256) AS conflicts FROM f LEFT JOIN a USING (region, signal, as_of, available_at) GROUP BY ALL""")
def b6_sk2_append_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """All records appended to a log that holds the half with even numbers: what is new and what would conflict."""
    rows = log(spark, folder).select("record_id", *SERIES, "as_of", "available_at", "sha256")
    fresh = rows.drop("record_id").distinct()
    new, conflict = bi.split_append(rows.where("record_id % 2 = 0"), fresh, [*SERIES, "as_of", "available_at"], "sha256")
    marks = new.select(*SERIES, F.lit(1).alias("a"), F.lit(0).alias("c")).unionByName(conflict.select(*SERIES, F.lit(0).alias("a"), F.lit(1).alias("c"))).unionByName(fresh.select(*SERIES, F.lit(0).alias("a"), F.lit(0).alias("c")))
    return marks.groupBy(*SERIES).agg(F.sum("a").alias("appended"), F.sum("c").alias("conflicts"))


@query(f"WITH {_VIEW.format(where=_WHERE)}, w AS (SELECT region, signal, as_of, record_id, reading.value AS value FROM (SELECT *, row_number() OVER (PARTITION BY region, signal, as_of ORDER BY available_at::TIMESTAMPTZ DESC, record_id DESC) AS n FROM observation_log) WHERE n = 1) SELECT w.region, w.signal, w.as_of, w.record_id, v.sha256 AS supersedes, '{KNOWN}' AS available_at FROM w JOIN v USING (region, signal, as_of) WHERE w.value IS DISTINCT FROM v.reading.value")
def b6_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the whole log that differ from what was held at an instant, as corrections available at that instant."""
    rows = log(spark, folder).withColumn("value", F.col("reading.value"))
    held = bi.current_view(rows.where(at() <= KNOWN_MICROS), SERIES, at(), "record_id", ["value", "sha256"])
    rebuilt = bi.current_view(rows, SERIES, at(), "record_id", ["value"])
    return bi.corrections(held, rebuilt, [*SERIES, "as_of"], "value", "sha256", KNOWN).select(*SERIES, "as_of", "record_id", "supersedes", "available_at")


@query("""WITH o AS (SELECT DISTINCT record_id, region, signal, as_of, available_at, sha256, supersedes FROM observation_log)
SELECT region, signal, 'key_with_several_lines' AS problem, count(*) AS n FROM (SELECT region, signal, as_of, available_at::TIMESTAMPTZ AS a FROM o GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL
UNION ALL SELECT region, signal, 'available_before_as_of', count(*) FROM o WHERE (available_at::TIMESTAMPTZ AT TIME ZONE 'UTC')::DATE < as_of::DATE GROUP BY ALL
UNION ALL SELECT region, signal, 'supersedes_unknown', count(*) FROM o WHERE supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o k WHERE k.region = o.region AND k.signal = o.signal AND k.sha256 = o.supersedes) GROUP BY ALL
UNION ALL SELECT region, signal, 'repeated_line', count(*) - count(DISTINCT record_id) FROM observation_log GROUP BY ALL HAVING count(*) > count(DISTINCT record_id)""")
def b7_b8_audit(spark: SparkSession, folder: str) -> DataFrame:
    return bi.audit(log(spark, folder), SERIES, at(), "record_id", "sha256")


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """The log's records as JSON texts, as a consumer would receive them."""
    fields = ["spec_version", "signal", "as_of", "available_at", "supersedes", "clock", "assumption_monitored", "reading", "rarity", "assessment", "maturity"]
    rows = log(spark, folder).select("record_id", *fields).distinct()
    return rows.select("record_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("text"))


@query("""WITH o AS (SELECT DISTINCT record_id, signal, clock, assumption_monitored, reading, rarity, assessment, maturity FROM observation_log)
SELECT record_id, 'undefined_without_reason' AS rule FROM o WHERE reading.value IS NULL AND coalesce(trim(reading.undefined_reason), '') = ''
UNION ALL SELECT record_id, 'percentile_bounds' FROM o WHERE NOT (rarity.level_percentile BETWEEN 0 AND 1)
UNION ALL SELECT record_id, 'window_rule' FROM o WHERE CASE WHEN rarity.basis = 'trailing_fixed' THEN coalesce(rarity."window", 0) < 1 ELSE rarity."window" IS NOT NULL END
UNION ALL SELECT record_id, 'leaking_production' FROM o WHERE maturity = 'production' AND (rarity.basis = 'full_sample' OR assessment.mechanism = 'rejected')
UNION ALL SELECT record_id, 'assumption_empty' FROM o WHERE coalesce(trim(assumption_monitored), '') = ''
UNION ALL SELECT record_id, 'reading_fields' FROM o WHERE coalesce(trim(reading.units), '') = ''
UNION ALL SELECT record_id, 'choice' FROM o WHERE NOT coalesce(clock IN ('daily', 'weekly', 'monthly', 'structural') AND maturity IN ('production', 'research', 'rejected') AND rarity.basis IN ('expanding', 'trailing_fixed', 'full_sample') AND assessment.mechanism IN ('pass', 'rejected')
  AND assessment.measurement_validity IN ('H', 'M', 'L') AND assessment.investment_usefulness IN ('H', 'M', 'L') AND assessment.evidence_maturity IN ('H', 'M', 'L'), false)
UNION ALL SELECT record_id, 'signal_form' FROM o WHERE NOT regexp_full_match(signal, '[a-z][a-z0-9_]*')""")
def b9_validate_records(spark: SparkSession, folder: str) -> DataFrame:
    return bi.validate(raw_records(spark, folder), "record_id", "text")


_STRUCTS = {
    "assessment": ("evidence_maturity", "investment_usefulness", "measurement_validity", "mechanism"), "rarity": ("basis", "level_percentile", "window"), "reading": ("estimator", "undefined_reason", "units", "value"),
}


def _canonical_sql() -> str:
    """The canonical text: keys in order, no blanks, nulls written out."""
    cell = lambda name, at: f"""'"{name}":' || coalesce(to_json({at})::VARCHAR, 'null')"""
    parts = []
    for name in ("as_of", "assessment", "assumption_monitored", "available_at", "clock", "maturity", "rarity", "reading", "signal", "spec_version", "supersedes"):
        inner = " || ',' || ".join(cell(f, f'{name}."{f}"') for f in _STRUCTS.get(name, ()))
        parts.append(f"""'"{name}":' || CASE WHEN {name} IS NULL THEN 'null' ELSE '{{' || {inner} || '}}' END""" if inner else cell(name, name))
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


@query(f"SELECT DISTINCT record_id, sha256({_canonical_sql()}) AS sha256 FROM observation_log")
def b6_canonical_hash(spark: SparkSession, folder: str) -> DataFrame:
    return raw_records(spark, folder).select("record_id", bi.sha256_of_json(F.col("text")).alias("sha256"))


@query("SELECT record_id, as_of LIKE '<%>' AS placeholder FROM (SELECT DISTINCT record_id, as_of FROM observation_log)")
def b11_placeholder(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).select("record_id", "as_of").distinct().select("record_id", F.col("as_of").rlike(r"^<.*>$").alias("placeholder"))


@query(f"WITH {bonds_sql('de_bond10_ret')}, v AS (SELECT source_id, month AS obs_month, last_day((month + INTERVAL 2 MONTH)::DATE) AS as_of, de_bond10_ret AS x, count(de_bond10_ret) OVER (PARTITION BY source_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM b) SELECT source_id, obs_month, as_of, x FROM v WHERE k >= 24 AND x IS NOT NULL")
def b12_lagged_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Readings relabelled by the month they became known (two later), after 24 valid ones."""
    a = w.Along("source_id", "month")
    rows = bonds(spark, folder, "de_bond10_ret").withColumn("k", F.count("de_bond10_ret").over(a.ever())).where("k >= 24 and de_bond10_ret is not null")
    return rows.select("source_id", F.col("month").alias("obs_month"), F.last_day(F.add_months("month", 2)).alias("as_of"), F.col("de_bond10_ret").alias("x"))


@query(f"WITH {_REC}, m AS (SELECT source_id, max(month) AS z FROM x GROUP BY ALL) SELECT r.source_id, r.month, least(floor(round(p, 12) * 10), 9)::INT AS decile FROM r JOIN m USING (source_id) WHERE i > 24 AND r.month <= last_day((z - INTERVAL 12 MONTH)::DATE)")
def b13_settled_deciles(spark: SparkSession, folder: str) -> DataFrame:
    """Causal deciles of rows that are settled: a year old, after 24 rows."""
    rows = ranked_yields(spark, folder)
    a = w.Along("source_id", "month")
    rows = rows.withColumn("i", a.number()).withColumn("z", F.max("month").over(Window.partitionBy("source_id")))
    return rows.where((F.col("i") > 24) & (F.col("month") <= F.last_day(F.add_months("z", -12)))).select("source_id", "month", F.least(F.floor(F.round("p", 12) * 10), F.lit(9)).cast("int").alias("decile"))


@query("""WITH m AS (SELECT load_id, file, max(sha256) AS s FROM panel_manifest WHERE load_id IS NOT NULL GROUP BY ALL), l AS (SELECT load_id AS prior, lead(load_id) OVER (ORDER BY load_id) AS load_id FROM (SELECT DISTINCT load_id FROM m)),
a AS (SELECT l.load_id, file, s FROM m JOIN l ON m.load_id = l.prior WHERE l.load_id IS NOT NULL), b AS (SELECT m.load_id, file, s FROM m JOIN l ON m.load_id = l.load_id)
SELECT coalesce(a.load_id, b.load_id) AS load_id, coalesce(a.file, b.file) AS file, CASE WHEN a.load_id IS NULL THEN 'added' WHEN b.load_id IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.load_id = b.load_id AND a.file IS NOT DISTINCT FROM b.file WHERE a.load_id IS NULL OR b.load_id IS NULL OR a.s IS DISTINCT FROM b.s""")
def b14_manifest_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every load against the one before it."""
    return files.manifest_changes_by_load(table(spark, folder, "panel_manifest"), "load_id", ["file"], "sha256")


@query("SELECT snapshot_no, count(*) AS rows, count(*) FILTER (try_cast(last_obs AS DATE) IS NULL) AS dateless_rows, min(try_cast(last_obs AS DATE)) AS first_obs, max(try_cast(last_obs AS DATE)) AS last_obs FROM (SELECT snapshot_no, CASE WHEN regexp_full_match(last_obs, '\\d{4}-\\d{2}-\\d{2}') THEN last_obs END AS last_obs FROM vintage_manifest) GROUP BY ALL")
def b15_vintage_coverage(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_from_unix_date(day_number(F.col("last_obs")))
    return files.vintage_coverage(table(spark, folder, "vintage_manifest"), "snapshot_no", day)


@query(f"WITH {daily_sql('mkt_ret')} SELECT source_id, count(mkt_ret) AS n, min(date) AS first, max(date) AS last, min(mkt_ret) AS lowest, min_by(date, struct_pack(v := mkt_ret, d := date)) AS lowest_on, max(mkt_ret) AS highest, max_by(date, struct_pack(v := mkt_ret, d := date)) AS highest_on FROM p WHERE mkt_ret IS NOT NULL GROUP BY ALL")
def b16_source_stamp(spark: SparkSession, folder: str) -> DataFrame:
    r = F.struct("mkt_ret", "date")
    return daily(spark, folder, "mkt_ret").where("mkt_ret is not null").groupBy("source_id").agg(F.count("mkt_ret").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("mkt_ret").alias("lowest"), F.min_by("date", r).alias("lowest_on"), F.max("mkt_ret").alias("highest"), F.max_by("date", r).alias("highest_on"))


_STATUS = "CASE WHEN reading.value < -0.1 THEN 'intact' WHEN reading.value > 0.1 THEN 'violated' WHEN reading.value IS NOT NULL THEN 'under_test' END"


@query(f"WITH {_VIEW.format(where='')}, l AS (SELECT *, row_number() OVER (PARTITION BY region, signal ORDER BY as_of DESC) AS m FROM v), k AS (SELECT region, assumption_monitored, signal, {_STATUS} AS s FROM l WHERE m = 1) SELECT region, assumption_monitored, count(DISTINCT signal) AS signals, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS status, count(DISTINCT s) > 1 AS conflict FROM k GROUP BY ALL")
def b18_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = log(spark, folder).withColumn("value", F.col("reading.value"))
    latest = bi.known_at(rows, 2**62, SERIES, at(), "record_id", ["value", "assumption_monitored"])
    keyed = latest.withColumn("who", F.struct("region", "assumption_monitored"))
    out = bi.ledger(keyed, "who", w.sign_state(F.col("value")), ["as_of", "value"])
    return out.select("who.region", "who.assumption_monitored", F.size("signals").cast("long").alias("signals"), "status", "conflict")


@query(f"WITH {_VIEW.format(where='')}, q AS (SELECT region, signal, as_of, least(rarity.level_percentile, 1 - rarity.level_percentile) <= 0.05 AS f FROM v WHERE rarity.level_percentile IS NOT NULL), g AS (SELECT *, sum(c) OVER (PARTITION BY region, signal ORDER BY as_of) AS run FROM (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY region, signal ORDER BY as_of) THEN 1 ELSE 0 END AS c FROM q)), u AS (SELECT region, signal, run, f, count(*) AS length, max(as_of) AS z FROM g GROUP BY ALL) SELECT region, signal, sum(length)::BIGINT AS observations, round(sum(CASE WHEN f THEN length ELSE 0 END) / sum(length), 4) AS share_inside, count(*) FILTER (f) AS spells, median(length) FILTER (f) AS median_length, max(length) FILTER (f) AS longest, max(z) FILTER (f) AS last_inside FROM u GROUP BY ALL")
def b19_axis_history(spark: SparkSession, folder: str) -> DataFrame:
    """How often, how long and when last each axis was inside its tail, on the current view."""
    from chronoplane.operators.runs import contiguous_runs

    view = bi.current_view(log(spark, folder).withColumn("p", F.col("rarity.level_percentile")), SERIES, at(), "record_id", ["p"])
    flags = view.withColumn("f", w.tail_mass(F.col("p")) <= 0.05)
    u = contiguous_runs(flags, SERIES, "as_of", "f")
    inside = F.when(F.col("f"), F.col("length"))
    return u.groupBy(*SERIES).agg(F.sum("length").alias("observations"), F.round(F.sum(F.coalesce(inside, F.lit(0))) / F.sum("length"), 4).alias("share_inside"), F.count_if("f").alias("spells"), F.percentile(inside, F.lit(0.5)).alias("median_length"), F.max(inside).alias("longest"), F.max(F.when(F.col("f"), F.col("end"))).alias("last_inside"))


def guarded_builds() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every signal as a build over one daily panel (series, date, four columns): what differs between signals is the panel."""
    first = lambda p: p.groupBy("series", F.last_day("date").alias("month"))
    closes = lambda p: first(p).agg(*[F.max_by(c, "date").alias(c) for c in ("x", "y", "u", "v")], F.max("date").alias("date"))
    # a month is known at its last reading
    by_month = lambda out, p: out.join(closes(p).select("series", "month", "date"), ["series", "month"]).drop("month")
    entities = lambda p: closes(p).select("series", "month", F.inline(F.array(*[F.struct(F.lit(c).alias("entity"), (F.abs(F.col(c)) + 0.01).alias("value")) for c in ("x", "y", "u", "v")])))
    known = lambda p: closes(p).select("series", "month", F.col("x").alias("ebp"))
    return {
        "volatility": lambda p: signals.volatility(p.select("series", "date", F.col("x").alias("mkt_ret")), burn_in=63, window=126, step=252),
        "stock_bond_daily": lambda p: signals.stock_bond_daily(p.select("series", "date", F.col("x").alias("eq"), F.col("y").alias("bond"))),
        "stock_bond_monthly": lambda p: by_month(signals.stock_bond_monthly(closes(p).select("series", "month", F.col("x").alias("eq"), F.col("y").alias("bond")), 12, 24), p),
        "valuation": lambda p: by_month(signals.valuation(closes(p).select("series", "month", (2 + F.col("x")).alias("price"), (2 + F.col("y")).alias("earnings"), (2 + F.col("u")).alias("cpi")), 12, 24), p),
        "concentration": lambda p: by_month(signals.concentration(entities(p), 24), p),
        "credit": lambda p: by_month(signals.credit(known(p), 24).drop("as_of").withColumnRenamed("obs_month", "month"), p),
        "tail": lambda p: signals.tail(p.select("series", "date", (100 + 1000 * F.col("x")).alias("skew"))),
        "cross_section": lambda p: signals.cross_section(p, ["x", "y", "u", "v"]),
        "informativeness": lambda p: signals.informativeness(signals.tail(p.select("series", "date", (100 + 1000 * F.col("x")).alias("skew"))), "date", "rn_skew_pctile"),
    }


@query("SELECT build, 0::BIGINT AS changed_rows FROM (VALUES " + ", ".join(f"('{n}')" for n in sorted(signals.SIGNALS)) + ") t(build)")
def b21_look_ahead_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each of the nine signals that change, to the last bit, when all after a day is replaced by noise: none."""
    columns = {"mkt_ret": "x", "bond10_ret": "y", "ind_nodur": "u", "ind_hlth": "v"}
    panel = daily(spark, folder, *columns).where("mkt_ret > -1 and mkt_ret < 1").withColumnsRenamed({"source_id": "series", **columns})
    panel = materialise(panel, "guarded-panel")  # every build reads it twice
    cut = panel.agg(F.date_from_unix_date(F.percentile_approx(F.unix_date("date"), F.lit(0.7))).alias("d")).first()["d"]
    out = None
    for name, build in guarded_builds().items():
        changed = bi.look_ahead(build, panel, ["series"], "date", list(columns.values()), cut).agg(F.lit(name).alias("build"), F.count(F.lit(1)).alias("changed_rows"))
        out = changed if out is None else out.unionByName(changed)
    return out


# -- sources and sinks -------------------------------------------------------------------------------------------------
@query(f"WITH {daily_sql('mkt_ret', 'rf')} SELECT source_id, date, mkt_ret, rf FROM p")
def sc1_sk1_csv_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel written as CSV and scanned again with a given schema."""
    path = scratch(spark, "csv")
    daily(spark, folder, "mkt_ret", "rf").write.option("header", True).csv(path)
    return files.read_csv_panel(spark, path, "source_id string, date date, mkt_ret double, rf double")


@query(f"WITH {bonds_sql('jp_y10')} SELECT month AS date, source_id, jp_y10 FROM b")
def sc3_unnamed_index(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "csv")
    bonds(spark, folder, "jp_y10").select("month", "source_id", "jp_y10").write.option("header", True).csv(path)
    return files.read_csv_panel(spark, path, "_c0 date, source_id string, jp_y10 double", index="date")


@query(f"WITH {daily_sql('mkt_ret', 'rf')} SELECT source_id, date, round(mkt_ret, 6) AS mkt_ret, round(rf, 6) AS rf FROM p")
def sc4_preamble_text(spark: SparkSession, folder: str) -> DataFrame:
    """The panel as vendor text (title, header, per cent, sentinels for missing cells), one file per feed, parsed again."""
    path = scratch(spark, "text")
    cell = lambda c: F.coalesce(F.format_string("%.6f", F.col(c) * 100), F.lit("-99.99"))
    rows = daily(spark, folder, "mkt_ret", "rf")
    body = F.concat(F.date_format("date", "yyyyMMdd"), F.lit(","), cell("mkt_ret"), F.lit(","), cell("rf"))
    texts = rows.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_list(body)), "\n").alias("t"))
    texts.select("source_id", F.concat(F.lit("Created by a vendor\n\n,mkt,rf\n"), "t", F.lit("\n\nCopyright\n")).alias("value")).repartition("source_id").write.partitionBy("source_id").option("lineSep", "\u0001").text(path)
    whole = spark.read.text(path, wholetext=True).select(F.col("source_id").alias("file"), F.regexp_replace("value", "\u0001", "").alias("value"))
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    parsed = text_panels.daily_table(lines, ["mkt_ret", "rf"])
    return parsed.select(F.col("file").alias("source_id"), "date", F.round("mkt_ret", 6).alias("mkt_ret"), F.round("rf", 6).alias("rf"))


_DOC = "First title\n\n,A,B\n200001, 1.0, 2\n200002, -99.99, 3\n\n2000, 5, 5\nSecond title\n\n,A,B\n200001, 7, 8\n200002, 9, -999\n\nThird title\n,A,B\n2000, 1, 1\n"


@query("SELECT month, a::DOUBLE AS a, b::DOUBLE AS b FROM (VALUES (DATE '2000-01-31', 7.0, 8.0), (DATE '2000-02-29', 9.0, NULL)) t(month, a, b)")
def sc5_titled_block(spark: SparkSession, folder: str) -> DataFrame:
    """One titled block of a file with several (a fixed made-up text)."""
    lines = spark.createDataFrame([("f", _DOC)], "file string, value string").select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return text_panels.titled_block(lines, "Second title", ["a", "b"]).select("month", "a", "b")


_DAT = "x\nValue Weight Dollar Returns  All 4 Data Items Not Reqd\nnames\n197501 1.5 2.5\n197502 3 -99.99\n\nValue Weight Dollar Returns\nnames\n197501 4 5\n197502 6 7\n\nRatios\n1975 8 9\n"


@query("SELECT key, a::DOUBLE AS a, b::DOUBLE AS b FROM (VALUES ('197501', 4.0, 5.0), ('197502', 6.0, 7.0)) t(key, a, b)")
def sc6_stacked_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """A block picked by kind, frequency and requirement (a fixed made-up text)."""
    lines = spark.createDataFrame([("f", _DAT)], "file string, value string").select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    rows = text_panels.pick_block(text_panels.stacked_blocks(lines), "Dollar", monthly=True, required=True)
    return rows.select("key", F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b"))


@query(f"WITH {bonds_sql('jp_y10')} SELECT DISTINCT month, round(year(month) + month(month) / 100, 2) AS x, month AS decoded FROM b")
def sc7_decimal_dates(spark: SparkSession, folder: str) -> DataFrame:
    x = F.round(F.year("month") + F.month("month") / 100, 2)
    return bonds(spark, folder, "jp_y10").select("month", x.alias("x"), text_panels.year_month_decimal(x).alias("decoded")).distinct()


@query("SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL")
def sc9_sc10_fresh_and_cached(spark: SparkSession, folder: str) -> DataFrame:
    """Of an old and a fresh source the fresh one, built once and kept."""
    days = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return files.cached(spark, scratch(spark, "cache"), lambda: files.prefer_fresh(days.where("day < '1996-01-01'"), days, "day"))


@query("SELECT DISTINCT record_id, region, signal, as_of, available_at, supersedes, reading.value AS value, rarity.level_percentile AS p, assessment.mechanism AS mechanism FROM observation_log")
def sc11_sk4_log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The log written as JSON lines and read back with its schema."""
    rows = log(spark, folder).distinct()
    path = scratch(spark, "log")
    files.write_log(rows, path, ["available_at", "as_of"])
    back = files.read_log(spark, path, rows.schema)
    return back.select("record_id", *SERIES, "as_of", "available_at", "supersedes", F.col("reading.value").alias("value"), F.col("rarity.level_percentile").alias("p"), F.col("assessment.mechanism").alias("mechanism"))


@query(f"WITH {bonds_sql('jp_y10')} SELECT source_id, month, jp_y10 FROM b")
def sc12_vintage_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of vintage files, one per feed, each with a row that has no date."""
    path = scratch(spark, "vintages")
    rows = bonds(spark, folder, "jp_y10").select("source_id", F.date_format("month", "yyyy-MM-dd").alias("month"), "jp_y10")
    blank = rows.select("source_id").distinct().select("source_id", F.lit(None).cast("string").alias("month"), F.lit(None).cast("double").alias("jp_y10"))
    rows.unionByName(blank).repartition("source_id").write.partitionBy("source_id").option("header", True).csv(path)
    return files.read_vintages(spark, path, "month string, jp_y10 double, source_id string", "month").select("source_id", "month", "jp_y10")


@query()
def sc13_file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all files of the folder."""
    return files.file_digests(spark, folder)


@query("SELECT n_name AS name, length(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def sc13_known_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """A file for every nation, of its name and a line feed, digested."""
    path = scratch(spark, "bytes")
    table(spark, folder, "nation").select("n_name", F.col("n_name").alias("value")).repartition("n_name").write.partitionBy("n_name").text(path)
    rows = files.file_digests(spark, path).where("file like 'n_name=%'")
    return rows.select(F.url_decode(F.regexp_extract("file", "^n_name=([^/]*)/", 1)).alias("name"), "bytes", "sha256")


@query("WITH c AS (SELECT lower(trim(sha256)) AS sha256, wayback_timestamp, series FROM vintage_manifest WHERE sha256 IS NOT NULL), k AS (SELECT sha256, min(struct_pack(wayback_timestamp := wayback_timestamp, series := series)) AS r FROM c GROUP BY ALL) SELECT sha256, r.wayback_timestamp, r.series FROM k")
def sc14_archive_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "vintage_manifest").withColumn("sha256", F.lower(F.trim("sha256")))
    return files.archive_index(rows, "sha256", "wayback_timestamp", ["series"])


@query("SELECT region, signal, as_of, available_at, sha256, CASE WHEN bool_or(record_id % 3 = 0) THEN 'captured' ELSE 'reconstructed' END AS provenance FROM observation_log GROUP BY ALL")
def sk3_derived_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The log's manifest derived anew; rows the prior manifest (every third record) had keep their provenance."""
    key = [*SERIES, "as_of", "available_at"]
    rows = log(spark, folder)
    prior = rows.where("record_id % 3 = 0").select(*key, "sha256").distinct().withColumn("provenance", F.lit("captured"))
    return bi.derive_manifest(rows, prior, key, "sha256").select(*key, "sha256", "provenance").distinct()

