"""Queries p1_ to p6_ over the test tables: the general operators with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.functions.instants import day_number, instant_micros, nan_to_null, utc_day
from chronoplane.operators import late_windows, phase_space, regular_grid, value_counts
from chronoplane.operators.known_state import as_known_at
from chronoplane.operators.snapshot_diff import canonical_day, canonical_digest, snapshot_changes
from chronoplane.session import materialise, scratch_folder
from chronoplane.streaming.late_upsert import LateUpsert
from chronoplane.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    values = {"sha256": canonical_digest(F.col("sha256")), "rows": F.col("rows"), "last_obs": canonical_day(F.col("last_obs"))}
    return snapshot_changes(table(spark, folder, "vintage_manifest"), "series", "snapshot_no", "delivered_at", "wayback_timestamp", values)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    records, captures = table(spark, folder, "observation_log"), table(spark, folder, "vintage_capture")
    available = instant_micros(F.col("available_at"))
    best = F.struct(day_number(F.col("as_of")).alias("as_of"), available.alias("available"), F.col("record_id"))
    known = as_known_at(captures, ["capture_id"], F.unix_micros("captured_at"), records, available, best, ["region", "signal"])
    return known.select("capture_id", F.col("best.record_id").alias("record_id"))


_DAY = r"\d{4}-\d{2}-\d{2}"
_SPAN = rf"[^:;]+:(?:{_DAY}\.\.{_DAY}|EMPTY)"


def manifest_columns() -> list[value_counts.Profiled]:
    """How the columns of ``panel_manifest`` are classed and measured; days are counted from year 1 so that measures are not negative."""
    since_year_one = 719_162
    c, real = F.col, lambda n: day_number(F.col(n))
    return [
        value_counts.Profiled("sha256", malformed=~c("sha256").rlike(r"^[0-9a-f]{64}\z"), checks=frozenset({"nulls", "pattern", "distinct"})),
        *[value_counts.Profiled(n, impossible=c(n) < 1, measure=c(n), checks=frozenset({"nulls", "range", "distinct", "shift"}), measured_only=True) for n in ("bytes", "rows")],
        value_counts.Profiled("first", malformed=real("first").isNull(), impossible=c("first") < "1800", measure=real("first") + since_year_one, checks=frozenset({"nulls", "pattern", "range", "shift"}), shift_days=1095, measured_only=True),
        value_counts.Profiled("last", malformed=real("last").isNull(), impossible=real("last") > utc_day(c("loaded_at")), measure=real("last") + since_year_one, checks=frozenset({"nulls", "pattern", "range", "shift"}), shift_days=1095, measured_only=True),
        value_counts.Profiled("column_spans", malformed=~c("column_spans").rlike(rf"^{_SPAN}(?:;{_SPAN})*\z"), measure=F.length("column_spans") - F.length(F.replace(c("column_spans"), F.lit(";"), F.lit(""))) + 1, checks=frozenset({"nulls", "pattern", "shift"})),
    ]


def _manifest_profile(spark: SparkSession, folder: str) -> tuple[DataFrame, list[value_counts.Profiled]]:
    """Profiles from a store that has been brought up to date with the table; the store lasts as long as the driver."""
    columns = manifest_columns()
    store = value_counts.CountStore(spark, scratch_folder(spark, "manifest-counts"))
    store.refresh(table(spark, folder, "panel_manifest"), "load_id", columns)
    return value_counts.profile(store.state()), columns


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    profiles, columns = _manifest_profile(spark, folder)
    return value_counts.out_of_order(profiles, columns).withColumnRenamed("part", "load_id")


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile itself: one row per load and column; lowest, highest and median of days are days since 0001-01-01 plus one."""
    profiles, columns = _manifest_profile(spark, folder)
    names = F.array(*[F.lit(c.column) for c in columns])
    return profiles.select(F.col("part").alias("load_id"), F.get(names, F.col("col").cast("int")).alias("column_name"), "rows", "nulls", "malformed", "impossible", "distinct", "lowest", "highest", "median", F.round("entropy", 6).alias("entropy"))


def daily_readings(spark: SparkSession, folder: str, fields: list[str]) -> DataFrame:
    """One row per feed, field and day of ``assets_daily``: copies of a day fold in each task before they are shuffled; null and NaN cells are no readings."""
    rows = table(spark, folder, "assets_daily").where("source_id is not null and date is not null")
    days = rows.groupBy("source_id", "date").agg(*[F.max(nan_to_null(F.col(f))).alias(f) for f in fields])
    return days.select("source_id", "date", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))).where("value is not null")


def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    readings = daily_readings(spark, folder, ["mkt_ret", "bond10_ret"])
    return phase_space.flag_readings(readings, ["source_id", "field"], "date", "value", lower=-1.0)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_flags(spark, folder).where("spike or stuck or impossible").select("source_id", F.date_format("date", "yyyy-MM-dd").alias("obs_date"), "field")


def late_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, late_windows.MonthWindows]:
    windows = late_windows.MonthWindows()
    log = table(spark, folder, "observation_log")
    day = F.date_from_unix_date(day_number(F.col("as_of")))
    return late_windows.arrivals(log, ["region", "signal"], day, instant_micros(F.col("available_at")), F.col("record_id"), F.col("reading.value"), windows), windows


#: Micro-batches the log is replayed in, in the order in which its records became available.
BATCHES = 4


def _late_sink(spark: SparkSession, folder: str) -> LateUpsert:
    rows, windows = late_rows(spark, folder)
    sink = LateUpsert(spark, scratch_folder(spark, "late-windows"), ["region", "signal"], windows)
    sink.replay(rows, BATCHES)
    return sink


def p5_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """The months as the last update of each left them."""
    number = lambda c: F.col(c).cast("double").alias(c)
    return _late_sink(spark, folder).aggregates().select("region", "signal", F.date_format("window", "yyyy-MM").alias("period"), "count_closed", number("sum_closed"), "count_final", number("sum_final"), "corrected")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_aggregates(spark, folder).where("corrected").select("region", "signal", "period")


def p5_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Records that came after their month's cut-off, as the batches diverted them."""
    return _late_sink(spark, folder).late().select(F.col("turn").alias("record_id"), "region", "signal", F.date_format("window", "yyyy-MM").alias("period"), "days_late").distinct()


MAX_FILL_DAYS, MAX_FILL_MONTHS = 5, 3


def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Weekday grid of ``mkt_ret`` and month grid of the two bond returns; a month's reading is that of its latest day with one."""
    daily = daily_readings(spark, folder, ["mkt_ret"]).select("source_id", "field", regular_grid.weekday_number(F.unix_date("date")).alias("p"), "value", "date")
    # both days of a weekend share a half position; the later one stands for it
    days = regular_grid.onto_grid(daily, ["source_id", "field"], "p", "value", 262, MAX_FILL_DAYS, latest="date")
    days = days.withColumn("period", F.date_format(regular_grid.weekday_date(F.col("p")), "yyyy-MM-dd"))

    bonds = table(spark, folder, "intl_bonds_monthly").where("source_id is not null and date is not null")
    fields = ["jp_bond10_ret", "de_bond10_ret"]
    at = regular_grid.month_number(F.col("date"))
    reading = lambda f: F.max(F.when(nan_to_null(F.col(f)).isNotNull(), F.struct("date", F.col(f).alias("v"))))["v"]
    monthly = bonds.groupBy("source_id", at.alias("p")).agg(*[reading(f).alias(f) for f in fields])
    monthly = monthly.select("source_id", "p", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))).where("value is not null")
    months = regular_grid.onto_grid(monthly, ["source_id", "field"], "p", "value", 120, MAX_FILL_MONTHS)
    months = months.withColumn("period", F.date_format(regular_grid.month_date(F.col("p")), "yyyy-MM"))
    return days.unionByName(months).select("source_id", "field", "period", (F.round("value", 9) + F.lit(0.0)).alias("value"), "status")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The periods of the written grid, values and all, that have no reading of their own."""
    return materialise(p6_grid(spark, folder), "grid").where(F.col("status") != regular_grid.OBSERVED).select("source_id", "field", "period")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_profile, p4_found, p4_flags, p5_found, p5_aggregates, p5_dropped, p6_found, p6_grid)}
