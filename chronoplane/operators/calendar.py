"""Calendars: month-end compounding, contiguous grids, publication policies, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_grid(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Every month end between a key's first and last date."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.select(*keys, F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("month")).withColumn("month", F.last_day("month"))


def compound_months(df: DataFrame, keys: Sequence[str], date: str, ret: str) -> DataFrame:
    """Month-end compounded returns; a month without readings inside the span has return 0, null days are skipped."""
    months = df.groupBy(*keys, F.last_day(date).alias("month")).agg((F.product(1 + F.col(ret)) - 1).alias(ret))
    return month_grid(df, keys, date).join(months, [*keys, "month"], "left").withColumn(ret, F.coalesce(ret, F.lit(0.0)))


def last_of_month(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """The month's last non-null value."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.last_day(date).alias("month")).agg(F.max_by(value, date).alias(value))


def grid_gaps(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Gate rows: keys, ``gate``, ``passed``, ``detail`` — whether the months are without gap and without duplicate."""
    n = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.last_day(date)).alias("months"),
        (F.months_between(F.trunc(F.max(date), "month"), F.trunc(F.min(date), "month")) + 1).cast("long").alias("span"),
    )
    gate = lambda name, ok, text: F.struct(F.lit(name).alias("gate"), ok.alias("passed"), text.alias("detail"))
    rows = F.array(
        gate("no_gap", F.col("months") == F.col("span"), F.concat(F.col("months").cast("string"), F.lit("/"), F.col("span").cast("string"))),
        gate("no_duplicate", F.col("rows") == F.col("months"), F.concat(F.col("rows").cast("string"), F.lit("/"), F.col("months").cast("string"))),
    )
    return n.select(*keys, F.inline(rows))


def next_business_day(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def _at(day: Column, hour: int, minute: int = 0) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f"T{hour:02d}:{minute:02d}:00Z"))


#: When a reading of a source becomes public (fixed values): 15th of the next month 14:00, next business day 13:00,
#: month end + 35 days 13:30, 20th of the next month 12:00, end of the next month 12:00, all UTC.
POLICIES = {
    "month_15": lambda d: _at(F.date_add(F.last_day(d), 15), 14),
    "next_business_day": lambda d: _at(next_business_day(d), 13),
    "month_end_35": lambda d: _at(F.date_add(F.last_day(d), 35), 13, 30),
    "month_20": lambda d: _at(F.date_add(F.last_day(d), 20), 12),
    "next_month_end": lambda d: _at(F.last_day(F.add_months(F.trunc(d, "month"), 1)), 12),
}


def available_at(day: Column, source: str) -> Column:
    """ISO instant at which a reading of the day becomes available; an unknown source raises."""
    if source not in POLICIES:
        raise ValueError(f"no availability policy for {source!r}")
    return POLICIES[source](day)


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """Every left row with the right side's last non-null value at or before its time.

    One union and one running ``last`` per key: no row meets more than its neighbours, unlike a range join.
    """
    keys = list(keys)
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value)).where(F.col(value).isNotNull())
    run = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = b.unionByName(a).withColumn("_v", F.last(value, ignorenulls=True).over(run)).where("_side = 1")
    return out.select("_row.*", F.col("_v").alias(value))


def nearest_prior(events: DataFrame, marks: DataFrame, keys: Sequence[str], time: str, lookback: int) -> DataFrame:
    """Each event with the earliest mark in the ``lookback`` days before it (``first_mark``, null if none).

    Both sides are cut into blocks of ``lookback`` days and met block by block, so only near rows are compared.
    """
    block = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / lookback)
    e = events.select(*keys, time).distinct().withColumn("_b", F.explode(F.array(block(time), block(time) - 1)))
    m = marks.select(*keys, F.col(time).alias("_m")).distinct().withColumn("_b", block("_m"))
    met = e.join(m, [*keys, "_b"], "left").withColumn("_m", F.when((F.col("_m") < F.col(time)) & (F.datediff(F.col(time), F.col("_m")) <= lookback), F.col("_m")))
    return met.groupBy(*keys, time).agg(F.min("_m").alias("first_mark"))
