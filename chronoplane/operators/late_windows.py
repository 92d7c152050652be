"""Event-time windows that are corrected as late records arrive, up to a cut-off.

Keyed state per entity, window and event time: the winning record as it stood when the watermark closed the window, and
as it stands at the cut-off. "Wins" is a maximum, so states merge in any order and a record delivered twice changes
nothing. ``chronoplane.streaming.late_upsert`` upserts micro-batches into stored state. Records after the cut-off change no state; they are diverted for reporting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.functions.instants import MICROS_PER_DAY, day_start_micros


@dataclass(frozen=True)
class MonthWindows:
    """Calendar months of event time; the watermark passes ``delay_days`` after a month's end, lateness is allowed up to ``cutoff_days`` after it."""

    delay_days: int = 45
    cutoff_days: int = 180

    def of(self, day: Column) -> Column:
        return F.trunc(day, "month")

    def close(self, window: Column) -> Column:
        return day_start_micros(F.add_months(window, 1)) + F.lit(self.delay_days * MICROS_PER_DAY)

    def cutoff(self, window: Column) -> Column:
        return day_start_micros(F.add_months(window, 1)) + F.lit(self.cutoff_days * MICROS_PER_DAY)


def arrivals(records: DataFrame, entity: Sequence[str], event_day: Column, arrived: Column, turn: Column, value: Column, windows: MonthWindows) -> DataFrame:
    """Entity, ``event_day``, ``window``, ``arrived`` (epoch microseconds), ``turn``, ``value``; NaN and infinite values are undefined.

    Records without entity, readable event day or readable arrival have no window and are left out.
    """
    finite = F.when(~(F.isnan(value) | (F.abs(value) == float("inf"))), value)
    rows = records.select(*entity, event_day.alias("event_day"), arrived.alias("arrived"), turn.alias("turn"), finite.alias("value"))
    rows = rows.where(" and ".join(f"{k} is not null" for k in [*entity, "event_day", "arrived"]))
    return rows.withColumn("window", windows.of(F.col("event_day")))


def merge_state(rows: DataFrame, entity: Sequence[str], windows: MonthWindows) -> DataFrame:
    """State of arrivals: per entity, window and event day the winner at the close and at the cut-off. Reduced in each task before it is shuffled."""
    best = F.struct("arrived", "turn", "value")
    at_close = F.when(F.col("arrived") <= windows.close(F.col("window")), best)
    at_cutoff = F.when(F.col("arrived") <= windows.cutoff(F.col("window")), best)
    return rows.groupBy(*entity, "window", "event_day").agg(F.max(at_close).alias("closed"), F.max(at_cutoff).alias("final"))


def upsert_state(stored: DataFrame, fresh: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Stored state after the state of further arrivals: winners merge by maximum, in any order, any number of times; what is ``touched`` stays so."""
    marks = [F.max("touched").alias("touched")] if "touched" in fresh.columns else []
    return stored.unionByName(fresh).groupBy(*entity, "window", "event_day").agg(F.max("closed").alias("closed"), F.max("final").alias("final"), *marks)


def window_aggregates(state: DataFrame, entity: Sequence[str], only: str | None = None) -> DataFrame:
    """Per entity and window: count and sum (exact to 10 decimals, given to 4) of defined values at the close and at the cut-off, and whether the window was corrected.

    ``only``: a flag of the state; windows without a flagged row are left out.
    """
    exact = lambda c: F.col(f"{c}.value").try_cast("decimal(28,10)")
    total = lambda c: F.round(F.coalesce(F.sum(exact(c)), F.lit(0)), 4)
    out = state.groupBy(*entity, "window").agg(
        F.count("closed.value").alias("count_closed"), total("closed").alias("sum_closed"), F.count("final.value").alias("count_final"), total("final").alias("sum_final"),
        *([F.max(only).alias("_only")] if only else []),
    )
    if only:
        out = out.where("_only").drop("_only")
    return out.withColumn("corrected", (F.col("count_closed") != F.col("count_final")) | (F.col("sum_closed") != F.col("sum_final")))


def lateness(rows: DataFrame, windows: MonthWindows) -> DataFrame:
    """Adds ``days_late``: days after the window's cut-off, begun ones whole; zero or below for arrivals in time."""
    over = F.col("arrived") - windows.cutoff(F.col("window"))
    return rows.withColumn("days_late", F.ceil(over / F.lit(MICROS_PER_DAY)).cast("int"))


def dropped_late(rows: DataFrame, windows: MonthWindows) -> DataFrame:
    """The arrivals after their window's cut-off, with the lateness in days: reported, never merged."""
    return lateness(rows, windows).where(F.col("arrived") > windows.cutoff(F.col("window")))


def arrival_bounds(rows: DataFrame, batches: int) -> list[int]:
    """Instants that cut the arrivals, in their order, into about so many equal batches: approximate quantiles, one row. Arrivals of one instant aren't cut."""
    if batches < 2:
        return []
    cuts = rows.agg(F.approx_percentile("arrived", F.array(*[F.lit(i / batches) for i in range(1, batches)]), 1_000).alias("q")).first()["q"]
    return sorted(set(cuts or []))
