"""Runs, spells, episodes: gaps and islands along a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contiguous_runs(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Keys, state, ``start``, ``end``, ``length`` (rows) and ``run`` (its number) of every run of equal non-null states."""
    along = Window.partitionBy(*keys).orderBy(order)
    rows = df.where(F.col(state).isNotNull())
    fresh = ~F.col(state).eqNullSafe(F.lag(state).over(along))
    numbered = rows.withColumn("run", F.sum(fresh.cast("int")).over(along))
    return numbered.groupBy(*keys, "run", state).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"))


def spells(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Per key: number of spells of the flag, their median and longest length, the current spell's length, and rows since the flag last held.

    Rows with a null flag take no part. A series in which the flag never held gives zero spells and null lengths.
    """
    runs = contiguous_runs(df, keys, order, flag)
    last = F.max(F.col("end"))
    summary = runs.groupBy(*keys).agg(
        F.count_if(flag).cast("long").alias("spells"),
        F.percentile(F.when(F.col(flag), F.col("length")), F.lit(0.5)).alias("median_length"),
        F.max(F.when(F.col(flag), F.col("length"))).alias("longest"),
        F.max_by(F.when(F.col(flag), F.col("length")).otherwise(F.lit(0)), "run").alias("current"),
        F.when(F.count_if(flag) > 0, F.max_by(F.when(F.col(flag), F.lit(0)).otherwise(F.col("length")), "run")).alias("rows_since"),
        last.alias("last_row"),
    )
    return summary


def episodes(df: DataFrame, keys: Sequence[str], order: str, hot: Column, gap: int = 63) -> DataFrame:
    """Hot rows at most ``gap`` rows of the series apart form one episode: keys, ``episode``, ``start``, ``end``, ``hot_rows``."""
    along = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_row", F.row_number().over(along)).where(hot)
    fresh = F.coalesce((F.col("_row") - F.lag("_row").over(along)) > gap, F.lit(True))
    numbered = rows.withColumn("episode", F.sum(fresh.cast("int")).over(along))
    return numbered.groupBy(*keys, "episode").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("hot_rows"))


def transitions(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Row-normalised transition matrix in long form: ``was``, ``now``, ``n``, ``share``."""
    moved = df.where(F.col(state).isNotNull()).select(F.lag(state).over(Window.partitionBy(*keys).orderBy(order)).alias("was"), F.col(state).alias("now")).where("was is not null")
    counts = moved.groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("was")))


def switches(df: DataFrame, keys: Sequence[str], order: str, state: str, periods: int = 252) -> DataFrame:
    """Per key: state changes, changes per year, mean and median run length."""
    runs = contiguous_runs(df, keys, order, state)
    return runs.groupBy(*keys).agg(
        (F.count(F.lit(1)) - 1).alias("switches"), ((F.count(F.lit(1)) - 1) * periods / F.sum("length")).alias("per_year"),
        F.avg("length").alias("mean_dwell"), F.percentile("length", F.lit(0.5)).alias("median_dwell"),
    )


def monotone(df: DataFrame, keys: Sequence[str], order: str, value: str, slack: float = 1e-12) -> DataFrame:
    """Per key: whether the value never falls along the order."""
    step = df.withColumn("_up", F.col(value) >= F.lag(value).over(Window.partitionBy(*keys).orderBy(order)) - slack) if keys else df
    return step.groupBy(*keys).agg(F.coalesce(F.bool_and("_up"), F.lit(True)).alias("monotone"))
