"""Irregular readings of a source onto a regular grid, gaps filled by monotone cubic interpolation or left marked.

A source is cut into time shards; each shard gets the neighbouring readings it needs as a halo. Between two readings the
missing periods are listed and filled by the shape-preserving cubic of Fritsch and Carlson; a longer gap than allowed
ends a segment: its periods stay marked and the slopes on either side use their own segment only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.operators.shards import exchange_halo, neighbour

OBSERVED, FILLED, GAP = "observed", "filled", "gap"


def weekday_number(day: Column) -> Column:
    """Number of weekdays (Monday to Friday) from Monday 1969-12-29 up to the day; a weekend day has Friday's number and a half."""
    shifted = day + F.lit(3)
    week, place = F.floor(shifted / 7), F.pmod(shifted, F.lit(7))
    return (week * 5 + F.least(place, F.lit(4)) + F.when(place > 4, F.lit(0.5)).otherwise(F.lit(0.0))).cast("double")


def weekday_date(number: Column) -> Column:
    """The date of a whole weekday number."""
    return F.date_from_unix_date((F.floor(number / 5) * 7 + F.pmod(number, F.lit(5)) - 3).cast("int"))


def month_number(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("double")


def month_date(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1))


def _edge(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    """One-sided three-point slope at the end of a segment, held to the shape of the data."""
    d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
    d = F.when(F.signum(d) != F.signum(s0), F.lit(0.0)).when((F.signum(s0) != F.signum(s1)) & (F.abs(d) > 3 * F.abs(s0)), 3 * s0).otherwise(d)
    return F.coalesce(d, s0)


def _inner(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    """Weighted harmonic mean of the secants on both sides, zero at a turning point."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(s0 * s1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / s0 + w1 / s1))


def onto_grid(readings: DataFrame, keys: Sequence[str], position: str, value: str, shard_length: int, max_fill: int, latest: str | None = None) -> DataFrame:
    """Keys, ``position`` (whole number of the period), ``value`` and ``status`` (observed, filled, gap).

    ``readings`` has no null or NaN values and one row per keys and position; with ``latest`` it may have several, and the
    one greatest in that column stands. A position is a double: a whole number is a
    period of the grid, a fraction lies between two (it bounds the source and shapes the curve, but fills no period).
    A gap of more than ``max_fill`` missing periods is left marked and splits the source into segments. Every period
    between a source's first and last reading comes out exactly once; a source with one reading gives that period only.
    A value of infinity counts as a reading, its neighbourhood is filled with null values.
    """
    keys = list(keys)
    more = [F.col(latest).alias("_l")] if latest else []
    df = readings.select(*keys, F.col(position).alias("p"), F.col(value).alias("v"), *more).withColumn("_shard", F.floor(F.col("p") / shard_length).cast("int")).repartition(*keys, "_shard")
    if latest:  # partitioned by shard already: folds without a shuffle
        df = df.groupBy(*keys, "_shard", "p").agg(F.max_by("v", "_l").alias("v"))
    near = exchange_halo(df, keys, "_shard", "p", ["v"], 1, 2, repartition=False)
    at = lambda field, k: neighbour(keys, "_shard", "p", field, k)
    near = near.withColumns({f"{f}{n}": at(f, k) for n, k in (("b", -1), ("a", 1), ("c", 2)) for f in ("p", "v")})
    # secants of the three intervals around [p, pa]; an interval across a long gap belongs to no segment
    missing = lambda x, y: F.ceil(y) - F.floor(x) - 1
    wide = lambda x, y: missing(x, y) > max_fill
    near = near.withColumns({
        "h": F.col("pa") - F.col("p"), "s": (F.col("va") - F.col("v")) / (F.col("pa") - F.col("p")), "long": wide(F.col("p"), F.col("pa")),
        "hb": F.when(~wide(F.col("pb"), F.col("p")), F.col("p") - F.col("pb")), "hc": F.when(~wide(F.col("pa"), F.col("pc")), F.col("pc") - F.col("pa")),
    }).withColumns({"sb": (F.col("v") - F.col("vb")) / F.col("hb"), "sc": (F.col("vc") - F.col("va")) / F.col("hc")})
    c = F.col
    near = near.withColumns({
        "d0": F.when(c("hb").isNotNull(), _inner(c("hb"), c("h"), c("sb"), c("s"))).otherwise(_edge(c("h"), c("hc"), c("s"), c("sc"))),
        "d1": F.when(c("hc").isNotNull(), _inner(c("h"), c("hc"), c("s"), c("sc"))).otherwise(_edge(c("h"), c("hb"), c("s"), c("sb"))),
    })
    first, last = F.floor(c("p")) + 1, F.ceil(c("pa")) - 1
    empty = F.array().cast("array<bigint>")
    between = F.when(c("pa").isNotNull() & (last >= first), F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(empty)
    own = F.when(c("p") == F.floor(c("p")), F.array(c("p").cast("bigint"))).otherwise(empty)
    rows = near.withColumn("q", F.explode(F.concat(own, between)))
    t = (c("q") - c("p")) / c("h")
    hermite = (1 + 2 * t) * F.pow(1 - t, F.lit(2.0)) * c("v") + t * F.pow(1 - t, F.lit(2.0)) * c("h") * c("d0") + t * t * (3 - 2 * t) * c("va") + t * t * (t - 1) * c("h") * c("d1")
    status = F.when(c("q") == c("p"), F.lit(OBSERVED)).when(c("long"), F.lit(GAP)).otherwise(F.lit(FILLED))
    filled = F.when(status == OBSERVED, c("v")).when(status == FILLED, F.when(F.abs(hermite) < float("inf"), hermite))
    return rows.select(*keys, c("q").alias(position), filled.alias(value), status.alias("status"))
