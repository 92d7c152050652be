"""Time shards of one source with halo readings from their neighbours.

A long source is cut into shards of time so that no task holds a whole source. An operator that looks a few readings
back or ahead needs the edges of the neighbouring shards: each shard publishes its first and last readings (a bounded
number), the small table of shards passes them on, also over shards with fewer readings than the halo is wide, and every
reading gets them as two arrays. Only the small table moves; the readings stay where their shard is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exchange_halo(df: DataFrame, keys: Sequence[str], shard: str, order: str, fields: Sequence[str], before: int, after: int, repartition: bool = True) -> DataFrame:
    """Adds ``_i`` and ``_n`` (place in the shard, readings in it), ``_prev`` and ``_next`` (halo readings in order).

    ``(keys, order)`` must be unique and without nulls. Every array holds at most ``before`` or ``after`` structs of ``order`` and
    ``fields``; it is shorter only where the source itself begins or ends.
    """
    keys = list(keys)
    at = [*keys, shard]
    here = Window.partitionBy(*at).orderBy(order)
    if repartition:
        df = df.repartition(*at)
    df = df.withColumn("_i", F.row_number().over(here)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*at)))
    reading = F.struct(order, *fields)
    edges = df.where((F.col("_i") <= after) | (F.col("_i") > F.col("_n") - before)).groupBy(*at).agg(
        F.sort_array(F.collect_list(F.when(F.col("_i") <= after, reading))).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("_i") > F.col("_n") - before, reading))).alias("tail"),
    )
    along = Window.partitionBy(*keys).orderBy(shard)
    behind = F.flatten(F.collect_list("tail").over(along.rowsBetween(-max(before, 1), -1)))
    ahead = F.flatten(F.collect_list("head").over(along.rowsBetween(1, max(after, 1))))
    halo = edges.select(
        *at,
        F.slice(behind, F.greatest(F.lit(1), F.size(behind) - F.lit(before - 1)), F.lit(before)).alias("_prev") if before else F.array().alias("_prev"),
        F.slice(ahead, F.lit(1), F.lit(after)).alias("_next") if after else F.array().alias("_next"),
    )
    # plain equality on the columns the readings are partitioned by: only the small side moves
    return df.join(halo, at)


def neighbour(keys: Sequence[str], shard: str, order: str, field: str, offset: int) -> Column:
    """The ``field`` of the reading ``offset`` places on (negative: back), null beyond the source's ends."""
    here = Window.partitionBy(*keys, shard).orderBy(order)
    if offset == 0:
        return F.col(field)
    if offset < 0:
        place = F.col("_i") + F.lit(offset)
        return F.when(place >= 1, F.lag(field, -offset).over(here)).otherwise(F.get(F.col("_prev"), F.size("_prev") - 1 + place)[field])
    place = F.col("_i") + F.lit(offset) - F.col("_n")
    return F.when(place <= 0, F.lead(field, offset).over(here)).otherwise(F.get(F.col("_next"), (place - 1).cast("int"))[field])
