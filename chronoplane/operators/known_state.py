"""Events combined with what was known at their time.

The as-known state of an entity at an instant is the best record available by then. "Best" is a maximum, so a periodic
snapshot is the running maximum over the records of all earlier periods, and the state at an event is the maximum of the
preceding snapshot and the changes between the snapshot and the event. Snapshots and change log are written tables of the
shared folder. Snapshots, changes and events meet in one shuffle
by entity and period; within a period they are replayed in time order by a running maximum. No event is paired with every
record of its entity, and a hot entity is spread over its periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.functions.instants import MICROS_PER_DAY
from chronoplane.session import materialise

PERIOD_DAYS = 91


def change_log(records: DataFrame, entity: Sequence[str], available: Column, best: Column, period_days: int = PERIOD_DAYS) -> DataFrame:
    """Changes: entity, ``period``, ``at`` (epoch microseconds of availability), ``best`` (struct that orders the records)."""
    log = records.select(*entity, available.alias("at"), best.alias("best")).where(F.col("at").isNotNull())
    return log.withColumn("period", F.floor(F.col("at") / F.lit(period_days * MICROS_PER_DAY)).cast("int"))


def as_known_snapshots(changes: DataFrame, wanted: DataFrame, entity: Sequence[str]) -> DataFrame:
    """The as-known best at the start of every period of ``wanted`` (entity, period): all changes of earlier periods.

    Changes are reduced to one row per entity and period before they move, so the window over an entity holds at most one
    row per period of its history.
    """
    keys = [*entity, "period"]
    moved = changes.groupBy(*keys).agg(F.max("best").alias("best")).withColumn("want", F.lit(False))
    asked = wanted.select(*keys).distinct().select(*keys, F.lit(None).cast(changes.schema["best"].dataType).alias("best"), F.lit(True).alias("want"))
    both = moved.unionByName(asked).groupBy(*keys).agg(F.max("best").alias("best"), F.max("want").alias("want"))
    earlier = Window.partitionBy(*entity).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("best", F.max("best").over(earlier)).where("want and best is not null").drop("want")


def as_known_at(
    events: DataFrame, event_id: Sequence[str], event_at: Column, records: DataFrame, available: Column, best: Column, entity: Sequence[str], period_days: int = PERIOD_DAYS
) -> DataFrame:
    """Each event with ``best``, the greatest of its entity's records available at or before the event.

    Defined cases: an event without instant, without entity or before the entity's first available record gives no row;
    a record without readable availability was never available; repeated events give one row; ties of ``best`` are
    equal and so give the same row; other columns of either input are ignored.
    """
    entity, event_id = list(entity), list(event_id)
    whole = " and ".join(f"{k} is not null" for k in entity)
    # written: read for the snapshots and again for the replay, and kept should an executor be lost
    log = materialise(change_log(records.where(whole), entity, available, best, period_days), "change-log")
    kind = log.schema["best"].dataType
    asked = events.where(whole).select(*entity, event_at.alias("at"), *event_id).where("at is not null")
    asked = asked.withColumn("period", F.floor(F.col("at") / F.lit(period_days * MICROS_PER_DAY)).cast("int"))
    snapshots = materialise(as_known_snapshots(log, asked, entity), "as-known-snapshots")

    no_id = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in event_id]
    keys = [*entity, "period"]
    # rank: the snapshot comes before all changes, a change before an event of the same instant
    lanes = log.select(*keys, "at", F.lit(1).alias("rank"), "best", *no_id)
    lanes = lanes.unionByName(snapshots.select(*keys, F.lit(-(2**63)).alias("at"), F.lit(0).alias("rank"), "best", *no_id))
    lanes = lanes.unionByName(asked.select(*keys, "at", F.lit(2).alias("rank"), F.lit(None).cast(kind).alias("best"), *event_id))
    replay = Window.partitionBy(*keys).orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    state = lanes.withColumn("best", F.max("best").over(replay)).where("rank = 2 and best is not null")
    # partitioned by (entity, period) already: repeated events fold without a shuffle
    return state.groupBy(*keys, "at", *event_id).agg(F.first("best").alias("best")).select(*entity, *event_id, "at", "best")
