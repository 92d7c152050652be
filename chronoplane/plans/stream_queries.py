"""Streaming queries: the events table and the log replayed as streams, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.operators import late_windows
from chronoplane.plans.pipeline import late_rows
from chronoplane.plans.pipeline_sql import _LATE_AGG
from chronoplane.plans.registry import query
from chronoplane.session import scratch_folder as scratch
from chronoplane.streaming import windows as sw
from chronoplane.streaming.late_upsert import LateUpsert
from chronoplane.tables import table

_H = "strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M')"


@query(f"SELECT {_H} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st1_tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tumbling")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    sw.upserts(sw.windowed(sw.open_stream(spark, f"{folder}/events.parquet"), "ts", ["event_type"], "365 days", "1 hour", aggs).select("start", "event_type", "n", "total"), path)
    return sw.latest(spark, path, ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def delivered(spark: SparkSession, folder: str, name: str, again: bool = False, files_at_once: int = 4) -> DataFrame:
    """The events as a stream of several deliveries in order of time, one or more micro-batches each; with ``again`` the first delivery comes once more at the end, by then too late."""
    path = scratch(spark, name)
    rows = table(spark, folder, "events").where("ts is not null")
    kind = dict(rows.dtypes)["ts"]
    cuts = rows.agg(F.approx_percentile(F.col("ts").cast("timestamp").cast("double"), F.array(F.lit(0.4), F.lit(0.8)), 1_000).alias("q")).first()["q"] or []
    at = F.col("ts").cast("timestamp").cast("double")
    bounds = [float("-inf"), *sorted(set(cuts)), float("inf")]
    parts = [rows.where((at >= low) & (at < high)) for low, high in zip(bounds, bounds[1:])]
    for part in parts + parts[:1] * again:
        part.withColumn("ts", F.col("ts").cast(kind)).write.mode("append").parquet(path)
    return sw.open_stream(spark, path, files_at_once)


#: A watermark an hour behind closes a window, or a session, that ends by then.
_SEEN = "z AS (SELECT max(ts) - INTERVAL 1 HOUR AS z FROM events)"


@query(f"""WITH {_SEEN}, x AS (SELECT user_id, ts, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM x, z WHERE s + INTERVAL 2 HOUR <= z GROUP BY s""")
def st2_sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Closed sliding windows: events and distinct users, counted per window and user first, so the state of a window is a row a user and goes when it closes."""
    path = scratch(spark, "sliding")
    stream = delivered(spark, folder, "events-sliding").withWatermark("ts", "1 hour")
    each = stream.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("k"))
    sw.upserts(each.groupBy("w").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("users")).select(F.col("w.start").alias("start"), "n", "users"), path, "append")
    return sw.latest(spark, path, ["start"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "users")


@query(f"""WITH {_SEEN}, o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o),
g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k) SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n, total FROM g, z WHERE b + INTERVAL 6 HOUR <= z""")
def st3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Closed sessions with a gap of six hours, on a stream."""
    path = scratch(spark, "sessions")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    sw.upserts(sw.sessions(delivered(spark, folder, "events-sessions"), "ts", ["user_id"], "1 hour", "6 hours", aggs).select("user_id", F.col("w.start").alias("start"), "n", "total"), path, "append")
    return sw.latest(spark, path, ["user_id", "start"]).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query(f"WITH {_SEEN} SELECT {_H} AS start, event_type, count(*) AS n FROM events, z WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= z GROUP BY ALL")
def st6_late_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Closed hours of a stream that delivers its first part twice: the second time it lies behind the watermark and is dropped."""
    path = scratch(spark, "dropped")
    stream = delivered(spark, folder, "events-again", again=True, files_at_once=1)
    sw.upserts(sw.windowed(stream, "ts", ["event_type"], "1 hour", "1 hour", [F.count(F.lit(1)).alias("n")]).select("start", "event_type", "n"), path, "append")
    rows = spark.read.parquet(f"{path}/out")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value))
SELECT user_id, n, round(sum(CASE WHEN i = 1 THEN pow(0.94, n - 1) ELSE 0.06 * pow(0.94, n - i) END * x * x), 6) AS variance FROM o GROUP BY user_id, n""")
def st4_stateful_level(spark: SparkSession, folder: str) -> DataFrame:
    """Exponentially weighted squares per user as keyed state."""
    path = scratch(spark, "level")
    sw.upserts(sw.running_level(sw.open_stream(spark, f"{folder}/events.parquet"), "user_id", "ts", "value"), path)
    return sw.latest(spark, path, ["key"]).select(F.col("key").alias("user_id"), "n", F.round("variance", 6).alias("variance"))


@query(_LATE_AGG + "SELECT *, count_closed <> count_final OR sum_closed <> sum_final AS corrected FROM u")
def st5_late_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream of files in the order of arrival: several micro-batches, each with the watermark its files carry; months as their last update left them."""
    entity = ["region", "signal"]
    rows, windows = late_rows(spark, folder)
    landing = scratch(spark, "late-landing")
    bounds = [0, *late_windows.arrival_bounds(rows, 3), 2**62]
    for low, high in zip(bounds, bounds[1:]):  # what arrives in a stretch is delivered before the next one begins
        rows.where(F.col("arrived").between(low, high - 1)).withColumn("since", F.lit(low).cast("long")).write.mode("append").parquet(landing)
    sink = LateUpsert(spark, scratch(spark, "late"), entity, windows)
    sink.run(sw.open_stream(spark, landing), lambda df: df.drop("since"), lambda df: df.agg(F.max("since")).first()[0])
    number = lambda c: F.col(c).cast("double").alias(c)
    return sink.aggregates().select(*entity, F.date_format("window", "yyyy-MM").alias("period"), "count_closed", number("sum_closed"), "count_final", number("sum_final"), "corrected")
