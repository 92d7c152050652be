"""Event-time windows, sessions and stateful estimators on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def open_stream(spark: SparkSession, path: str, files_at_once: int = 4) -> DataFrame:
    """A Parquet table (a file or a folder) as a stream, a few files a micro-batch; local timestamps become instants of the session's zone."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as the source takes no single file
    return stream.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in stream.dtypes])


def windowed(stream: DataFrame, time: str, keys: Sequence[str], late: str, size: str, aggregates: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with a watermark; later records are dropped by the engine."""
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(frame.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "*").drop("w")


def sessions(stream: DataFrame, time: str, keys: Sequence[str], late: str, gap: str, aggregates: Sequence[Column]) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)


def upserts(stream: DataFrame, path: str, mode: str = "update") -> None:
    """Run a stream over what its source holds now; every micro-batch's updates go to a folder of its number."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last update of every key."""
    rows = spark.read.parquet(f"{path}/out")
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def running_level(stream: DataFrame, key: str, time: str, value: str, lam: float = 0.94) -> DataFrame:
    """Exponentially weighted squares per key as keyed state: ``key``, ``n``, ``variance`` after each micro-batch.

    The state is three numbers. Records within a micro-batch are taken in order of time, so a replay of the same batches
    gives the same state.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, level = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values("t", kind="stable")
        for x in rows["x"]:
            if x == x and x is not None:
                level = x * x if n == 0 else lam * level + (1 - lam) * x * x
                n += 1
        state.update((n, float(level)))
        yield pd.DataFrame({"key": [keys[0]], "n": [n], "variance": [float(level)]})

    rows = stream.selectExpr(f"`{key}` as key", f"`{time}` as t", f"cast(`{value}` as double) as x")
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, n long, variance double", "n long, level double", "update", GroupStateTimeout.NoTimeout)


def through(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for s in steps:
        stream = s(stream)
    return stream
