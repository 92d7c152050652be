"""Late windows as a stream of micro-batches with keyed state, upserts and an advancing watermark.

Every batch merges its arrivals into the live state (the winners per entity, window and event time), writes the updated
aggregates of the windows it touched and the records that came too late, and lets go of the windows that no later arrival
can change. A window's aggregates are those of the last batch that touched it.

All is kept in folders by batch number: a batch that runs again reads what the batch before left and writes over what its
earlier try left. ``compact`` folds the updates of many batches into one table of the latest and removes spent folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.operators.late_windows import MonthWindows, arrival_bounds, lateness, merge_state, upsert_state, window_aggregates
from chronoplane.session import materialise

COMPACT_EVERY = 4


class LateUpsert:
    """State, updates and late reports of a stream of arrivals under one folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, entity: Sequence[str], windows: MonthWindows, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.entity, self.windows, self.compact_every = spark, path.rstrip("/"), list(entity), windows, compact_every

    def _at(self, *below: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, *below: str) -> list[int]:
        fs, at = self._at(*below)
        return sorted(int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []

    def _drop(self, *below: str) -> None:
        fs, at = self._at(*below)
        fs.delete(at, True)

    def _before(self, number: int) -> tuple[str | None, int | None]:
        """Folder of the live state that the batch before left, and the watermark it left it with."""
        for n in reversed([n for n in self._numbers("state") if n < number]):
            for mark in self._numbers("state", f"batch={n}"):
                return f"{self.path}/state/batch={n}/watermark={mark}", mark
        return None, None

    def batch(self, arrivals: DataFrame, number: int, watermark: int | None = None) -> None:
        """Take in one micro-batch. ``watermark`` (epoch microseconds): no later batch holds an arrival before it; without one, nothing is let go.

        An arrival after its window's cut-off, or for a window that was let go, is reported as late and changes nothing.
        """
        held, mark = self._before(number)
        watermark = max(watermark if watermark is not None else 0, mark or 0)
        live = self.windows.cutoff(F.col("window")) >= F.lit(mark or 0)
        on_time = live & (F.col("arrived") <= self.windows.cutoff(F.col("window")))
        state = merge_state(arrivals.where(on_time), self.entity, self.windows).withColumn("touched", F.lit(True))
        if held:
            kept = self.spark.read.schema(state.schema).parquet(held).where(live).withColumn("touched", F.lit(False))
            state = upsert_state(kept, state, self.entity)
        folder = f"{self.path}/state/batch={number}/watermark={watermark}"
        state.write.mode("overwrite").parquet(folder)
        written = self.spark.read.schema(state.schema).parquet(folder)
        window_aggregates(written, self.entity, "touched").write.mode("overwrite").parquet(f"{self.path}/updates/batch={number}")
        late = lateness(arrivals.where(~on_time), self.windows)
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        if self.compact_every and number % self.compact_every == self.compact_every - 1:
            self.compact(number)

    def aggregates(self) -> DataFrame:
        """The latest aggregates of every window; a window of which only late records came has none of its own and is empty."""
        latest = self._latest(None)
        empty = {"count_closed": 0, "sum_closed": 0, "count_final": 0, "sum_final": 0, "corrected": False}
        unseen = self.late().select(*self.entity, "window").distinct().join(latest, [*self.entity, "window"], "left_anti")
        return latest.unionByName(unseen.withColumns({c: F.lit(v).cast(latest.schema[c].dataType) for c, v in empty.items()}))

    def _latest(self, upto: int | None) -> DataFrame:
        """The last update of every window, of all batches or of those up to a number."""
        folded = self._numbers("folded")
        parts = [self.spark.read.parquet(f"{self.path}/folded/upto={folded[-1]}").withColumn("batch", F.lit(folded[-1]))] if folded else []
        fresh = [n for n in self._numbers("updates") if (not folded or n > folded[-1]) and (upto is None or n <= upto)]
        if fresh:
            parts.append(self.spark.read.option("basePath", f"{self.path}/updates").parquet(*[f"{self.path}/updates/batch={n}" for n in fresh]))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rest = [c for c in rows.columns if c not in [*self.entity, "window", "batch"]]
        return rows.groupBy(*self.entity, "window").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*self.entity, "window", "r.*")

    def state(self) -> DataFrame:
        """The live state after the last batch."""
        held, mark = self._before(2**62)
        return self.spark.read.parquet(held).where(self.windows.cutoff(F.col("window")) >= F.lit(mark or 0)).drop("touched")

    def late(self) -> DataFrame:
        """The records that came too late, each once."""
        return self.spark.read.parquet(f"{self.path}/late").drop("batch").distinct()

    def compact(self, number: int) -> None:
        """Fold the updates up to batch ``number`` into one table; spent updates and the state of earlier batches go."""
        self._latest(number).write.mode("overwrite").parquet(f"{self.path}/folded/upto={number}")
        for n in [n for n in self._numbers("folded") if n < number]:
            self._drop("folded", f"upto={n}")
        for n in [n for n in self._numbers("updates") if n <= number]:
            self._drop("updates", f"batch={n}")
        # the batch before the last one stays, should the last one run again
        for n in [n for n in self._numbers("state") if n < number][:-1]:
            self._drop("state", f"batch={n}")

    def replay(self, arrivals: DataFrame, batches: int) -> None:
        """Take in stored arrivals in the order of their instants, as about equal micro-batches.

        Any bounds give the same aggregates, so approximate quantiles do.
        """
        bounds = arrival_bounds(arrivals, batches)
        turn = sum((F.col("arrived") >= b).cast("int") for b in bounds) if bounds else F.lit(0)
        landed = materialise(arrivals.withColumn("turn_in", turn), "arrivals", ["turn_in"])
        for n in range(len(bounds) + 1):
            self.batch(landed.where(F.col("turn_in") == n).drop("turn_in"), n, bounds[min(n, len(bounds) - 1)] if bounds else None)

    def run(self, stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], watermark: Callable[[DataFrame], int | None] = lambda df: None, timeout: int | None = None) -> None:
        """Work off what the stream's source holds now; ``watermark`` tells that of a micro-batch."""
        query = (
            stream.writeStream.foreachBatch(lambda df, n: self.batch(prepare(df), n, watermark(df))).option("checkpointLocation", f"{self.path}/offsets").trigger(availableNow=True).start()
        )
        query.awaitTermination(timeout) if timeout else query.awaitTermination()
