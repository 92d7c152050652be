"""Column profiles from maintained value-count tables.

The state is one table of counts: part (the load), column, value, count. Every load is a signed delta of its own (+ to add
it, - to take it back, both to correct it), kept in a folder of its own; counts that sum to zero disappear. Everything a
profile needs follows exactly from the counts: nulls, distinct values, ranges, malformed and impossible shares, median,
entropy.

A value is kept as ``kind`` (null, good, malformed, impossible), ``measure`` (the number behind it, if it has one) and,
where the measure doesn't tell the value, a 128-bit digest of its text, so long texts never travel.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplane.session import materialise

NULL, GOOD, MALFORMED, IMPOSSIBLE = 0, 1, 2, 3
_BIN_BITS = 12


@dataclass(frozen=True)
class Profiled:
    """One column: how a non-null value is classed and measured (a non-negative whole number), and whether equal measures are equal values."""

    column: str
    malformed: Column | None = None
    impossible: Column | None = None
    measure: Column | None = None
    checks: frozenset = field(default_factory=frozenset)
    shift_days: int | None = None
    measured_only: bool = False


def load_delta(df: DataFrame, part: str, columns: list[Profiled], sign: int = 1) -> DataFrame:
    """The signed counts of one or more loads: part, ``col`` (number of the column), kind, measure, h1, h2, n.

    Counted in each task before anything is shuffled, so a frequent value or null costs one row a task.
    """
    cells = []
    for i, c in enumerate(columns):
        value = F.col(c.column)
        bad = F.coalesce(c.malformed, F.lit(False)) if c.malformed is not None else F.lit(False)
        odd = F.coalesce(c.impossible, F.lit(False)) if c.impossible is not None else F.lit(False)
        kind = F.when(value.isNull(), NULL).when(bad, MALFORMED).when(odd, IMPOSSIBLE).otherwise(GOOD)
        # a good value that its measure tells needs no digest
        text = F.when(~(F.lit(c.measured_only) & (kind == GOOD)), value.cast("string"))
        cells.append(F.struct(
            F.lit(i).cast("tinyint").alias("col"), kind.cast("tinyint").alias("kind"),
            F.when(kind == GOOD, c.measure.cast("long") if c.measure is not None else F.lit(None).cast("long")).alias("measure"),
            F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("h1"), F.when(text.isNotNull(), F.xxhash64(F.lit(2), text)).alias("h2"),
        ))
    flat = df.select(F.col(part).alias("part"), F.inline(F.array(*cells)))
    return flat.groupBy("part", "col", "kind", "measure", "h1", "h2").agg((F.count(F.lit(1)) * F.lit(sign)).alias("n"))


KEYS = ["part", "col", "kind", "measure", "h1", "h2"]


def merged(deltas: DataFrame) -> DataFrame:
    """The counts that signed deltas add up to; values whose count is zero are in no load."""
    return deltas.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


class CountStore:
    """A lasting count table: signed deltas in a folder per load and tag, merged when read, folded into one delta by ``compact``.

    Writing a load's delta again under the same tag replaces it, so a load that is applied twice, or after a failed try,
    counts once. A store lives as long as its folder and is opened by naming it.
    """

    def __init__(self, spark: SparkSession, path: str, part_type: str = "bigint"):
        self.spark, self.path, self.part_type = spark, path.rstrip("/"), part_type

    def _folders(self, *below: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join([self.path, "counts", *below]))
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []

    def loads(self) -> list[str]:
        """The loads with a delta, as texts; the load without a number is called by the name of Spark's null folder."""
        return [f.partition("=")[2] for f in self._folders() if f.startswith("load=")]

    def apply(self, delta: DataFrame, tag: str = "load") -> None:
        """Keep the delta of each load it holds under the tag. Small loads share a task, a large load is split over several."""
        rows = delta.withColumns({"load": F.col("part"), "tag": F.lit(tag)}).hint("rebalance", "load")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", "tag").parquet(f"{self.path}/counts")

    def refresh(self, df: DataFrame, part: str, columns: list[Profiled]) -> None:
        """Apply the loads of the table that the store hasn't seen, each as a delta of its own; the others aren't counted again."""
        known = self.loads()
        new = df.where(~F.coalesce(F.col(part).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).isin(known)) if known else df
        self.apply(load_delta(new, part, columns))

    def withdraw(self, loads: list, tag: str = "withdrawn") -> None:
        """Take loads back: a delta with the opposite of all that the store holds of them."""
        held = self.state().where(F.col("part").isin(loads)).withColumn("n", -F.col("n"))
        self.apply(materialise(held, "withdrawn"), tag)

    def state(self) -> DataFrame:
        """Current counts: all deltas, merged."""
        schema = f"part {self.part_type}, col tinyint, kind tinyint, measure bigint, h1 bigint, h2 bigint, n bigint"
        if not self.loads():
            return self.spark.createDataFrame([], schema)
        return merged(self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/counts"))

    def compact(self, tag: str) -> None:
        """Fold all deltas into one per load in a new folder and use that from now on."""
        fresh = CountStore(self.spark, f"{self.path}-{tag}", self.part_type)
        fresh.apply(self.state(), tag)
        self.path = fresh.path


def profile(state: DataFrame) -> DataFrame:
    """Per part and column: rows, nulls, malformed, impossible, distinct, lowest, highest, entropy (nats) and exact median of the good measures."""
    here = F.col("n")
    live = F.col("kind") != NULL
    metrics = state.groupBy("part", "col").agg(
        F.sum(here).alias("rows"),
        F.sum(F.when(~live, here).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("kind") == MALFORMED, here).otherwise(0)).alias("malformed"),
        F.sum(F.when(F.col("kind") == IMPOSSIBLE, here).otherwise(0)).alias("impossible"),
        F.count(F.when(live, 1)).alias("distinct"),
        F.min("measure").alias("lowest"),
        F.max("measure").alias("highest"),
        F.sum(F.when(live, here * F.ln(here.cast("double")))).alias("n_ln_n"),
    )
    filled = F.col("rows") - F.col("nulls")
    entropy = F.when(filled > 0, F.ln(filled.cast("double")) - F.col("n_ln_n") / filled)
    return metrics.withColumn("entropy", entropy).drop("n_ln_n").join(median_of_counts(state), ["part", "col"], "left")


def _bin(measure: Column) -> Column:
    """Order-preserving bins of a non-negative whole number: exact below 2**13, then of a relative width of 2**-12."""
    shift = F.greatest(F.length(F.bin(measure)) - F.lit(_BIN_BITS + 1), F.lit(0))
    return shift.cast("long") * F.lit(1 << (_BIN_BITS + 1)) + F.call_function("shiftright", measure, shift)


def median_of_counts(state: DataFrame) -> DataFrame:
    """Exact median of the measures of each part and column, from counts, without gathering a part's values in one task.

    First the counts per bin (at most some 200,000 bins whatever the data) tell in which bins the middle ranks lie; then
    only the values of those bins are put in order.
    """
    keys = ["part", "col"]
    values = state.where("measure is not null").groupBy(*keys, "measure").agg(F.sum("n").alias("n")).withColumn("bin", _bin(F.col("measure")))
    bins = values.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    middle = bins.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).select(*keys, "bin", (F.col("upto") - F.col("n")).alias("before"), low.alias("low"), high.alias("high"))
    near = values.join(middle, [*keys, "bin"])
    inside = Window.partitionBy(*keys, "bin").orderBy("measure").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("before") + F.sum("n").over(inside))
    holds = lambda rank: (F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("n") < F.col(rank))
    return near.groupBy(*keys).agg(
        ((F.max(F.when(holds("low"), F.col("measure"))) + F.max(F.when(holds("high"), F.col("measure")))) / F.lit(2.0)).alias("median")
    )


def out_of_order(
    profiles: DataFrame, columns: list[Profiled], nulls_above: float = 0.10, share_above: float = 0.05, distinct_below: float = 0.5, factor: float = 1.5
) -> DataFrame:
    """part, column and issue of the profiles that are out of order; "typical" is the median over all parts.

    The window per column holds one row per part (a load), never rows of the loads.
    """
    number = F.col("col")
    pick = lambda f: F.element_at(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(i).cast("tinyint"), f(c))]), number)
    filled = F.col("rows") - F.col("nulls")
    p = profiles.withColumns({
        "null_share": F.col("nulls") / F.col("rows"),
        "malformed_share": F.when(filled > 0, F.col("malformed") / filled),
        "impossible_share": F.when(filled > 0, F.col("impossible") / filled),
        "distinct_share": F.when(filled > 0, F.col("distinct") / filled),
    })
    over = Window.partitionBy("col")
    typical = lambda c: F.percentile(c, F.lit(0.5)).over(over)
    p = p.withColumns({f"typical_{c}": typical(c) for c in ("null_share", "distinct_share", "median")})
    checks = pick(lambda c: F.array(*[F.lit(x) for x in sorted(c.checks)]).cast("array<string>"))
    days = pick(lambda c: F.lit(c.shift_days).cast("int"))
    has = lambda name: F.array_contains(checks, name)
    shifted = F.when(days.isNotNull(), F.abs(F.col("median") - F.col("typical_median")) > days).otherwise(
        (F.col("median") > F.col("typical_median") * factor) | (F.col("median") < F.col("typical_median") / factor)
    )
    tests = {
        "nulls": F.col("null_share") > F.col("typical_null_share") + nulls_above,
        "pattern": F.col("malformed_share") > share_above,
        "range": F.col("impossible_share") > share_above,
        "distinct": F.col("distinct_share") < F.col("typical_distinct_share") * distinct_below,
        "shift": shifted,
    }
    issues = F.filter(F.array(*[F.when(has(k) & t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return p.select("part", pick(lambda c: F.lit(c.column)).alias("column_name"), F.explode(issues).alias("issue"))
