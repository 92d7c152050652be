"""File sources and sinks: logs, vintage folders, digests, archive indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_panel(spark: SparkSession, path: str, schema: str, index: str | None = None) -> DataFrame:
    """CSV with a given schema; NaN becomes null; an unnamed first column gets the name ``index``."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    if index:
        df = df.withColumnRenamed(df.columns[0], index)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON record per line; blank lines are skipped, a bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_log(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Append records as JSON lines, sorted within files; explicit nulls are kept. One writer at a time: check for conflicts first (``bitemporal.split_append``)."""
    df.sortWithinPartitions(*order).write.mode("append").option("ignoreNullFields", "false").json(path)


def read_vintages(spark: SparkSession, pattern: str, schema: str, date: str) -> DataFrame:
    """A folder of vintage files keyed by file name: byte-order marks are dropped, rows without a readable date too."""
    df = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(pattern).withColumn("vintage", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))
    day = F.regexp_replace(F.col(date), "^﻿", "").try_cast("date")
    return df.withColumn(date, day).where(F.col(date).isNotNull())


def vintage_coverage(raw: DataFrame, vintage: str, date: Column) -> DataFrame:
    """Rows, rows without a readable date, first and last date of each vintage."""
    return raw.groupBy(vintage).agg(F.count(F.lit(1)).alias("rows"), F.count_if(date.isNull()).alias("dateless_rows"), F.min(date).alias("first_obs"), F.max(date).alias("last_obs"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of a file, or of all files of a folder and the folders in it: there the name is the path below the folder.

    A file is read whole, so each must be under 2 GB.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = system.makeQualified(base)
    at = base.toString() if system.getFileStatus(base).isDirectory() else base.getParent().toString()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.substring("path", len(at) + 2, 2**31 - 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_changes(old: DataFrame, new: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """Files added, gone or changed between two manifests."""
    a, b = old.select(*key, F.col(digest).alias("_a"), F.lit(1).alias("_o")), new.select(*key, F.col(digest).alias("_b"), F.lit(1).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "gone").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, list(key), "full").withColumn("change", change).where("change is not null").select(*key, "change")


def consecutive_loads(manifest: DataFrame, load: str) -> DataFrame:
    """Each load with its ``prior`` and ``following`` one (null at the ends). The number of loads bounds the window."""
    in_turn = Window.orderBy(load)
    return manifest.where(F.col(load).isNotNull()).select(load).distinct().withColumns({"prior": F.lag(load).over(in_turn), "following": F.lead(load).over(in_turn)})


def manifest_changes_by_load(manifest: DataFrame, load: str, key: Sequence[str], digest: str) -> DataFrame:
    """Files added, gone or changed between every load and the one before it: load, key, ``change``.

    Every row stands once for its own load and once for the following one, so all loads meet in one shuffle by load and
    key. The first load has no changes; a file named twice in a load has the greatest of its digests.
    """
    rows = manifest.where(F.col(load).isNotNull()).groupBy(load, *key).agg(F.max(digest).alias("_d")).join(consecutive_loads(manifest, load), load)
    sides = F.array(
        F.struct(F.when(F.col("prior").isNotNull(), F.col(load)).alias("_at"), F.lit(True).alias("_new")),
        F.struct(F.col("following").alias("_at"), F.lit(False).alias("_new")),
    )
    met = rows.select(*key, "_d", F.inline(sides)).where("_at is not null").groupBy("_at", *key).agg(
        F.max(F.when(F.col("_new"), F.struct("_d"))).alias("_now"), F.max(F.when(~F.col("_new"), F.struct("_d"))).alias("_was")
    )
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "gone").when(~F.col("_now._d").eqNullSafe(F.col("_was._d")), "changed")
    return met.withColumn("change", change).where("change is not null").select(F.col("_at").alias(load), *key, "change")


def archive_index(rows: DataFrame, digest: str, stamp: str, columns: Sequence[str]) -> DataFrame:
    """Of every digest the earliest capture: the moment that content was first seen."""
    return rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min_by(F.struct(stamp, *columns), F.struct(stamp, *columns)).alias("r")).select(digest, "r.*")


def parse_archive_json(text: DataFrame, column: str) -> DataFrame:
    """A JSON array of arrays with a header row, as one map per row."""
    rows = text.select(F.from_json(column, "array<array<string>>").alias("a"))
    return rows.select(F.explode(F.transform(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), lambda r: F.map_from_arrays(F.get("a", F.lit(0)), r))).alias("row"))


def prefer_fresh(first: DataFrame, second: DataFrame, date: str, months: int = 6) -> DataFrame:
    """The first source, unless its last row is more than ``months`` older than the second's."""
    a, b = (d.agg(F.max(date)).first()[0] for d in (first, second))
    if a is None or (b is not None and (b.year - a.year) * 12 + b.month - a.month > months):
        return second
    return first


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, path: str, build: object) -> DataFrame:
    """The Parquet table at the path, built and written first if it isn't there."""
    if not path_exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)
