"""Scans of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of files); columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
