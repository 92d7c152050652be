"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.functions import windows
from chronoplane.operators import sequential
from chronoplane.plans import aggregate_queries, bitemporal_queries, function_queries, panels, pipeline, pipeline_sql, registry, relational_queries, sequential_queries, signal_queries, stream_queries, window_queries  # noqa: F401  (the modules register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return pipeline.QUERIES | registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return pipeline_sql.SQL | registry.SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Latest causal descriptors per feed: volatility, its expanding z and percentile, and the day they are about."""
    a = windows.Along("source_id", "date")
    rows = panels.daily(spark, folder, "mkt_ret").where("mkt_ret > -1 and mkt_ret < 1").withColumn("vol", a.realized_vol(F.col("mkt_ret")))
    ranked = sequential.along_series(rows.where("vol is not null"), ["source_id"], "date", ["vol"], lambda g: {"vol_pctile": sequential.expanding_rank(g["vol"].to_numpy(float))}, "vol_pctile double")
    out = rows.withColumn("vol_z", a.expanding_z(F.col("vol"), 63)).join(ranked, ["source_id", "date"])
    return out.groupBy("source_id").agg(F.max("date").alias("as_of"), *[F.max_by(c, "date").alias(c) for c in ("vol", "vol_z", "vol_pctile")])
