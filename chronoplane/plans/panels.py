"""The panels that queries run on, as DataFrames and as SQL common table expressions of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.functions.instants import nan_to_null
from chronoplane.tables import table

INDUSTRIES = ["ind_nodur", "ind_durbl", "ind_manuf", "ind_enrgy", "ind_hitec", "ind_telcm", "ind_shops", "ind_hlth", "ind_utils", "ind_other"]
ASSETS = ["mkt_ret", "rf", *INDUSTRIES, "smb", "hml", "mom", "bond10_ret", "gold_ret"]


def daily(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``source_id``, ``date`` and the columns of ``assets_daily``: one row per feed and day, copies folded, NaN as null."""
    rows = table(spark, folder, "assets_daily").where("source_id is not null and date is not null")
    return rows.groupBy("source_id", "date").agg(*[F.max(nan_to_null(F.col(c))).alias(c) for c in columns])


def daily_sql(*columns: str) -> str:
    cells = ", ".join(f"max({c}) FILTER (NOT isnan({c})) AS {c}" for c in columns)
    return f"p AS (SELECT source_id, date, {cells} FROM assets_daily GROUP BY source_id, date)"


def bonds(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``source_id``, ``month`` (its end) and the columns of ``intl_bonds_monthly``: the month's last reading of each."""
    rows = table(spark, folder, "intl_bonds_monthly").where("source_id is not null and date is not null")
    last = lambda c: F.max(F.when(nan_to_null(F.col(c)).isNotNull(), F.struct("date", F.col(c).alias("v"))))["v"]
    return rows.groupBy("source_id", F.last_day("date").alias("month")).agg(*[last(c).alias(c) for c in columns])


def bonds_sql(*columns: str) -> str:
    cells = ", ".join(f"max(struct_pack(d := date, v := {c})) FILTER ({c} IS NOT NULL AND NOT isnan({c})) AS x_{c}" for c in columns)
    outer = ", ".join(f"x_{c}.v AS {c}" for c in columns)
    return f"b AS (SELECT source_id, month, {outer} FROM (SELECT source_id, last_day(date) AS month, {cells} FROM intl_bonds_monthly GROUP BY source_id, last_day(date)))"


def market_months(spark: SparkSession, folder: str) -> DataFrame:
    """Total order value and number of orders by month end: the long monthly series of the trade tables."""
    rows = table(spark, folder, "orders")
    return rows.groupBy(F.last_day(F.to_date("o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))


def nation_months(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by nation and month: the entity cross-section."""
    orders, customers, nations = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.last_day(F.to_date("o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("revenue"))


NATION_MONTHS_SQL = """nm AS (SELECT n_name, last_day(o_orderdate::DATE) AS month, sum(o_totalprice) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
