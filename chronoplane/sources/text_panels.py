"""Vendor text files as panels: preambles, stacked blocks, sentinels. Files are small; each is one row of a ``wholetext`` scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How these vendors write "missing" (fixed values).
SENTINELS = (-99.99, -999.0)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``n`` (place in the file), ``line``: line numbers survive splits because each file is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("n", "line"))


def number(text: Column, percent: bool = False) -> Column:
    x = F.trim(text).try_cast("double")
    x = F.when(~x.isin(*SENTINELS), x)
    return x / 100 if percent else x


def daily_table(lines: DataFrame, columns: Sequence[str], percent: bool = True) -> DataFrame:
    """Rows whose first cell is eight digits, as ``file``, ``date`` and numbers; repeated dates keep the first (the first block of the file)."""
    cells = F.split(F.col("line"), ",")
    rows = lines.where(F.col("line").rlike(r"^\s*\d{8}\s*,")).select("file", "n", F.to_date(F.trim(cells[0]), "yyyyMMdd").alias("date"), *[number(F.get(cells, F.lit(i + 1)), percent).alias(c) for i, c in enumerate(columns)])
    return rows.groupBy("file", "date").agg(F.min_by(F.struct(*columns), "n").alias("r")).select("file", "date", "r.*")


def header(lines: DataFrame) -> DataFrame:
    """``file`` and ``names``: the first line that begins with an empty cell followed by names."""
    head = lines.where(F.col("line").rlike(r"^\s*,\s*\S")).groupBy("file").agg(F.min_by("line", "n").alias("line"))
    return head.select("file", F.transform(F.slice(F.split("line", ","), 2, 999), lambda x: F.trim(x)).alias("names"))


def titled_block(lines: DataFrame, title: str, columns: Sequence[str]) -> DataFrame:
    """The monthly rows (six digits first) of the one block with that title: ``file``, ``month``, numbers. A file without exactly one such title raises.

    The block ends at the first line after its rows that is not a month.
    """
    at = lines.groupBy("file").agg(F.count_if(F.trim("line") == title).alias("_k"), F.min(F.when(F.trim("line") == title, F.col("n"))).alias("_start"))
    checked = at.withColumn("_start", F.when(F.col("_k") == 1, F.col("_start")).otherwise(F.raise_error(F.concat(F.lit(f"expected one block '{title}', found "), F.col("_k").cast("string"))).cast("int")))
    month = F.col("line").rlike(r"^\s*\d{6}\s*,")
    body = lines.join(checked.select("file", "_start"), "file").where("n > _start").withColumn("_m", month)
    seen = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("_in", F.max(F.col("_m").cast("int")).over(seen)).withColumn("_over", F.max(((F.col("_in") == 1) & ~F.col("_m")).cast("int")).over(seen))
    cells = F.split("line", ",")
    return body.where("_m and _over = 0").select("file", F.last_day(F.to_date(F.trim(cells[0]), "yyyyMM")).alias("month"), *[number(F.get(cells, F.lit(i + 1))).alias(c) for i, c in enumerate(columns)])


def stacked_blocks(lines: DataFrame, headline: str = "Returns|Ratios") -> DataFrame:
    """Blank-separated blocks of rows led by a year or month: ``file``, ``header``, ``block`` (its number), ``key``, ``cells`` (numbers)."""
    row = F.col("line").rlike(r"^\s*\d{4}(\d{2})?(\s|$)")
    order = Window.partitionBy("file").orderBy("n")
    marked = lines.withColumns({"_row": row, "_head": F.when(~row & F.col("line").rlike(headline), F.trim("line"))})
    marked = marked.withColumn("header", F.last("_head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = F.col("_row") & ~F.coalesce(F.lag("_row").over(order), F.lit(False))
    marked = marked.withColumn("block", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.split(F.trim("line"), r"\s+")
    return marked.where("_row").select("file", "header", "block", parts[0].alias("key"), F.transform(F.slice(parts, 2, 999), lambda x: number(x)).alias("cells"))


def pick_block(blocks: DataFrame, kind: str, monthly: bool, required: bool) -> DataFrame:
    """The first block of that kind and frequency whose header is, or is not, marked as not required."""
    fits = F.col("header").contains(kind) & ((F.length("key") == 6) == F.lit(monthly)) & (~F.col("header").contains("Not Req") == F.lit(required))
    rows = blocks.where(fits)
    return rows.withColumn("_first", F.min("block").over(Window.partitionBy("file"))).where("block = _first").drop("_first")


def year_month_decimal(x: Column) -> Column:
    """Month end of a date written as a number YYYY.MM (October as YYYY.1)."""
    year = F.floor(x)
    return F.last_day(F.make_date(year.cast("int"), F.round((x - year) * 100).cast("int"), F.lit(1)))
