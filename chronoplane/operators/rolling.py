"""Rolling sums, correlations and deviations whose cost doesn't grow with the window.

A sliding frame is summed anew for every row. Here the series is cut into blocks as long as the window: a window is the
end of one block and the beginning of the next, so its sum is a running sum from the block's end, ``k - 1`` rows back,
plus a running sum from the block's beginning. Sums are only added, never subtracted, so a huge value leaves no trace in
windows that don't hold it. All three passes are partitioned by the series: the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_sums(df: DataFrame, keys: Sequence[str], order: str, terms: dict[str, Column], k: int) -> DataFrame:
    """Adds the sum of each term over the last ``k`` rows under the term's name; null before the ``k``-th row. Null terms count as zero: count them by a term of their own."""
    keys = list(keys)
    along = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_r", F.row_number().over(along) - 1).withColumn("_blk", F.floor(F.col("_r") / k).cast("int"))
    rows = rows.withColumns({f"_t_{n}": F.coalesce(t, F.lit(0.0)) for n, t in terms.items()})
    begin = Window.partitionBy(*keys, "_blk").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    end = Window.partitionBy(*keys, "_blk").orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_e_{n}": F.sum(f"_t_{n}").over(end) for n in terms})
    rows = rows.withColumns({f"_b_{n}": F.sum(f"_t_{n}").over(begin) for n in terms})
    whole = F.col("_r") % k == k - 1
    sums = {n: F.when(whole, F.col(f"_b_{n}")).otherwise(F.col(f"_b_{n}") + F.lag(f"_e_{n}", k - 1).over(along)) for n in terms}
    return rows.withColumns(sums).drop("_r", "_blk", *[f"_{p}_{n}" for p in "teb" for n in terms])


def rolling_correlations(df: DataFrame, keys: Sequence[str], order: str, pairs: dict[str, tuple[str, str]], k: int) -> DataFrame:
    """Adds the correlation of each pair of columns over the last ``k`` rows under the pair's name.

    Null unless all ``k`` rows hold every column of the pairs, and where a column has no spread in the window. Columns
    are taken about the series' first value, which keeps the moments scaled and never depends on later rows: a value is
    the same to the last bit whatever follows it.
    """
    keys = list(keys)
    columns = sorted({c for p in pairs.values() for c in p})
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mid = {c: F.when(whole, F.col(c) - F.first(c, ignorenulls=True).over(so_far)) for c in columns}
    rows = df.withColumns({f"_m_{c}": v for c, v in mid.items()})
    m = lambda c: F.col(f"_m_{c}")
    terms = {"_n": whole.cast("double")} | {f"_s_{c}": m(c) for c in columns} | {f"_q_{c}": m(c) * m(c) for c in columns} | {f"_x_{p}": m(a) * m(b) for p, (a, b) in pairs.items()}
    rows = rolling_sums(rows, keys, order, terms, k)
    spread = lambda c: F.col(f"_q_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}") / k
    flat = lambda c: spread(c) <= 1e-13 * F.col(f"_q_{c}")
    out = {p: F.when((F.col("_n") == k) & ~flat(a) & ~flat(b), (F.col(f"_x_{p}") - F.col(f"_s_{a}") * F.col(f"_s_{b}") / k) / F.sqrt(spread(a) * spread(b))) for p, (a, b) in pairs.items()}
    return rows.withColumns(out).drop(*terms, *[f"_m_{c}" for c in columns])
