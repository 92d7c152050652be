"""Cross-sectional operators: all entities of one date."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.functions.windows import Along, log
from chronoplane.operators.rolling import rolling_correlations


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], entity: str = "entity", value: str = "x") -> DataFrame:
    """One row per key and column; nulls stay."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias(entity), F.col(c).alias(value)) for c in columns])))


def common(columns: Sequence[str]) -> Column:
    """Mean over the columns of a row, null if any is null."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(whole, reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / len(columns))


def log_vol(along: Along, columns: Sequence[str], k: int = 21) -> dict[str, Column]:
    """Log realised volatility of each column; null where it is not positive."""
    return {c: log(along.realized_vol(F.col(c), k)) for c in columns}


def pairwise_correlation(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], k: int) -> DataFrame:
    """Rolling correlation matrices in long form: keys, order, ``i``, ``j`` (i before j), ``rho``. A window with any null row gives nulls.

    The pairs of a fixed list of columns share their sums, so a row is read once whatever their number.
    """
    pairs = {f"_{n}": p for n, p in enumerate((a, b) for i, a in enumerate(columns) for b in columns[i + 1 :])}
    wide = rolling_correlations(df, keys, order, pairs, k)
    return wide.select(*keys, order, F.inline(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(n).alias("rho")) for n, (a, b) in pairs.items()])))


def matrix_measures(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean off-diagonal correlation and the structural residual share of each matrix; null if a pair is null, zero where the correlations vanish."""
    squares = F.sum(F.col("rho") * F.col("rho"))
    mean = F.avg("rho")
    whole = F.count("rho") == F.count(F.lit(1))
    spread = F.greatest(squares - F.count("rho") * mean * mean, F.lit(0.0))
    share = F.when(squares * 2 < 1e-12, F.lit(0.0)).otherwise(F.sqrt(spread / squares))
    return pairs.groupBy(*keys).agg(F.when(whole, mean).alias("mean_rho"), F.when(whole, share).alias("residual_share"), F.when(whole, F.atanh(mean)).alias("z"))


def shares(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Adds ``share``: value over the sum of its group."""
    return df.withColumn("share", F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*by)), F.lit(0.0)))


def concentration(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Effective number (one over the Herfindahl sum), top share and number of entities of each group."""
    return shares(df, by, value).groupBy(*by).agg((1 / F.sum(F.col("share") * F.col("share"))).alias("eff_n"), F.max("share").alias("top_share"), F.count("share").alias("entities"))


def breadth(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], k: int) -> Column:
    """Share of columns whose compounded price is above its mean of ``k`` rows; a null return masks that column on that row."""
    along = Along(keys, order)
    price = {c: F.when(F.col(c).isNotNull(), F.exp(F.sum(F.log1p(F.when(F.col(c) > -1, F.col(c)))).over(along.ever()))) for c in columns}
    flags = [F.when(price[c].isNotNull(), F.col(f"_p_{c}") > along.mean(F.col(f"_p_{c}"), k)) for c in columns]
    seen = reduce(lambda a, b: a + b, [f.isNotNull().cast("int") for f in flags])
    return reduce(lambda a, b: a + b, [F.coalesce(f.cast("int"), F.lit(0)) for f in flags]) / F.nullif(seen, F.lit(0))


def with_prices(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``_p_`` columns: compounded prices, null where the return is null."""
    along = Along(keys, order)
    return df.withColumns({f"_p_{c}": F.when(F.col(c) > -1, F.exp(F.sum(F.log1p(F.when(F.col(c) > -1, F.col(c)))).over(along.ever()))) for c in columns})


def silhouettes(df: DataFrame, keys: Sequence[str], order: str, features: Sequence[str], label: str) -> DataFrame:
    """Keys, ``n`` and mean ``silhouette`` of the labelled rows; null where a key has one label only, 0 for a row alone in its label.

    Distances are Euclidean and taken in blocks of 256 rows, so a key needs memory for its rows times 256; a key has at
    most one row a day. Features and label have no nulls.
    """
    keys = list(keys)
    rows = df.select(*keys, order, *features, F.col(label).alias("_label"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = group[list(features)].to_numpy(float)
        names, at = np.unique(group["_label"].to_numpy(), return_inverse=True)
        count = np.bincount(at)
        value = np.nan
        if len(names) > 1:
            member = (at[:, None] == np.arange(len(names))).astype(float)
            total = 0.0
            for begin in range(0, len(x), 256):
                part = slice(begin, begin + 256)
                distance = np.sqrt(((x[part, None, :] - x[None]) ** 2).sum(-1)) @ member
                mine = at[part]
                here = np.arange(len(mine))
                own = distance[here, mine] / np.maximum(count[mine] - 1, 1)
                mean = distance / count
                mean[here, mine] = np.inf
                other = mean.min(1)
                most = np.maximum(own, other)
                total += float(np.where((count[mine] > 1) & (most > 0), (other - own) / np.where(most > 0, most, 1), 0.0).sum())
            value = total / len(x)
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), len(x), value]], columns=[*keys, "n", "silhouette"])

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, n long, silhouette double")
