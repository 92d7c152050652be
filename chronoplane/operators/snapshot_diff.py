"""What changed between consecutive full snapshots, found by comparing Merkle trees of hash ranges.

1. Every row gets the leaf (hash range) of its key and a 128-bit digest of its canonical values.
2. Leaf digests (count, two xors) are built per entity, snapshot and delivery; xor makes them independent of row order.
   Trees are rolled up from the leaves: leaf, inner node (its share of the leaves), root.
3. The entity's consecutive snapshots are paired on their roots, then compared top-down: roots, the inner nodes under
   differing roots, the leaves under differing nodes.
4. Only rows in leaves that differ are compared with one another.

The rows are shuffled once, by entity and leaf: a hot entity is spread over its leaves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 2
#: Rows a leaf may hold if one entity had all rows; sets the fan-out of the trees from a count of the input.
LEAF_ROWS = 8_192


def canonical_digest(text: Column) -> Column:
    """Letter case and outer blanks of a digest make no difference; empty text is null. Half the bytes where it is hexadecimal."""
    text = F.nullif(F.lower(F.trim(text)), F.lit(""))
    return F.when(text.rlike(r"^([0-9a-f]{2})+\z"), F.unhex(text)).otherwise(F.encode(text, "UTF-8"))


def canonical_day(text: Column) -> Column:
    """A day written YYYY-MM-DD, YYYYMMDD or as the start of an instant is the same day; empty text is null; any other text stands for itself."""
    text = F.nullif(F.trim(text), F.lit(""))
    digits = F.regexp_extract(text, r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ]00:00(?::00(?:\.0+)?)?(?:Z|[+-]00:?00)?)?$", 0)
    plain = F.regexp_replace(F.substring(text, 1, 10), "-", "")
    return F.when(digits != "", F.substring(plain, 1, 8)).otherwise(text)


def _differ(pairs: DataFrame, digests: DataFrame, on: Sequence[str], node: str) -> DataFrame:
    """Nodes of one level, under the given pairs, whose digests differ between ``prior`` and ``snap``."""
    on = list(on)
    sides = pairs.select(*[c for c in pairs.columns], F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col("snap").alias("s"), F.col("delivery").alias("d")),
        F.struct(F.lit(-1).alias("side"), F.col("prior").alias("s"), F.col("prior_delivery").alias("d")),
    )).alias("x")).select(*pairs.columns, "x.side", "x.s", "x.d")
    level = digests.withColumnsRenamed({"snapshot": "s", "delivered": "d"})
    met = sides.join(level, [*on, "s", "d"])
    return met.groupBy(*pairs.columns, node).agg(
        F.sum(F.col("side") * F.col("n")).alias("n"),
        F.bit_xor("x1").alias("x1"),
        F.bit_xor("x2").alias("x2"),
    ).where("n <> 0 or x1 <> 0 or x2 <> 0").drop("n", "x1", "x2")


def _never_null(df: DataFrame, delivered: str) -> Column:
    """No delivery instant counts as the earliest. Without nulls no branch of the plan gets a filter of its own, so all share one shuffle of the rows."""
    kind = df.schema[delivered].dataType
    return F.coalesce(F.col(delivered), F.lit("0001-01-01").cast(kind)) if kind.typeName() in ("timestamp", "timestamp_ntz", "date", "string") else F.coalesce(F.col(delivered), F.lit(-(2**31)).cast(kind))


def snapshot_changes(
    df: DataFrame, entity: str, snapshot: str, delivered: str, key: str, values: dict[str, Column], fanout_bits: int | None = None
) -> DataFrame:
    """One row per key that was added, removed or changed between an entity's snapshot and its previous one.

    ``values`` maps each compared value to its canonical column. Output: entity, snapshot, key, ``change``.

    Defined cases: of a snapshot delivered more than once, the entity's latest delivery counts; a first snapshot has no
    changes; repeated rows count once; two rows with the same key in one delivery but other values stand as the greater
    of the two (by value order); rows without entity or snapshot belong to no series and are left out; a null key is a
    key of its own; an empty table gives no rows. Further columns of the input are ignored, whatever their names.
    """
    if fanout_bits is None:  # a count of Parquet rows reads footers only
        fanout_bits = min(15, max(4, math.ceil(math.log2(max(1, df.count() / LEAF_ROWS)) / LEVELS)))  # leaf numbers are ints: up to 2**30 leaves of an entity
    names = list(values)
    rows = df.select(
        F.col(entity).alias("entity"), F.col(snapshot).alias("snapshot"), _never_null(df, delivered).alias("delivered"), F.col(key).alias("key"),
        *[v.alias(f"v{i}") for i, v in enumerate(values.values())],
    ).where("entity is not null and snapshot is not null")
    cells = [f"v{i}" for i in range(len(names))]
    spread = F.xxhash64("entity", F.coalesce(F.col("key").cast("string"), F.lit("\0")))
    rows = rows.withColumn("leaf", F.shiftright(spread, 64 - LEVELS * fanout_bits).cast("int")).repartition("entity", "leaf")
    # repeated rows fold here; partitioned by (entity, leaf) already, so this and the leaf digests need no further shuffle
    rows = rows.groupBy("entity", "leaf", "snapshot", "delivered", "key").agg(F.max(F.struct(*cells)).alias("v")).select(
        "entity", "leaf", "snapshot", "delivered", "key", *[F.col(f"v.{c}").alias(c) for c in cells]
    )
    marked = [x for c in ["key", *cells] for x in (F.col(c).isNull(), F.col(c))]
    leaves = rows.groupBy("entity", "leaf", "snapshot", "delivered").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.lit(1), *marked)).alias("x1"), F.bit_xor(F.xxhash64(F.lit(2), *marked)).alias("x2")
    )

    def roll(lower: DataFrame, by: Sequence[str]) -> DataFrame:
        return lower.groupBy("entity", *by, "snapshot", "delivered").agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))

    nodes = roll(leaves.withColumn("node", F.shiftright("leaf", fanout_bits)), ["node"])
    roots = roll(nodes, [])
    # per entity at most one row per delivery: the number of snapshots bounds these windows
    deliveries = Window.partitionBy("entity", "snapshot")
    in_turn = Window.partitionBy("entity").orderBy("snapshot")
    latest = roots.withColumn("last", F.max("delivered").over(deliveries)).where("delivered = last").drop("last")
    pairs = latest.select(
        "entity", F.col("snapshot").alias("snap"), F.col("delivered").alias("delivery"),
        F.lag("snapshot").over(in_turn).alias("prior"), F.lag("delivered").over(in_turn).alias("prior_delivery"),
        *[F.lag(c).over(in_turn).alias(f"p_{c}") for c in ("n", "x1", "x2")], "n", "x1", "x2",
    ).where("prior is not null and (n <> p_n or x1 <> p_x1 or x2 <> p_x2)").select("entity", "snap", "delivery", "prior", "prior_delivery")

    open_nodes = _differ(pairs, nodes, ["entity"], "node")
    open_leaves = _differ(open_nodes, leaves.withColumn("node", F.shiftright("leaf", fanout_bits)), ["entity", "node"], "leaf").drop("node")

    # what to compare in a leaf: two entries per open pair, so at most twice the entity's snapshots; joined by the rows' own
    # partitioning, the rows don't move again
    sides = open_leaves.groupBy("entity", "leaf").agg(F.flatten(F.collect_list(F.array(
        F.struct(F.col("snap"), F.lit(True).alias("new"), F.col("snap").alias("s"), F.col("delivery").alias("d")),
        F.struct(F.col("snap"), F.lit(False).alias("new"), F.col("prior").alias("s"), F.col("prior_delivery").alias("d")),
    ))).alias("sides"))
    mine = F.filter("sides", lambda x: (x["s"] == F.col("snapshot")) & (x["d"] == F.col("delivered")))
    met = rows.join(sides, ["entity", "leaf"]).select("entity", "leaf", "key", *cells, F.inline(mine))
    found = met.groupBy("entity", "leaf", "snap", "key").agg(
        F.max(F.when(F.col("new"), F.struct(F.lit(1).alias("is"), *cells))).alias("now"),
        F.max(F.when(~F.col("new"), F.struct(F.lit(1).alias("is"), *cells))).alias("was"),
    )
    same = reduce(lambda a, b: a & b, [F.col(f"now.{c}").eqNullSafe(F.col(f"was.{c}")) for c in cells])
    change = F.when(F.col("was").isNull(), F.lit("added")).when(F.col("now").isNull(), F.lit("removed")).when(~same, F.lit("changed"))
    return found.withColumn("change", change).where("change is not null").select(
        F.col("entity").alias(entity), F.col("snap").alias(snapshot), F.col("key").alias(key), "change"
    )
