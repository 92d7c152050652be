"""Filling containers of fixed capacity with items of varying size.

Items are spread over shards of bounded size by a hash. Within a shard: first-fit decreasing, then a swap-based local
search between underfull bins. A move of one item, a swap of one for one or of two for one is taken if it increases the
sum of squared fills, which empties the emptiest bins bit by bit. Items longer than a bin are cut into full bins and a
rest; only they are split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2_048
SHARD_ITEMS = 20_000
#: Bound of the passes over all givers; the search ends by itself long before it on the sizes of the tests.
ROUNDS = 1_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; a tree over the free room finds the first bin an item fits into."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [capacity] * (2 * width)
    bins: list[list[int]] = []
    for i in order:
        at = 1
        while at < width:
            at = 2 * at if room[2 * at] >= sizes[i] else 2 * at + 1
        number = at - width
        if number == len(bins):
            bins.append([])
        bins[number].append(i)
        room[at] -= sizes[i]
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int, rounds: int = ROUNDS) -> list[list[int]]:
    """Empties underfull bins by moves, one-for-one and two-for-one swaps that increase the sum of squared fills.

    The emptiest bins give, fuller ones take, whichever of all bins with room gains most. Every exchange takes effect at
    once. The search ends when no exchange of the three kinds helps, when as few bins are left as the sizes need, or after
    ``rounds`` passes over all givers. A full bin neither gives nor takes, so only items of underfull bins are looked at.
    """
    fill = np.array([sum(sizes[i] for i in b) for b in bins], dtype=np.int64)
    least = -(-int(fill.sum()) // capacity)
    members = [list(b) for b in bins]
    loose = np.array([i for b, m in enumerate(members) if fill[b] < capacity for i in m], dtype=np.int64)
    place = {int(i): k for k, i in enumerate(loose)}
    size = np.array([sizes[i] for i in loose], dtype=np.int64)
    home = np.array([b for b, m in enumerate(members) if fill[b] < capacity for _ in m], dtype=np.int64)

    def shift(item: int, to: int) -> None:
        k = place[item]
        members[home[k]].remove(item)
        members[to].append(item)
        fill[home[k]] -= size[k]
        fill[to] += size[k]
        home[k] = to

    def best(amount: int, giver: int) -> int | None:
        """The item for which a bin would best take so much from the giver: its bin has the room and ends fuller than the giver is."""
        grow = amount - size
        there = fill[home]
        fits = (grow > 0) & (there + grow <= capacity) & (there + grow > fill[giver]) & (home != giver)
        if not fits.any():
            return None
        return int(loose[np.argmax(np.where(fits, grow * (there - fill[giver] + grow), 0))])

    def give(giver: int) -> bool:
        """One exchange that helps, if there is one."""
        mine = sorted(members[giver], key=lambda i: (-sizes[i], i))
        room = np.where(fill > 0, capacity - fill, -1)
        room[giver] = -1
        for i in mine:
            takers = np.flatnonzero((room >= sizes[i]) & (fill + sizes[i] > fill[giver]))
            if len(takers):
                shift(i, int(takers[np.argmin(room[takers])]))
                return True
        for k, i in enumerate(mine):
            if (k == 0 or sizes[i] != sizes[mine[k - 1]]) and (j := best(sizes[i], giver)) is not None:
                to = int(home[place[j]])
                shift(i, to)
                shift(j, giver)
                return True
        tried = set()
        for x, i in enumerate(mine):
            for other in mine[x + 1 :]:
                both = sizes[i] + sizes[other]
                if both not in tried and (j := best(both, giver)) is not None:
                    to = int(home[place[j]])
                    shift(i, to)
                    shift(other, to)
                    shift(j, giver)
                    return True
                tried.add(both)
        return False

    for _ in range(rounds):
        changed = False
        for giver in sorted(np.flatnonzero((fill > 0) & (fill < capacity)).tolist(), key=lambda b: (fill[b], b)):
            while 0 < fill[giver] < capacity and np.count_nonzero(fill) > least and give(giver):
                changed = True
        if not changed:
            break
    return [b for b in members if b]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers, no item above capacity."""
    return local_search(first_fit_decreasing(sizes, capacity), sizes, capacity)


def pack_items(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Key, ``part`` (0, or its number where an item was cut), ``container``, ``tokens`` of the part in that container.

    Every row is an item, also where keys or whole rows repeat: rows that can't be told apart are counted, and each copy is
    packed. Items of null, zero or negative size take no room and are in no container; a null key is a key. The number of
    shards follows from a count of the items, so a shard's group stays near ``shard_items`` whatever the data.
    """
    kind = items.schema[key].dataType.simpleString()
    whole = items.selectExpr(f"`{key}` as key", f"cast(`{size}` as long) as size").where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("copies"))
    n = whole.agg(F.sum(F.ceil(F.col("size") / capacity) * F.col("copies"))).first()[0] or 0
    shards = max(1, -(-int(n) // shard_items))
    whole = whole.select("key", "size", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    pieces = whole.withColumn("cuts", F.ceil(F.col("size") / capacity).cast("int")).select(
        "key", "size", "copy", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part")
    ).withColumn("tokens", F.least(F.lit(capacity), F.col("size") - F.col("part") * capacity).cast("long"))
    full = pieces.where(F.col("tokens") == capacity)
    rest = pieces.where(F.col("tokens") < capacity).withColumn("shard", F.pmod(F.xxhash64("key", "size", "copy"), F.lit(shards)).cast("int"))

    def first(group: pd.DataFrame) -> pd.DataFrame:
        # the order of a group's rows depends on how it arrived; the result must not
        group = group.sort_values(["tokens", "key", "size", "copy"]).reset_index(drop=True)
        number = np.full(len(group), -1)
        for b, members in enumerate(pack(group["tokens"].tolist(), capacity)):
            number[members] = b
        return pd.DataFrame({"key": group["key"], "part": group["part"], "tokens": group["tokens"], "shard": group["shard"], "bin": number})

    packed = rest.groupBy("shard").applyInPandas(first, f"key {kind}, part int, tokens long, shard int, bin int")
    named = lambda *c: F.concat_ws("-", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    return full.select(F.col("key").alias(key), "part", F.concat(F.lit("f-"), named("key", "size", "copy", "part")).alias("container"), "tokens").unionByName(
        packed.select(F.col("key").alias(key), "part", F.concat(F.lit("s-"), named("shard", "bin")).alias("container"), "tokens")
    )
