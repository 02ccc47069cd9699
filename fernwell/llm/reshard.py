"""Resharding by minimum-cost flow.

Old shards hold bytes; new shards have capacities. A transport network joins them: what stays in its shard is free, what
moves passes a hub at a cost of one per byte, so the network has an arc or two a shard and not one a pair of shards. The
flow of least cost says how many bytes leave and enter each shard, and no plan moves fewer; what passes the hub is paired
off in order, in fewer transfers than there are shards. Rows follow the flow: each old shard is laid out in blocks by a
hash, and the running byte offset of a row says into which transfer it falls; block sums give the offsets, so no shard is
ever sorted as a whole.

What reaches the driver: one row per old shard and block, and one per block and transfer. Blocks grow in number with the
bytes, ``BLOCK_BYTES`` each, so that a block is one task's sort whatever the input holds.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwell.llm.common import checkpointed

#: Blocks of each old shard at least, and bytes of text a block.
BLOCKS, BLOCK_BYTES = 128, 1 << 30


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a maximum flow of least cost, by successive shortest paths."""
    heads: list[list[int]] = [[] for _ in range(nodes)]
    to, room, price = [], [], []
    for a, b, capacity, cost in arcs:
        for x, y, r, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            heads[x].append(len(to))
            to.append(y), room.append(r), price.append(p)
    while True:
        best, via, queue, queued = [float("inf")] * nodes, [-1] * nodes, deque([source]), [False] * nodes
        best[source] = 0
        while queue:
            x = queue.popleft()
            queued[x] = False
            for a in heads[x]:
                if room[a] and best[x] + price[a] < best[to[a]]:
                    best[to[a]], via[to[a]] = best[x] + price[a], a
                    if not queued[to[a]]:
                        queue.append(to[a])
                        queued[to[a]] = True
        if via[sink] < 0:
            return [room[2 * i + 1] for i in range(len(arcs))]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        most = min(room[a] for a in path)
        for a in path:
            room[a] -= most
            room[a ^ 1] += most


def plan_transfers(old_sizes: list[int], capacities: list[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of a plan that moves the fewest bytes; what stays comes first of its old shard."""
    if sum(old_sizes) != sum(capacities):
        raise ValueError("sizes and capacities differ")
    n, m = len(old_sizes), len(capacities)
    hub, source, sink = n + m, n + m + 1, n + m + 2
    stay = [(i, n + i, min(old_sizes[i], capacities[i]), 0) for i in range(min(n, m))]
    leave, enter = [(i, hub, old_sizes[i], 1) for i in range(n)], [(hub, n + j, capacities[j], 0) for j in range(m)]
    ends = [(source, i, old_sizes[i], 0) for i in range(n)] + [(n + j, sink, capacities[j], 0) for j in range(m)]
    flow = min_cost_flow(n + m + 3, [*stay, *leave, *enter, *ends], source, sink)
    kept, out, into = flow[: len(stay)], flow[len(stay) : len(stay) + n], flow[len(stay) + n : len(stay) + n + m]
    moves: list[tuple[int, int, int]] = []
    j = 0
    for i in range(n):
        while out[i]:
            while not into[j]:
                j += 1
            moved = min(out[i], into[j])
            moves.append((i, j, moved))
            out[i] -= moved
            into[j] -= moved
    return sorted([*((i, i, b) for i, b in enumerate(kept) if b), *moves], key=lambda x: (x[0], x[0] != x[1]))


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def reshard(sized: DataFrame, old_shards: int, new_shards: int, capacities: list[int] | None = None, blocks: int | None = None) -> DataFrame:
    """``sized`` (``key``, ``size``, ``salt``, ``old`` and any other narrow columns) with ``shard`` and ``slot``.

    ``old`` is in [0, old_shards). A row goes where the middle of its bytes falls, so each new shard's size differs from
    its capacity by at most half a row for each transfer that begins or ends in it. Slots count from 0 without gaps in
    each shard. Rows alike in key and size may swap places. Null keys are keys. No rows: no rows. Other columns come along;
    columns ``shard`` and ``slot`` are replaced.
    """
    columns = [c for c in sized.columns if c not in ("shard", "slot")]
    if blocks is None:
        whole = sized.agg(F.sum("size")).first()[0] or 0
        blocks = max(BLOCKS, int(whole // (old_shards * BLOCK_BYTES)) + 1)
    block = F.pmod(F.xxhash64("key", "size", "salt"), F.lit(blocks)).cast("int")
    dealt = checkpointed(sized.select(*columns).withColumn("__block", block))
    by_hash = [F.xxhash64("key", F.lit(7)), "key", "size", "salt"]
    sums = dealt.groupBy("old", "__block").agg(F.sum("size").alias("bytes")).orderBy("old", "__block").collect()  # a row for each block
    old_sizes, starts = [0] * old_shards, []
    for r in sums:
        starts.append((r["old"], r["__block"], old_sizes[r["old"]]))
        old_sizes[r["old"]] += r["bytes"]
    cuts, at = [], [0] * old_shards
    for i, j, moved in plan_transfers(old_sizes, capacities or equal_capacities(sum(old_sizes), new_shards)):
        cuts.append([i, at[i], at[i] + moved, j])
        at[i] += moved
    cuts = [[i, lo, hi if hi < old_sizes[i] else 1 << 62, j] for i, lo, hi, j in cuts]  # nothing falls behind the last transfer
    cuts += [[i, 0, 1 << 62, i % new_shards] for i in range(old_shards) if not old_sizes[i]]  # rows of no size
    spark = sized.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "old int, __block int, __base long"))  # a row for each block
    transfers = F.broadcast(spark.createDataFrame(cuts, "old int, __from long, __to long, shard int"))  # fewer rows than shards, old and new
    middle = F.col("__base") + F.col("__within") - F.col("size") / 2
    running = F.sum("size").over(Window.partitionBy("old", "__block").orderBy(*by_hash).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("__within", running).join(offsets, ["old", "__block"]).join(transfers, "old").filter((middle >= F.col("__from")) & (middle < F.col("__to")))
    nth = F.row_number().over(Window.partitionBy("shard", "old", "__block").orderBy(*by_hash))
    placed = checkpointed(placed.withColumn("__nth", nth))
    counts = placed.groupBy("shard", "old", "__block").agg(F.count("*").alias("n")).orderBy("shard", "old", "__block").collect()  # blocks and transfers
    seen, slots = [0] * new_shards, []
    for r in counts:
        slots.append((r["shard"], r["old"], r["__block"], seen[r["shard"]]))
        seen[r["shard"]] += r["n"]
    bases = F.broadcast(spark.createDataFrame(slots, "shard int, old int, __block int, __slot long"))  # as many
    return placed.join(bases, ["shard", "old", "__block"]).select(*columns, "shard", (F.col("__slot") + F.col("__nth") - 1).alias("slot"))


def lay_out(rows: DataFrame, path: str) -> None:
    """Write ``rows`` as Parquet in a folder ``shard=N`` for each value of their column ``shard``."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def rewrite_affected(old_path: str, new_path: str, placed: DataFrame, key_col: str) -> list[int]:
    """Write new generations of the shards whose rows change and return their numbers.

    ``old_path`` holds Parquet in folders ``shard=N``; ``placed`` has ``key``, ``old``, ``shard`` and ``slot``, a row for each
    row there. Null keys are keys. Rows alike in key and old shard are paired off in any order, so none is lost or doubled;
    where their sizes differ, the caller takes a key that is unique. Unique keys move the rows once, others once more for the
    pairing. New files hold ``slot`` too and are in its order; each task writes one a shard.
    A shard that neither gives nor takes a row is not read or written; the caller keeps its folder in the manifest.
    """
    spark = placed.sparkSession
    moved = placed.filter("old <> shard")
    affected = sorted({r[0] for r in moved.select(F.explode(F.array("old", "shard"))).distinct().collect()})  # shard numbers
    if affected:
        rows = spark.read.parquet(old_path).filter(F.col("shard").isin(affected)).withColumnRenamed("shard", "__old")
        target = placed.filter(F.col("shard").isin(affected)).select(F.col("key").alias("__key"), F.col("old").alias("__from"), "shard", "slot")
        same = F.col(key_col) == F.col("__key")
        if not placed.groupBy("key").count().filter("count > 1 or key is null").isEmpty():
            nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
            rows, target = rows.withColumn("__nth", nth("__old", key_col)), target.withColumn("__n", nth("__from", "__key"))
            same = F.col(key_col).eqNullSafe(F.col("__key")) & (F.col("__old") == F.col("__from")) & (F.col("__nth") == F.col("__n"))
        both = rows.join(target, same).drop("__old", "__nth", "__key", "__from", "__n")
        lay_out(both.sortWithinPartitions("shard", "slot"), new_path)
    return affected
