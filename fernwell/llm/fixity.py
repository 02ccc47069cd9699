"""Merkle fixity audit of record archives.

Each record is hashed (SHA-256). The records of one offset make a leaf: its hash covers the multiset of its records'
hashes by eight sums, so ties and repeated rows of any number take constant memory. Leaves are grouped into ordered
offset ranges of ``fanout`` offsets, those into ranges of ``fanout`` ranges, and so on up to one root per archive file;
a node's hash covers its children's positions and hashes in order, so no group is larger than ``fanout``.

An audit compares the roots of two replicas and descends: on each level only children of mismatching nodes are compared.
Every level is a table of its own, written once (checkpointed), so an audit reads no payload and no level below the last
one that differs: equal replicas cost a row per archive file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwell.llm.common import checkpointed

FANOUT = 64


def _leaf_hash() -> Column:
    parts = [F.sum(F.conv(F.substring("rh", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256)


def merkle_tree(records: DataFrame, file_col: str, offset_col: str, payload_cols: list[str], fanout: int = FANOUT, height: int | None = None) -> list[DataFrame]:
    """The levels of the trees, each with ``file``, ``pos``, ``hash``: the first has a node an offset, the last one a file.

    Null payloads differ from empty ones. A null file is a file. Offsets are not negative; null or negative ones share
    the position -1, which every level keeps. No records: no nodes. Other columns are ignored.
    """
    tagged = [F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in payload_cols]
    rows = records.select(
        F.col(file_col).cast("string").alias("file"),
        F.greatest(F.coalesce(F.col(offset_col).cast("long"), F.lit(-1)), F.lit(-1)).alias("pos"),
        F.sha2(F.concat_ws("|", *tagged), 256).alias("rh"),
    )
    level = checkpointed(rows.groupBy("file", "pos").agg(_leaf_hash().alias("hash")))
    if height is None:
        height = tree_height(level.agg(F.max("pos")).first()[0], fanout)
    levels = [level]
    for _ in range(height):
        parent = F.when(F.col("pos") < 0, -1).otherwise(F.floor(F.col("pos") / fanout)).cast("long")
        level = checkpointed(
            level.groupBy("file", parent.alias("parent"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), x["hash"])), ",").alias("all"))
            .select("file", F.col("parent").alias("pos"), F.sha2("all", 256).alias("hash"))
        )
        levels.append(level)
    return levels


def tree_height(largest: int | None, fanout: int = FANOUT) -> int:
    """Levels over the leaves, so that positions up to ``largest`` meet in one node."""
    height, reach = 1, fanout
    while largest is not None and largest >= reach:
        height, reach = height + 1, reach * fanout
    return height


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Offsets where two trees of one height differ: ``file``, ``pos``, ``status`` (changed, missing or extra in theirs)
    and ``range_start``, the first offset of the lowest range that holds it. Equal roots: no rows, and no level below is read.
    """

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        a, b = (
            t[level].select("file", "pos", F.col("hash").alias(name)).withColumn("parent", F.when(F.col("pos") < 0, -1).otherwise(F.floor(F.col("pos") / fanout)).cast("long"))
            for t, name in ((ours, "a"), (theirs, "b"))
        )
        if within is not None:
            # only children of mismatching nodes
            keep = within.select(F.col("file").alias("wf"), F.col("pos").alias("wp"))
            a, b = (t.join(keep, t.file.eqNullSafe(F.col("wf")) & (t.parent == F.col("wp")), "left_semi") for t in (a, b))
        a, b = a.select("file", "pos", "a"), b.select(F.col("file").alias("bf"), F.col("pos").alias("bp"), "b")
        both = a.join(b, a.file.eqNullSafe(b.bf) & (a.pos == b.bp), "full_outer")
        return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
            F.when(F.col("a").isNotNull(), F.col("file")).otherwise(F.col("bf")).alias("file"),
            F.coalesce("pos", "bp").alias("pos"),
            F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed").alias("status"),
        )

    found = None
    for level in range(len(ours) - 1, -1, -1):
        found = checkpointed(differing(level, found))
        if found.isEmpty():
            break
    return found.withColumn("range_start", F.when(F.col("pos") < 0, -1).otherwise(F.floor(F.col("pos") / fanout) * fanout).cast("long"))


def audit_replicas(ours: DataFrame, theirs: DataFrame, file_col: str, offset_col: str, payload_cols: list[str], fanout: int = FANOUT) -> DataFrame:
    """Build both trees to one height and compare them."""
    largest = max((x for x in (t.agg(F.max(F.col(offset_col).cast("long"))).first()[0] for t in (ours, theirs)) if x is not None), default=None)
    height = tree_height(largest, fanout)
    a, b = (merkle_tree(t, file_col, offset_col, payload_cols, fanout, height) for t in (ours, theirs))
    return audit(a, b, fanout)
