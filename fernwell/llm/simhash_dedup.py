"""SimHash near-duplicate groups by anchor-point covering.

Method. A 64-bit fingerprint is cut into three parts of 21, 21 and 22 bits. Two fingerprints that differ in at most
four bits differ in at most one bit of some part. Each part has its own covering code: the perfect Hamming code on 15
bits (covering radius 1) times all words on the remaining bits. The codewords are the anchors. A fingerprint is copied
to every anchor within covering radius plus the part's share of the threshold, 1 + 1 = 2 bits, about 15 anchors a part,
so two linked fingerprints always meet at the anchor nearest to either of them; there they are compared exactly.

Scale. Equal fingerprints are folded into one row before anything is copied, so groups of exact copies cost one row.
Within an anchor, linked fingerprints agree in at least one of five pieces of the bits outside the anchor's part, so only
those that agree in a piece are compared: some 1/400 of the pairs of an anchor. A dense group of near copies is walked
breadth-first in blocks that take members out as they reach them, which costs about one pass, and only a spanning forest
leaves the task, never all pairs. Components come from alternating large-star and small-star rounds over those few links,
cut by checkpoints; nothing is collected.

Stages that ask for near copies by the similarity of their shingles (``keep_one``) start from the same anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwell.llm.common import checkpointed

THRESHOLD = 4
SHINGLE = 4
#: (first bit, bits) of each part.
PARTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
#: Pieces of the bits outside each part: one more than the threshold.
PIECES = THRESHOLD + 1
#: Longer runs are walked in blocks; both ways give the same components.
PAIRWISE = 32
BLOCK = 512
#: Linked fingerprints that a task remembers, so as not to send links that join nothing.
REMEMBERED = 1_000_000
_BYTE_AT = 256 * np.arange(8, dtype=np.int64)
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text: bit i is 1 if it is set in over half the shingle hashes. No word: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and splits at \x20 \x09-\x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(ends) - k] + 1).tolist()]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], "<u8")
        of_byte = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
        ones += (of_byte @ _BITS_OF_BYTE).ravel()
    return int(np.packbits((2 * ones > len(starts)).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long, of every row. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"doc {kind}, fp long")


def _columns_of_parity_check() -> np.ndarray:
    return np.arange(1, CODE_BITS + 1, dtype=np.int64)  # column i of the Hamming check matrix is the number i + 1


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros_like(x)
    for i, column in enumerate(_columns_of_parity_check()):
        s ^= np.where((x >> i) & 1, column, 0)
    return s


def anchor_moves(bits: int) -> list[tuple[int, int]]:
    """Every (flips, syndrome) with at most two flipped bits: x ^ flips is an anchor exactly if x has that syndrome."""
    column = [int(c) for c in _columns_of_parity_check()] + [0] * (bits - CODE_BITS)
    moves = [(0, 0)] + [(1 << i, column[i]) for i in range(bits)]
    return moves + [(1 << i | 1 << j, column[i] ^ column[j]) for i in range(bits) for j in range(i)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, index of the fingerprint) for every anchor within reach, over all parts."""
    keys, rows = [], []
    for part, (low, bits) in enumerate(PARTS):
        x = ((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = _syndrome(x)
        by_syndrome = [np.flatnonzero(s == v) for v in range(CODE_BITS + 1)]
        for flips, syndrome in anchor_moves(bits):
            at = by_syndrome[syndrome]
            if len(at):
                keys.append((x[at] ^ flips) | (part << 24))
                rows.append(at)
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _near(block: np.ndarray, rest: np.ndarray, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, which of ``rest`` from there are near each of ``block``), in bounded pieces."""
    for at in range(0, len(rest), 1 << 14):
        yield at, np.bitwise_count(block[:, None] ^ rest[None, at : at + (1 << 14)]) <= threshold


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join distinct ``fps`` into the components of the threshold graph.

    Fingerprints that are near none are set aside a block at a time. From each other one a breadth-first walk in blocks
    takes its component out, so that later steps compare with less.
    """
    links: list[tuple[int, int]] = []
    rest = fps
    while len(rest):
        seeds = rest[:BLOCK]
        hits = sum(near.sum(axis=1) for _, near in _near(seeds, rest, threshold))
        seeds = seeds[hits > 1]  # each is near itself
        rest = np.concatenate([seeds, rest[BLOCK:]])
        while len(seeds):
            frontier, rest = rest[:1], rest[1:]
            while len(frontier) and len(rest):
                block, frontier = frontier[:BLOCK], frontier[BLOCK:]
                reached = np.zeros(len(rest), bool)
                for at, near in _near(block, rest, threshold):
                    hit = np.flatnonzero(near.any(axis=0))
                    links.extend(zip(block[near[:, hit].argmax(axis=0)].tolist(), rest[at + hit].tolist()))
                    reached[at + hit] = True
                frontier, rest = np.concatenate([frontier, rest[reached]]), rest[~reached]
            seeds = seeds[np.isin(seeds, rest)]  # they stand first in what is left
    return links


def linked(keys: np.ndarray, fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links within runs of equal ``keys``: short runs by comparing each with its followers, long ones by ``forest``."""
    if not len(keys):
        return []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    links: list[tuple[int, int]] = []
    short = np.repeat((lengths > 1) & (lengths <= PAIRWISE), lengths)
    k, f = keys[short], fps[short]
    for lag in range(1, min(PAIRWISE, len(k))):
        same = k[lag:] == k[:-lag]
        if not same.any():
            break
        near = same & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= threshold)
        links.extend(zip(f[:-lag][near].tolist(), f[lag:][near].tolist()))
    for at in np.flatnonzero(lengths > PAIRWISE):
        links.extend(forest(fps[starts[at] : starts[at] + lengths[at]], threshold))
    return links


def linked_by_pieces(keys: np.ndarray, fps: np.ndarray, threshold: int = THRESHOLD) -> Iterator[tuple[int, int]]:
    """Links among the fingerprints of equal anchor ``keys`` (sorted), found among those that share a piece of their other bits."""
    for part, (low, bits) in enumerate(PARTS):
        here = keys >> 24 == part
        k, f = keys[here], fps[here]
        if len(k) < 2:
            continue
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        k, f = k[same], f[same]  # a fingerprint alone at its anchor has no link there
        rest = (f & np.uint64((1 << low) - 1)) | ((f >> np.uint64(low + bits)) << np.uint64(low))
        width = 64 - bits
        for piece in range(PIECES):
            at, end = width * piece // PIECES, width * (piece + 1) // PIECES
            sub = ((rest >> np.uint64(at)) & np.uint64((1 << (end - at)) - 1)).astype(np.int64)
            key = (k << 9) | sub
            by = np.argsort(key, kind="stable")
            yield from linked(key[by], f[by], threshold)


class Roots:
    """Union-find over the few linked fingerprints of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def whole_groups(batches: Iterator[pa.RecordBatch], least_rows: int = 100_000) -> Iterator[pa.Table]:
    """Batches sorted by their first column, as tables that hold each value of it as a whole, of ``least_rows`` where there are as many."""
    ready: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        ready.append(b)
        rows += b.num_rows
        keys = b.column(0).to_numpy(zero_copy_only=False)
        if rows < least_rows or ready[0].column(0)[0].as_py() == keys[-1]:
            continue  # too few yet, or all of one group so far
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or len(ready) > 1 and ready[-2].column(0)[-1].as_py() != keys[-1]:
            yield pa.Table.from_batches([*ready[:-1], b.slice(0, cut)])
            ready, rows = [b.slice(cut)], b.num_rows - cut
    if ready:
        yield pa.Table.from_batches(ready)


def links_by_anchor(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Spanning links ``a``, ``b`` (linked pairs themselves) among the distinct fingerprints in column ``fp``."""
    if threshold > THRESHOLD:
        raise ValueError(f"three parts with one bit each reach {THRESHOLD} bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at : at + 4096]
                keys, rows = anchors(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = Roots()
        for t in whole_groups(batches):
            keys, fps = t.column("anchor").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            new = [(a, b) for a, b in linked_by_pieces(keys, fps, threshold) if roots.join(a, b)]
            pairs = np.array(new, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy(), pa.int64()), pa.array(pairs[:, 1].copy(), pa.int64())], names=["a", "b"])
            if len(roots.up) > REMEMBERED:
                roots = Roots()

    spread_out = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    return spread_out.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of the links ``a``, ``b``.

    Large-star and small-star rounds; each round joins a node's links with its smallest neighbour, so that no
    neighbourhood is ever gathered. Every round is checkpointed.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")
        )
        edges = checkpointed(small.select("e.a", "e.b").filter("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable) for every row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each give a row. Rows with a
    null id get the component's smallest id, which is null only if no row of the component has one. No rows: no rows.
    """
    rows = checkpointed(with_fingerprint(docs, id_col, text_col))
    distinct = rows.groupBy("fp").agg(F.min("doc").alias("least"))
    roots = components(links_by_anchor(distinct, threshold))
    # only linked fingerprints take part; both sides of each join are exchanges of their own, so that Spark can split a large root
    members = checkpointed(distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least"))
    smallest = checkpointed(members.groupBy("root").agg(F.min("least").alias("component")))
    ids = checkpointed(members.join(smallest, "root").select("fp", "component"))
    named = checkpointed(distinct.join(ids, "fp", "left").select("fp", F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("least")).alias("component")))
    return rows.join(named, "fp").select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, by five-word shingles; see ``shingle_dedup``."""
    from fernwell.llm import shingle_dedup

    return shingle_dedup.keep_one(docs, id_col, text_col)
