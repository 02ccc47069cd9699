"""SimHash near-dedup by the similarity of five-word shingles.

Two texts are near copies if their sets of shingle hashes have a Jaccard similarity of at least 0.8. A text of fewer than
five words has one shingle, all of it; texts without words are alike.

Method. Anchor-point covering (``simhash_dedup``) finds the pairs whose fingerprints differ in at most four bits. At a
similarity of 0.8 some ten of 64 bits differ, up to twenty in one of a thousand pairs, and no covering reaches that far:
with four parts of 16 bits it would copy a fingerprint to 157 anchors a part and compare a hundredth of all pairs. So sets
that share one of 40 MinHash bands of five are candidates too; a pair of similarity 0.8 shares none with probability
(1 - 0.8^5)^40 = 1.3e-7. A pair is considered where it shares its first band. 200 bytes, the low ones of its minima,
estimate its similarity; it is verified on the whole sets unless fewer than ``LIKELY`` of them agree, which a pair of 0.8
fails with probability 3e-7. Every link is verified, so no other texts are linked.

Scale. Equal sets are folded into one row first. In a first round each candidate is verified against the leader of its
group only: a dense group costs a pair a member. In a second round only what is still apart is compared, on whole sets and
within a task, by an inverted index of the group's shingles; members outside the group's largest component meet everyone.
Large groups are dealt in chunks, each of which gets those few members. Links leave the tasks, pairs never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwell.llm.common import checkpointed
from fernwell.llm.simhash_dedup import Roots, components, links_by_anchor, whole_groups

SHINGLE, BANDS, ROWS = 5, 40, 5
#: Members of a group in one task; estimates that must agree for a pair to be verified, and for a leader to take a member.
CHUNK, LIKELY, ALIKE = 2048, 132, 160
_AT_ONCE = 256
_RANDOM = np.random.default_rng(20)
_TIMES = _RANDOM.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
_OF_BAND = _RANDOM.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of five words, lower-cased and split at white space in ASCII."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    if not k:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([digest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)], np.uint64))


def simhash(h: np.ndarray) -> int:
    """The fingerprint of a set of hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(np.ascontiguousarray(h[at : at + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def minima(h: np.ndarray) -> np.ndarray:
    """The MinHash of a set: its least value under each of 200 hash functions."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), _AT_ONCE):
        np.minimum(least, (h[None, at : at + _AT_ONCE] * _TIMES + _PLUS).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash for each band."""
    x = (least.reshape(BANDS, ROWS) * _OF_BAND).sum(axis=1, dtype=np.uint64)
    return x ^ (x >> np.uint64(32))


def low_bytes(least: np.ndarray) -> np.ndarray:
    return (least >> np.uint64(24)).astype(np.uint8)  # the lowest bits of an odd multiple depend on few bits of the hash


def similar(a: Column, b: Column) -> Column:
    """Whether two arrays of distinct values have a Jaccard similarity of at least 4/5."""
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def _sketches(rows: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``doc``, and of the shingle set its hash ``fp``, size ``n``, fingerprint ``sim``, ``sig`` and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, _AT_ONCE):
                b = whole.slice(at, _AT_ONCE)
                sets = [shingles(t) for t in b.column(3).to_pylist()]
                least = [minima(h) for h in sets]
                fp = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
                sim = np.array([simhash(h) for h in sets], np.uint64).view(np.int64)
                keys = np.array([bands(m) for m in least], np.uint64).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(keys))
                columns = [*b.columns[:3], pa.array(fp), pa.array([len(h) for h in sets], pa.int32()), pa.array(sim), pa.array([low_bytes(m).tobytes() for m in least], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "doc", "fp", "n", "sim", "sig", "bands"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("k1", "k2", "doc", "t").mapInArrow(run, f"k1 long, k2 long, doc {kind}, fp long, n int, sim long, sig binary, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """``fp`` and the shingle hashes ``h`` of rows with text ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _AT_ONCE):
                some = b.slice(at, _AT_ONCE)
                sets = [shingles(t) for t in some.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], names=["fp", "h"])

    return rows.select("fp", "t").mapInArrow(run, "fp long, h array<long>")


def agreement(sig: np.ndarray, n: np.ndarray, band: int, probes: np.ndarray) -> np.ndarray:
    """How many of 200 bytes agree, for each of ``probes`` (places) with each member of a group.

    Zero for pairs that share an earlier band, where they are considered, and for sizes that no pair of 0.8 can have.
    """
    out = np.zeros((len(probes), len(sig)), np.uint8)
    step = max(1, 8_000_000 // (len(sig) * sig.shape[1] or 1))
    for at in range(0, len(probes), step):
        p = probes[at : at + step]
        same = sig[p][:, None, :] == sig[None, :, :]
        count = same.sum(axis=2, dtype=np.uint8)
        if band:
            count[same[:, :, : band * ROWS].reshape(len(p), len(sig), band, ROWS).all(axis=3).any(axis=2)] = 0
        a, b = n[p][:, None].astype(np.int64), n[None, :].astype(np.int64)
        count[5 * np.minimum(a, b) < 4 * np.maximum(a, b)] = 0
        out[at : at + step] = count
    return out


def leader_pairs(sig: np.ndarray, n: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Pairs of places in a group to verify first: each member with its leader, or else with the member most like it.

    Leaders are the first members that no earlier leader took. Every member that may have a near copy is in some pair.
    """
    size = len(sig)
    if size == 2:
        return [(1, 0)] if agreement(sig, n, band, np.array([1]))[0, 0] >= LIKELY else []
    agree = agreement(sig, n, band, np.arange(size))
    np.fill_diagonal(agree, 0)
    pairs, rest = [], np.arange(size)
    taken = np.zeros(size, bool)
    while len(rest):
        leader, rest = rest[0], rest[1:]
        alike = agree[leader, rest] >= ALIKE
        pairs.extend((int(x), int(leader)) for x in rest[alike])
        taken[rest[alike]] = True
        taken[leader] |= bool(alike.any())
        rest = rest[~alike]
    best = agree.argmax(axis=1)
    return pairs + [(int(x), int(best[x])) for x in np.flatnonzero(~taken & (agree.max(axis=1) >= LIKELY))]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
    """(table, first row, last row + 1) of each group of at least two rows."""
    for t in whole_groups(batches, 20_000):
        t = t.combine_chunks()
        keys = t.column(0).to_numpy()
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo > 1:
                yield t, lo, hi


def _signatures(t: pa.Table, lo: int, hi: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1)


def _pairs_frame(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, lo, hi in _groups(batches):
        fps = t.column("fp").slice(lo, hi - lo).to_numpy()
        found = leader_pairs(_signatures(t, lo, hi), t.column("n").slice(lo, hi - lo).to_numpy(), t.column("nth")[lo].as_py())
        yield _pairs_frame([max(fps[i], fps[j]) for i, j in found], [min(fps[i], fps[j]) for i, j in found])


def apart_probes(root: np.ndarray, largest: np.ndarray) -> np.ndarray:
    return np.flatnonzero(root != largest)


def _likely_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups with several roots, the members of pairs that are apart and may be near copies."""
    for t, lo, hi in _groups(batches):
        piece = t.slice(lo, hi - lo)
        fps, root, n = (piece.column(c).to_numpy() for c in ("fp", "root", "n"))
        probes = np.flatnonzero(piece.column("probe").to_numpy(zero_copy_only=False))
        active = np.zeros(hi - lo, bool)
        sig = _signatures(t, lo, hi)
        for at in range(0, len(probes), 256):
            p = probes[at : at + 256]
            near = (agreement(sig, n, piece.column("nth")[0].as_py(), p) >= LIKELY) & (root[p][:, None] != root[None, :])
            active[p] |= near.any(axis=1)
            active |= near.any(axis=0)
        at = np.flatnonzero(active)
        yield pa.RecordBatch.from_arrays([piece.column("group").combine_chunks().take(at), pa.array(fps[at]), pa.array(root[at]), piece.column("probe").combine_chunks().take(at)], names=["group", "fp", "root", "probe"])


def near_sets(sets: list[np.ndarray], root: np.ndarray, probes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places, one of them in ``probes``, of similar sets; those of a root that is already joined are left out."""
    sizes = np.array([len(s) for s in sets])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(shingle, kind="stable")
    members, starts = of[by], np.r_[0, np.cumsum(np.bincount(shingle))]
    ends = np.cumsum(sizes)
    joined, found = Roots(), []
    for x in probes.tolist():
        mine = shingle[ends[x] - sizes[x] : ends[x]]
        shared = np.bincount(np.concatenate([members[starts[s] : starts[s + 1]] for s in mine] or [np.zeros(0, np.int64)]), minlength=len(sets))
        for y in np.flatnonzero((9 * shared >= 4 * (sizes + sizes[x])) & (root != root[x])).tolist():
            if joined.join(int(root[x]), int(root[y])):
                found.append((x, y))
    return found


def _last_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, lo, hi in _groups(batches):
        piece = t.slice(lo, hi - lo)
        fps, root = piece.column("fp").to_numpy(), piece.column("root").to_numpy()
        probes = np.flatnonzero(piece.column("probe").to_numpy(zero_copy_only=False))
        found = near_sets([h.values.to_numpy() for h in piece.column("h")], root, probes)
        yield _pairs_frame([max(fps[i], fps[j]) for i, j in found], [min(fps[i], fps[j]) for i, j in found])


def _by_group(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition("group").sortWithinPartitions("group", *more)


def _links(rows: DataFrame, sketches: DataFrame, chunk: int) -> DataFrame:
    """Verified links ``a``, ``b`` that join every shingle set with its near copies' component."""
    distinct = checkpointed(sketches.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("n", "sim", "sig", "bands")], F.min(F.struct("k1", "k2")).alias("of")))
    # anchors: sets of one fingerprint, and fingerprints of at most four bits apart
    first = distinct.groupBy("sim").agg(F.min("fp").alias("first"))
    twins = distinct.join(first, "sim").filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    bits = links_by_anchor(first.select(F.col("sim").alias("fp")))
    by_bits = bits.join(first.select(F.col("sim").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("sim").alias("b"), F.col("first").alias("y")), "b")
    anchored = twins.unionByName(by_bits.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
    # bands that several sets share
    each = distinct.select("fp", F.posexplode("bands").alias("nth", "band"))
    several = each.groupBy("nth", "band").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / chunk))
    members = each.join(several, ["nth", "band"]).select("fp", "nth", "band", dealt.alias("chunk"), F.ceil(F.col("size") / chunk).alias("chunks"))
    members = checkpointed(members.join(distinct.select("fp", "n", "sig"), "fp").select(F.xxhash64("nth", "band", "chunk").alias("group"), "fp", "nth", "n", "sig", "band", "chunk", "chunks"))
    led = _by_group(members.select("group", "fp", "nth", "n", "sig"), "fp").mapInArrow(_first_pairs, "a long, b long")
    pairs = checkpointed(anchored.unionByName(led).distinct())
    # whole sets of all that is in a pair; two rows may be alike in id and text
    asked = distinct.select("fp", "of.k1", "of.k2").join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi")
    sets = checkpointed(_sets(rows.select("k1", "k2", "t").join(asked, ["k1", "k2"])).dropDuplicates(["fp"]))
    verified = pairs.join(sets.select(F.col("fp").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("fp").alias("b"), F.col("h").alias("hb")), "b").filter(similar(F.col("ha"), F.col("hb")))
    links = checkpointed(verified.select("a", "b"))
    # what is still apart; the largest root of a band's group is the one that no member has to be held against by itself
    roots = components(links).select(F.col("node").alias("fp"), "root")
    now = members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = now.groupBy("nth", "band", "root").agg(F.count("*").alias("m"))
    mixed = of_root.groupBy("nth", "band").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1").select("nth", "band", F.col("top.root").alias("largest"))
    now = now.join(mixed, ["nth", "band"]).withColumn("probe", F.col("root") != F.col("largest"))
    everywhere = F.when(F.col("probe"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    now = now.withColumn("chunk", F.explode(everywhere)).select(F.xxhash64("nth", "band", "chunk").alias("group"), "fp", "nth", "n", "sig", "root", "probe")
    active = checkpointed(_by_group(now, "fp").mapInArrow(_likely_apart, "group long, fp long, root long, probe boolean"))
    last = _by_group(active.join(sets, "fp").select("group", "fp", "root", "probe", "h"), "fp").mapInArrow(_last_links, "a long, b long")
    return links.unionByName(checkpointed(last.distinct()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, of a null id only if there is no other.

    Groups are the components of pairs of near copies. Rows are told apart by id and text, so rows that share an id, null
    included, are judged each by its own text; of rows alike in both one stays. Null texts count as empty, and empty texts
    are alike. No rows: no rows. Other columns, whatever their names, come along untouched.
    """
    text, columns = F.col(text_col).cast("string"), [F.col(f"`{c}`") for c in docs.columns]
    key = lambda x: f"{x}{max(map(len, docs.columns), default=0) * '_'}"  # noqa: E731 - longer than any column's name
    keyed = docs.withColumn(key("k1"), F.xxhash64(id_col, text)).withColumn(key("k2"), F.xxhash64(text, id_col))
    rows = keyed.select(F.col(key("k1")).alias("k1"), F.col(key("k2")).alias("k2"), F.col(id_col).alias("doc"), text.alias("t"))
    sketches = checkpointed(_sketches(rows))
    roots = components(_links(rows, sketches, chunk))
    named = sketches.select("k1", "k2", "doc", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "k1", "k2")).alias("it"))
    kept = best.select(F.col("it.k1").alias(key("k1")), F.col("it.k2").alias(key("k2")))
    # first one row of each key, which needs no more than a row a key and task to move; then one shuffle serves both
    first = Window.partitionBy(key("k1"), key("k2")).orderBy(F.lit(0))
    one = keyed.withColumn(key("nth"), F.row_number().over(first)).filter(F.col(key("nth")) == 1)
    return one.join(kept, [key("k1"), key("k2")], "left_semi").select(*columns)
