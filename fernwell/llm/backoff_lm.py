"""Stupid-backoff language-model scores, computed relationally.

A word's score given the words before it is c(context word) / c(context) where that n-gram was seen at least ``min_count``
times; otherwise ALPHA times its score given one word less, at last c(word) / N. A document's score is the sum of the
logarithms, its end included. All counts are over the whole corpus; with the default minimum of one every seen n-gram counts.

Method. Documents are gathered in blocks of bounded text, written once with their words numbered by frequency. A block is
exploded into its distinct n-grams of every order with their number in the block. These rows (gram, block, n) are
partitioned by the n-gram's hash; the count table is their sum by n-gram, joined back to the rows as a window sum in the
same partitioning, so that rows move once. The counts return to their blocks, and each block adds up the logarithms of its
documents' n-grams.

Words and pairs are counted first. Longer n-grams follow in a second round, without those that hold a pair seen once in the
corpus: they are seen once themselves, so their counts are known and every count stays exact.

Scale. Every relation is linear in the n-grams: a block sends a distinct n-gram once, however often it occurs, so the
commonest n-gram has one row a block; counts come back in the order of the block's sorted n-grams, one byte for most, and
the words themselves never travel. Memory is bounded by a block, by one hash part, or by the longest text.

Words are 64-bit hashes, and so are n-grams: two of n distinct ones are taken for one with probability n^2 / 2^65, so a
billion distinct n-grams hold 0.03 such pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwell.llm.common import checkpointed, shuffles_removed

ALPHA, ORDER, MIN_COUNT = 0.4, 2, 1
BLOCK_CHARS = 16_000_000
TASK_TOKENS, LEAST_PARTS = 1_500_000, 1024
#: Words of a block that are looked up and scored at once.
SLICE = 1 << 18
_KEPT_WORDS = 300_000
_WORD = re.compile(r"\w+")
#: No word has these hashes' texts, as they hold no letter, digit or underscore.
_EDGES = ("\x02", "\x03")


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class Words:
    """Words of texts as 64-bit hashes; recent words keep theirs in a bounded table."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _missed(self, word: str) -> int:
        if len(self.known) >= _KEPT_WORDS:
            self.known.clear()
        h = self.known[word] = _hash(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        known, missed = self.known.get, self._missed
        return np.array([h if (h := known(w)) is not None else missed(w) for w in _WORD.findall((text or "").lower())], np.uint64)


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed by planes of bytes."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def few_bytes(counts: np.ndarray) -> bytes:
    """A byte for each count below 255, five for others."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u4").tobytes()


def from_few_bytes(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u4", offset=n)
    return counts


def grams(words: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """A row for each order from 1: the hashes of the n-grams that end at each word; where the text has too few before it, zero.

    ``starts``: each word's distance from its text's start. Works in place, as a block's arrays are large.
    """
    out = np.zeros((order, len(words)), np.uint64)
    np.multiply(words, np.uint64(0x9E3779B97F4A7C15), out=out[0])
    out[0] ^= out[0] >> np.uint64(29)
    for k in range(2, order + 1):
        y = out[k - 1]
        np.add(out[k - 2][:-1], np.uint64(k), out=y[1:])
        y *= np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(32)
        y ^= words
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(31)
        y[starts < k - 1] = 0
    return out


def _found(table: np.ndarray, values: np.ndarray, real: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By slices the positions of the real values and their places in the sorted ``table``; a slice may be overwritten."""
    for lo in range(0, len(values), SLICE):
        at = np.arange(lo, min(lo + SLICE, len(values)))
        if real is not None:
            at = at[real[at]]
        own, place = np.unique(values[at], return_inverse=True)
        yield at, np.searchsorted(table, own)[place]


class Block:
    """Texts as numbers of words: what a block holds, and what it is rebuilt from; its n-grams are of orders ``low`` to ``high``.

    With ``pairs``, how often each word's pair with the word before it is seen, the n-grams with a pair seen once are left
    out: they are seen once as well.
    """

    def __init__(self, table: list[int] | np.ndarray, places: np.ndarray, lengths: np.ndarray, high: int, low: int = 1, pairs: np.ndarray | None = None) -> None:
        self.table, self.places, self.lengths, self.low, self.high = np.asarray(table, np.uint64), places, lengths, low, high
        self.ends = np.cumsum(lengths)
        self.starts = np.arange(len(places), dtype=np.int32)
        self.reach = self.starts  # an n-gram ends at a word if n is at most its reach plus one
        if pairs is not None:
            self.reach = self.starts - np.maximum.accumulate(np.where(pairs >= 2, 0, self.starts))
        self.starts = self.starts - np.repeat((self.ends - lengths).astype(np.int32), lengths)
        if pairs is None:
            self.reach = self.starts

    def grams(self) -> np.ndarray:
        return grams(self.table[self.places], self.reach, self.high)[self.low - 1 :].view(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of all orders, sorted, and how often each occurs."""
        every = self.grams().ravel()
        every.sort()
        edges = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        gram, n = every[edges], np.diff(np.r_[edges, len(every)])
        n[gram == 0] -= sum(int((self.reach < k).sum()) for k in range(self.low - 1, self.high))  # words with too few before them
        return (gram, n) if n.all() else (gram[n > 0], n[n > 0])

    def counts(self, gram: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each order the counts at each word, given those of the distinct n-grams; zero where too few words are before it."""
        every = self.grams()
        for k, row in enumerate(every, self.low - 1):
            for at, place in _found(gram, row, self.reach >= k):
                row[at] = counts[place]
            row[self.reach < k] = 1
            row[self.starts < k] = 0
        return every


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """``block``, ``docs``, ``lengths``, ``tokens``, ``places``, ``table``: the texts of blocks as numbers into a table of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, edges = Words(), [np.array([_hash(e)], np.uint64) for e in _EDGES]
        ids, texts, chars, made = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, chars, made
            lengths, hashes = np.array([len(t) for t in texts], np.int64), np.concatenate(texts)
            texts = []
            table, times = np.unique(hashes, return_counts=True)
            by = np.argsort(-times, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by))
            ranks = np.empty(len(hashes), np.uint32)
            for at, place in _found(table, hashes):
                ranks[at] = rank[place]
            columns = [
                pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()),
                pa.ListArray.from_arrays([0, len(lengths)], pa.concat_arrays(ids)),
                pa.array([lengths.tolist()], pa.list_(pa.int64())),
                pa.array([int(lengths.sum())], pa.int64()),
                pa.array([packed(ranks)], pa.binary()),
                pa.array([table[by].tobytes()], pa.binary()),
            ]
            ids, chars, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "lengths", "tokens", "places", "table"])

        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                w = words.of(text)
                ids.append(b.column(0).slice(i, 1))
                texts.append(np.concatenate([edges[0], w, edges[1]]) if len(w) else w)
                chars += len(text or "") + 64
                if chars >= block_chars:
                    yield flush()
        if ids:
            yield flush()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t"))
    return given.mapInArrow(run, f"block long, docs array<{kind}>, lengths array<bigint>, tokens long, places binary, table binary")


def _rebuilt(row: dict, order: int) -> Block:
    return Block(np.frombuffer(row["table"], np.uint64), unpacked(row["places"], row["tokens"]), np.array(row["lengths"], np.int64), order)


def _counts(block: Block, replies: bytes | list[tuple[int, int, bytes]]) -> np.ndarray:
    """A block's counts at each word, from the replies of the parts or from what is kept of them."""
    distinct, _ = block.distinct()
    counts = from_few_bytes(replies, len(distinct)) if isinstance(replies, bytes) else _joined(replies)
    if len(distinct) != len(counts):
        raise RuntimeError("a block's n-grams and their counts do not match")
    return block.counts(distinct, counts)


def _joined(replies: list[tuple[int, int, bytes]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[from_few_bytes(c, n) for _, n, c in replies]])


def _replies(counted: pa.Table) -> list[tuple[int, int, bytes]]:
    # without a row there is no column: a block without words has no counts
    return sorted(zip(*[counted.column(c).to_pylist() for c in ("part", "size", "counts")])) if counted.num_rows else []


def _longer(row: dict, order: int) -> tuple[np.ndarray, Block]:
    """The counts of a block's words and pairs, which are known, and the block with its longer n-grams."""
    short = _rebuilt(row, 2)
    of = _counts(short, row["seen"])
    return of, Block(short.table, short.places, short.lengths, order, 3, of[1])


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    block_chars: int = BLOCK_CHARS,
    task_tokens: int = TASK_TOKENS,
    lower: tuple[int, ...] = (),
) -> DataFrame:
    """``id_col``, ``n_tokens``, ``score`` (natural log, summed) and ``mean_score`` of every document.

    For each order in ``lower`` there are a ``score_<order>`` and a ``mean_score_<order>`` as well, from the same counts.

    Words are lower-cased runs of letters, digits and underscores. A text without words, null or empty, has no tokens,
    score 0 and no mean. Rows that share an id, null included, are scored together; repeated rows count each time. No rows:
    no rows. Other columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    blocks = checkpointed(_blocks(docs, id_col, text_col, block_chars))
    tasks = int((blocks.agg(F.sum("tokens")).first()[0] or 0) // task_tokens + 1)
    part_bits = max(LEAST_PARTS, 8 * tasks).bit_length()

    every = (order, *lower)
    if max(every) > order:
        raise ValueError("lower orders are at most the order")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                gram, n = (_longer(row, order)[1] if "seen" in row else _rebuilt(row, min(order, 2))).distinct()
                for at in range(0, len(gram), 1 << 16):
                    some = gram[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), row["block"], np.int64)), pa.array(n[at : at + (1 << 16)].astype(np.int32))], names=["gram", "block", "n"])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part and n-gram; gives each block its counts of a part in the order of its n-grams."""
        now, kept = None, []

        def flush() -> pa.RecordBatch:
            block, counts = (np.concatenate(x) for x in zip(*kept))
            by = np.argsort(block, kind="stable")
            block, counts = block[by], counts[by]
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            data = [few_bytes(c) for c in np.split(counts, edges[1:])]
            sizes = np.diff(np.r_[edges, len(block)])
            return pa.RecordBatch.from_arrays([pa.array(block[edges]), pa.array(np.full(len(edges), now, np.int64)), pa.array(sizes.astype(np.int64)), pa.array(data, pa.binary())], names=["block", "part", "size", "counts"])

        for b in batches:
            part, block, counts = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block", "c"))
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            for lo, hi in zip(edges, [*edges[1:], len(part)]):
                if part[lo] != now:
                    if kept:
                        yield flush()
                    now, kept = int(part[lo]), []
                kept.append((block[lo:hi], counts[lo:hi]))
        if kept:
            yield flush()

    def keep(counted: pa.Table) -> pa.Table:
        return pa.table([counted.column("block").slice(0, 1), pa.array([few_bytes(_joined(_replies(counted)))], pa.binary())], names=["block", "seen"])

    def score(mine: pa.Table, counted: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        if "seen" in row:
            of, block = _longer(row, order)
            of = [*of, *_counts(block, _replies(counted))]
        else:
            block = _rebuilt(row, order)
            of = _counts(block, _replies(counted))
        texts = len(block.lengths)
        sums, backs = np.zeros((len(every), texts)), np.zeros((len(every), texts), np.int64)
        for lo in range(0, len(block.starts), SLICE):
            starts = block.starts[lo : lo + SLICE]
            doc = np.searchsorted(block.ends, np.arange(lo, lo + len(starts)), side="right")
            first, last = doc[0], doc[-1] + 1
            for i, top in enumerate(every):
                open_, s = starts >= 1, np.zeros(len(starts))
                for k in range(top, 1, -1):
                    reach = open_ & (starts >= k - 1)
                    hit = np.flatnonzero(reach & (of[k - 1][lo : lo + SLICE] >= min_count))
                    s[hit] += np.log(of[k - 1][lo + hit]) - np.log(of[k - 2][lo + hit - 1])
                    open_[hit] = False
                    s[reach & open_] += np.log(ALPHA)
                s[open_] += np.log(of[0][lo : lo + SLICE][open_])
                sums[i, first:last] += np.bincount(doc - first, s, minlength=last - first)
                backs[i, first:last] += np.bincount(doc - first, open_, minlength=last - first).astype(np.int64)
        n = np.maximum(block.lengths - 1, 0)
        columns = [mine.column("docs").combine_chunks().flatten(), pa.array(n), *map(pa.array, sums), *map(pa.array, backs)]
        return pa.table(columns, names=["doc", "n", *[f"s{m}" for m in range(len(every))], *[f"b{m}" for m in range(len(every))]])

    def replies(held: DataFrame) -> DataFrame:
        rows = held.mapInArrow(explode, "gram long, block long, n int").withColumn("part", F.shiftright("gram", 64 - part_bits))
        same = Window.partitionBy("part", "gram")
        counted = rows.repartition(tasks, "part").withColumn("c", F.sum("n").over(same)).sortWithinPartitions("part", "gram").select("part", "block", "c")
        return counted.mapInArrow(to_blocks, "block long, part long, size long, counts binary")

    if order > 2:
        with shuffles_removed(docs.sparkSession):
            seen = checkpointed(replies(blocks).groupBy("block").applyInArrow(keep, "block long, seen binary"))
        blocks = blocks.join(seen, "block", "left").withColumn("seen", F.coalesce("seen", F.lit(b"")))  # none: no words
    names = [f"{c}{m}" for c in "sb" for m in range(len(every))]
    kinds = ", ".join(f"{c} {'double' if c[0] == 's' else 'long'}" for c in names)
    each = blocks.groupBy("block").cogroup(replies(blocks).groupBy("block")).applyInArrow(score, f"doc {kind}, n long, {kinds}")
    sums = checkpointed(each.groupBy("doc").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]))
    tokens = sums.agg(F.sum("n")).first()[0] or 1
    columns = []
    for m, end in enumerate(["", *[f"_{x}" for x in lower]]):
        total = F.col(f"s{m}") - F.col(f"b{m}") * F.log(F.lit(float(tokens)))
        columns += [total.alias(f"score{end}"), F.when(F.col("n") > 0, total / F.col("n")).alias(f"mean_score{end}")]
    return sums.select(F.col("doc").alias(id_col), F.col("n").alias("n_tokens"), *columns)
