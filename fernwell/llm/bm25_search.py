"""Exact BM25 top-k over sharded inverted indexes, many queries at a time.

Rows are dealt by hash into shards of bounded text. A query's terms are of two kinds in a shard: the often seen, those of
at least ``OFTEN`` of its rows, and the rest. For a batch of queries:

1. The parts that often seen terms add lie in a matrix of terms and rows, in single precision. One matrix product with the
   queries' weights sums them for all queries and rows. They are a few hundred terms, but most of the postings to read.
2. The rest have posting lists, which are read for each query and added.
3. That sum is within a known share of the score, as nothing in it is negative. Rows whose sum is below the k-th best by
   more than that share can't be hits. The others, hardly more than k, are scored exactly.

Block-max WAND, used before, still read 0.79 of the postings, as whole documents are the queries and their bounds are loose.
Scores use the global row count, document frequencies and average length, and each row's terms are added in one order, in
double precision, so each shard's top k are exact, ties included, and so is their merge.

Queries are packed and dealt into parts of bounded bytes, written once. A task joins a group of shards with one part by a
Cartesian product of partitions, which reads the part where it lies: no copy of a query is made for a shard. As many shards
make a group as there are parts, so tasks and the hits they send on grow with the input, not with its square; what does is
the search itself, and the reading for it. A task holds one shard's index and one part at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwell.llm.common import checkpointed

K1, B = 1.2, 0.75
SHARD_CHARS = 40_000_000
#: Bytes of the queries that a task holds, and terms of the queries in one row.
QUERY_BYTES, ROW_TERMS = 64_000_000, 100_000
#: Terms of this share of a shard's rows are often seen: two such terms meet often enough for a matrix product to be cheaper.
OFTEN = 0.05
#: Cells of the matrix of often seen terms, terms in it, cells of a batch's sums, and queries in a batch.
TERM_CELLS, OFTEN_TERMS, SUM_CELLS, BATCH = 1 << 25, 4096, 1 << 23, 128
#: The k-th best of the maxima of this many rows each is a first bound of the k-th best row.
GROUP = 64
_WORD = re.compile(r"\w+")
_KEPT_WORDS = 300_000


class Terms:
    """Words of a text as 64-bit hashes; hashes of recent words are kept in a bounded table."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        import xxhash

        if len(self.known) >= _KEPT_WORDS:
            self.known.clear()
        h = self.known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        return h

    def of(self, text: str | None) -> np.ndarray:
        known, missed = self.known.get, self._hash
        return np.array([h if (h := known(w)) is not None else missed(w) for w in _WORD.findall((text or "").lower())], np.int64)


def postings(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """``shard``, ``doc``, ``len`` and the packed distinct ``terms`` (long) and counts ``tfs`` (int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lengths, packed, counts = [], [], []
                for text in part.column(2).to_pylist():
                    words = terms.of(text)
                    t, n = np.unique(words, return_counts=True)
                    lengths.append(len(words)), packed.append(t.tobytes()), counts.append(n.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lengths, pa.int64()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], names=["shard", "doc", "len", "terms", "tfs"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.col(text_col).cast("string")
    shard = F.pmod(F.xxhash64(id_col, F.length(text)), F.lit(shards)).cast("int")
    return docs.select(shard.alias("shard"), F.col(id_col).alias("doc"), text.alias("t")).mapInArrow(run, f"shard int, doc {kind}, len long, terms binary, tfs binary")


class ShardIndex:
    def __init__(self, docs: list, lengths: list[int], terms: list[bytes], tfs: list[bytes], average: float) -> None:
        self.docs = docs
        sizes = np.array([len(t) // 8 for t in terms], np.int64)
        # by row: each row's terms in rising order, and what each adds before its weight
        self.row_start = np.r_[0, np.cumsum(sizes)]
        self.terms, place = np.unique(np.frombuffer(b"".join(terms), np.int64), return_inverse=True)
        self.row_term = place.astype(np.int32)
        del place
        row = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        tf = np.frombuffer(b"".join(tfs), np.int32).astype(np.float64)
        norm = K1 * (1 - B + B * np.array(lengths, np.float64) / max(average, 1e-9))
        self.row_part = tf * (K1 + 1) / (tf + norm[row])
        del tf
        # by term: the often seen in a matrix, the others as postings in order of rows
        seen = np.bincount(self.row_term, minlength=len(self.terms))
        often = np.flatnonzero(seen >= max(OFTEN * len(docs), 1))
        often = often[np.argsort(-seen[often], kind="stable")][: min(OFTEN_TERMS, TERM_CELLS // max(len(docs), 1))]
        self.place = np.full(len(self.terms), -1, np.int32)
        self.place[often] = np.arange(len(often), dtype=np.int32)
        self.often = np.zeros((len(often), len(docs)), np.float32)
        at = self.place[self.row_term]
        dense = np.flatnonzero(at >= 0)
        self.often[at[dense], row[dense]] = self.row_part[dense]
        rest = np.flatnonzero(at < 0)
        del at, dense
        rest = rest[np.argsort(self.row_term[rest], kind="stable")]
        self.row, self.part = row[rest].astype(np.int64), self.row_part[rest]
        seen[often] = 0
        self.start = np.r_[0, np.cumsum(seen)].astype(np.int64)
        self.weight, self.asked = np.zeros(len(self.terms)), np.zeros(len(self.terms), bool)
        #: A sum of the batch is at least this share of a sum whose score is not higher: each of the two is a sum of rounded
        #: products of rounded factors, off by a half unit in the last place for each of them.
        self.close = 1 - 4 * (len(often) + 16) * 2.0**-24

    def _exact(self, rows: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of rows; every row's terms are added in the order of their hashes."""
        self.weight[at], self.asked[at] = weights, True
        spans = [slice(a, b) for a, b in zip(self.row_start[rows].tolist(), self.row_start[rows + 1].tolist())]
        terms = np.concatenate([self.row_term[x] for x in spans])
        hit = np.flatnonzero(self.asked[terms])
        of = np.repeat(np.arange(len(rows)), [x.stop - x.start for x in spans])[hit]
        scores = np.bincount(of, self.weight[terms[hit]] * np.concatenate([self.row_part[x] for x in spans])[hit], minlength=len(rows))
        self.asked[at] = False
        return scores

    def top(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> Iterator[list[tuple[float, object]]]:
        """For each query, of so many of the terms and weights, the k best (score, doc) by score, then doc (null last).

        Rows without a query term are no hits.
        """
        batch = max(1, min(BATCH, SUM_CELLS // max(len(self.docs), 1)))
        ends = np.cumsum(sizes)
        for lo in range(0, len(sizes), batch):
            begin, end = ends[lo] - sizes[lo], ends[min(lo + batch, len(sizes)) - 1]
            yield from self._batch(sizes[lo : lo + batch], terms[begin:end], weights[begin:end], k)

    def _batch(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> Iterator[list[tuple[float, object]]]:
        if not len(self.terms):
            yield from ([] for _ in sizes)
            return
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        held = np.flatnonzero(self.terms[at] == terms)
        of, at, weights = np.repeat(np.arange(len(sizes)), sizes)[held], at[held], weights[held]
        place = self.place[at]
        asked = np.zeros((len(sizes), len(self.often)), np.float32)
        often = place >= 0
        asked[of[often], place[often]] = weights[often]
        sums = asked @ self.often
        cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
        for s, lo, hi in zip(sums, cuts[:-1], cuts[1:]):
            rest = lo + np.flatnonzero(~often[lo:hi])
            places, w = _ranges(self.start[at[rest]], self.start[at[rest] + 1], weights[rest])
            s += np.bincount(self.row[places], w * self.part[places], minlength=len(s))
            rows = self._near(s, k)
            scores = self._exact(rows, at[lo:hi], weights[lo:hi]).tolist() if len(rows) else []
            yield sorted(((x, self.docs[r]) for x, r in zip(scores, rows.tolist())), key=lambda x: (-x[0], x[1] is None, x[1]))[:k]

    def _near(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k best sums, and those that are as good but for rounding."""
        groups, least = len(sums) // GROUP, 0.0
        if groups >= k:
            least = np.partition(sums[: groups * GROUP].reshape(GROUP, groups).max(axis=0), groups - k)[groups - k]
        rows = np.flatnonzero(sums >= least) if least > 0 else np.flatnonzero(sums)
        if len(rows) <= k and not least > 0:
            return rows
        kth = np.partition(sums[rows], len(rows) - k)[len(rows) - k]
        return np.flatnonzero(sums >= float(kth) * self.close)


def _ranges(starts: np.ndarray, stops: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges one after the other, and the value of each position's range."""
    n = stops - starts
    total = int(n.sum())
    return np.arange(total) + np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n), np.repeat(values, n)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many queries: their ids, their numbers of terms, and the terms and weights one after the other."""
    for b in batches:
        sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = (np.cumsum(sizes) - sizes) // ROW_TERMS
        cuts = [*np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)] if len(row) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            ids, terms, weights = (c.slice(lo, hi - lo) for c in b.columns)
            columns = [
                pa.ListArray.from_arrays([0, hi - lo], ids),
                pa.array([sizes[lo:hi].tolist()], pa.list_(pa.int32())),
                pa.array([terms.flatten().to_numpy().tobytes()], pa.binary()),
                pa.array([weights.flatten().to_numpy().tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["queries", "sizes", "qt", "qw"])


def top_k(docs: DataFrame, is_query: Column, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``query_id``, ``rank``, ``doc`` and ``score``: the k best rows for each row that ``is_query`` picks, itself included.

    A query is the set of distinct words of its whole text; rows that share a query's id are one query. Terms have weight
    ln(1 + (N - df + 0.5) / (df + 0.5)). Ties go to the smaller id, null last. Null and empty texts hit nothing and, as
    queries, have no hits and no rows. Repeated rows are rows. No rows: no rows. Other columns are ignored.
    """
    total = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    shards = int(total // shard_chars + 1)
    rows = checkpointed(postings(docs, shards, id_col, text_col))
    count, words = rows.agg(F.count("*"), F.sum("len")).first()
    average = (words or 0) / max(count, 1)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a batch's sums first, then the task's are left to the aggregation
            t, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n.astype(np.int64))], names=["term", "n"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.frombuffer(t, np.int64) for t in b.column(1).to_pylist()]
            query = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(p) for p in packed])))
            yield pa.RecordBatch.from_arrays([query, pa.array(np.concatenate(packed) if packed else np.zeros(0, np.int64))], names=["query", "term"])

    kind = rows.schema["doc"].dataType.simpleString()
    df = rows.select("terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    asked = rows.withColumnRenamed("doc", id_col).filter(is_query).select(id_col, "terms").mapInArrow(spread, f"query {kind}, term long").distinct()
    weighed = asked.join(df, "term").select("query", "term", F.log(1 + (count - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w"))
    asked_terms = weighed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("ts")).select("query", F.col("ts.term").alias("qt"), F.col("ts.w").alias("qw"))
    queries = checkpointed(asked_terms.mapInArrow(_packed, f"queries array<{kind}>, sizes array<int>, qt binary, qw binary"))
    parts = int((queries.agg(F.sum(F.octet_length("qt"))).first()[0] or 0) * 2 // QUERY_BYTES + 1)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    part = queries.coalesce(parts).withColumn("first", first)
    groups = -(-shards // parts)
    # a shard's rows, then its end: a row meets the first row of the part alone, the end meets all of them
    index = rows.select("shard", F.lit(0).alias("stage"), "doc", "len", "terms", "tfs")
    ends = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(1).alias("stage"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("doc", "len", "terms", "tfs")])
    dealt = index.unionByName(ends).withColumn("group", F.col("shard") % groups).repartitionByRange(groups, "group").sortWithinPartitions("shard", "stage")
    # the place keeps the optimizer from taking out a sort below a join
    dealt = dealt.select("shard", "stage", "doc", "len", "terms", "tfs", F.monotonically_increasing_id().alias("place"))
    at_end = F.col("stage") == 1
    met = dealt.hint("shuffle_replicate_nl").join(part, at_end | F.col("first"))
    met = met.select("shard", "stage", "doc", "len", "terms", "tfs", *[F.when(at_end, F.col(c)).alias(c) for c in ("queries", "sizes", "qt", "qw")], "place")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, ready = None, ([], [], [], []), None
        for b in batches:
            query_ids, doc_ids, scores = [], [], []
            part, stage = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (stage[1:] != stage[:-1])]) if len(part) else []
            for lo, hi in zip(edges, [*edges[1:], len(part)]):
                piece = b.slice(lo, hi - lo)
                if part[lo] != shard:
                    shard, waiting, ready = part[lo], ([], [], [], []), None
                if stage[lo] == 0:
                    if ready is not None:
                        raise RuntimeError("rows of a shard came after its queries")
                    for kept, c in zip(waiting, piece.columns[2:6]):
                        kept.extend(c.to_pylist())
                    continue
                if ready is None:
                    ready, waiting = ShardIndex(*waiting, average), ([], [], [], [])
                for ids, sizes, t, w in zip(*(c.to_pylist() for c in piece.columns[6:10])):
                    for q, best in zip(ids, ready.top(np.array(sizes, np.int64), np.frombuffer(t, np.int64), np.frombuffer(w, np.float64), k)):
                        for s, d in best:
                            query_ids.append(q), doc_ids.append(d), scores.append(s)
            of_kind = b.schema.field(2).type
            yield pa.RecordBatch.from_arrays([pa.array(query_ids, of_kind), pa.array(doc_ids, of_kind), pa.array(scores, pa.float64())], names=["query_id", "doc", "score"])

    found = met.mapInArrow(search, f"query_id {kind}, doc {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("doc").alias(id_col), "score")
