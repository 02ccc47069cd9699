"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

score(x) = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is computed in linear time as
half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2). Training is mini-batch Adam on the logistic loss over a bounded
sample of labelled rows (``SAMPLE_ROWS``, a parameter), the smallest by a hash of their id; scoring reads every row where
it lies, without a shuffle. Labels, language, source and ids are never features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, RANK = 4096, 4
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
HELD_OUT_FOLDS = 5
MOST_STATISTICS = 256
_KEPT_WORDS = 300_000

_KIND = np.zeros(256, np.int64)  # other
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
    _KIND[list(_chars)] = _kind
_KIND[0x80:0xC0] = 10  # inside a character


def statistics(text: str, words: list[str], metadata: list[float | None]) -> list[float]:
    """Structure statistics of a text, then the metadata numbers (null: 0) on a log scale."""
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=11).astype(float)
    chars, n = max(1.0, len(raw) - kinds[10]), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    short = sum(map(len, words)) / n
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        short,
        *(kinds[1:10] / chars),
        kinds[2] / max(1.0, kinds[1] + kinds[2]),
        kinds[6:10].sum() / n,
        distinct / n,
        pairs / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)),
        max((len(x) for x in lines), default=0) / max(1, len(text)),
        np.log1p(sum(1 for w in words if not w[-1:].isalnum()) / n),
        *(np.log1p(max(0.0, float(x or 0))) for x in metadata),
    ]


class Features:
    """Sparse rows (bucket, value) of texts; words keep their bucket in a bounded table."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        if len(self.known) >= _KEPT_WORDS:
            self.known.clear()
        b = self.known[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return b

    def row(self, text: str | None, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or ""
        words = text.split()
        known, missed = self.known.get, self._bucket
        buckets = [b if (b := known(w)) is not None else missed(w) for w in words]
        counts = np.bincount(np.array(buckets, np.int64), minlength=1)
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at])
        return at, x / max(1e-9, np.sqrt((x * x).sum())), statistics(text, words, metadata)


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray  # features
    factors: np.ndarray  # features x rank
    mean: np.ndarray
    scale: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray, stats: list[float]) -> float:
        dense = np.clip((np.asarray(stats) - self.mean) / self.scale, -5, 5) * 0.3
        i = np.concatenate([at, BUCKETS + np.arange(len(dense))])
        v = np.concatenate([x, dense])
        z = self.bias + self.weights[i] @ v
        terms = self.factors[i] * v[:, None]
        z += 0.5 * ((terms.sum(axis=0) ** 2).sum() - (terms * terms).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list[tuple[list[int], list[float], list[float]]], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 17) -> FactorisationMachine:
    """Fit on sparse rows; with one label only, or no row, the smoothed share of label 1 is scored."""
    if not rows or len(set(labels)) < 2:
        prior = (sum(labels) + 1) / (len(labels) + 2)
        size = BUCKETS + MOST_STATISTICS
        return FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(size), np.zeros((size, RANK)), np.zeros(1), np.ones(1))
    width = len(rows[0][2])
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    dense = np.clip((stats - mean) / scale, -5, 5) * 0.3
    rng = np.random.default_rng(seed)
    size = BUCKETS + width
    # column 0 holds the weights, the others the factors
    theta = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, RANK))], axis=1)
    bias, y = 0.0, np.array(labels, float)
    m1, m2, b1, b2, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            lengths = np.array([len(rows[p][0]) + width for p in pick])
            i = np.concatenate([np.concatenate([rows[p][0], BUCKETS + np.arange(width)]) for p in pick]).astype(np.int64)
            v = np.concatenate([np.concatenate([rows[p][1], dense[p]]) for p in pick])
            row = np.repeat(np.arange(len(pick)), lengths)
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            terms = theta[i] * v[:, None]
            sums = np.add.reduceat(terms, starts, axis=0)
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - np.add.reduceat((terms[:, 1:] ** 2).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
            grad_at = np.empty_like(terms)
            grad_at[:, 0] = error[row] * v
            grad_at[:, 1:] = (error[row] * v)[:, None] * (sums[row, 1:] - terms[:, 1:])
            grad = np.stack([np.bincount(i, grad_at[:, c], minlength=size) for c in range(RANK + 1)], axis=1) + decay * theta
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            theta -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            g = error.sum()
            b1, b2 = 0.9 * b1 + 0.1 * g, 0.999 * b2 + 0.001 * g * g
            bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(float(bias), theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out. A null id is in no training fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_FOLDS, F.lit(0))


def _inputs(docs: DataFrame, id_col: str, text_col: str, metadata_cols: list[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata_cols)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata_cols: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Train on at most ``sample_rows`` labelled rows outside fold 0. Null labels are left out; repeated labels are averaged."""
    metadata_cols = ["n_chars"] if metadata_cols is None else metadata_cols
    picked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("doc"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc"), "doc")
        .limit(sample_rows)
    )
    sample = {r["doc"]: r["y"] for r in picked.collect()}  # sample_rows at most
    chosen = docs.sparkSession.createDataFrame(list(sample.items()), f"doc {docs.select(id_col).schema[0].dataType.simpleString()}, y int")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            meta = [c.to_pylist() for c in b.columns[2:-1]]
            rows = [features.row(t, [m[k] for m in meta]) for k, t in enumerate(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(b.num_columns - 1), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([[float(x) for x in r[2]] for r in rows], pa.list_(pa.float64()))],
                names=["doc", "y", "at", "x", "stats"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = (
        _inputs(docs, id_col, text_col, metadata_cols)
        .join(F.broadcast(chosen), "doc")  # sample_rows at most
        .mapInArrow(featurise, f"doc {kind}, y int, at array<int>, x array<double>, stats array<double>")
        .orderBy(F.xxhash64("doc"), "doc", "at")
        .limit(sample_rows)
        .collect()
    )
    return train([(r["at"], r["x"], r["stats"]) for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", metadata_cols: list[str] | None = None) -> DataFrame:
    """``id_col`` and ``score`` of every row; null texts count as empty, repeated rows and null ids are scored too."""
    metadata_cols = ["n_chars"] if metadata_cols is None else metadata_cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            meta = [c.to_pylist() for c in b.columns[2:]]
            scores = [model.score(*features.row(t, [m[k] for m in meta])) for k, t in enumerate(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return _inputs(docs, id_col, text_col, metadata_cols).mapInArrow(run, f"doc {kind}, score double").withColumnRenamed("doc", id_col)


def keep_good(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", metadata_cols: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their own columns, read once and never shuffled."""
    metadata_cols = ["n_chars"] if metadata_cols is None else metadata_cols
    names = docs.columns
    text_at, meta_at = names.index(text_col), [names.index(c) for c in metadata_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            meta = [b.column(i).to_pylist() for i in meta_at]
            good = [model.score(*features.row(t, [m[k] for m in meta])) >= threshold for k, t in enumerate(b.column(text_at).to_pylist())]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
