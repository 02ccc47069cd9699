"""Main-text extraction by a recurrent block labeller.

Every page becomes the sequence of its leaf blocks (``html_blocks``). A bidirectional LSTM in numpy reads the sequence of
their tag-path, hashed-word and shape vectors, so that each block is judged with the whole document as context, and labels
it main text or not. The network is trained here, from a fixed seed, on pages that ``page_maker`` writes with known labels;
it is a few thousand numbers and travels with the task. Pages are labelled where they are read, without a shuffle.

Pages of like length are labelled together, as many as fill ``CELLS`` steps; a longer page is read in slices of as many,
forwards and then backwards, so that only its hidden states, 200 bytes a block, are held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwell.llm.html_blocks import DIMS, Block, BlockFeatures, blocks

HIDDEN = 24
PAGES_AT_ONCE = 64
#: Steps of the network, padding included, whose features are in memory at once.
CELLS = 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Direction:
    wx: np.ndarray  # DIMS x 4 HIDDEN: input, forget, output, candidate
    wh: np.ndarray
    b: np.ndarray

    def run(self, x: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None, tape: list | None = None):
        """Hidden states of padded sequences (steps x pages x dims) and the last state; a masked step keeps the state.

        ``tape``, if given, gets what ``back`` needs of each step.
        """
        steps, pages, _ = x.shape
        fed = x @ self.wx + self.b
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps):
            z = fed[t] + h @ self.wh
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            c_new = f * c + i * g
            s = np.tanh(c_new)
            m = mask[t][:, None]
            if tape is not None:
                tape.append((h, c, i, f, o, g, s, m))
            h, c = m * (o * s) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out, (h, c)

    def back(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of wx, wh and b."""
        steps, pages, _ = x.shape
        dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        dwh = np.zeros_like(self.wh)
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, s, m = kept[t]
            dh = dh + d_out[t]
            dh_new, dc_new = dh * m, dc * m
            dc_new = dc_new + dh_new * o * (1 - s * s)
            dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * s * o * (1 - o), dc_new * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            dwh += h.T @ dz
            dh, dc = dz @ self.wh.T + dh * (1 - m), dc_new * f + dc * (1 - m)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)]


@dataclass
class BlockLabeller:
    ahead: Direction
    behind: Direction
    wy: np.ndarray
    by: float

    def scores(self, pages: list[list[Block]], features: BlockFeatures) -> list[np.ndarray]:
        """For each page the probability of main text of each of its blocks."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            some = [order.pop()]
            while order and len(some) < PAGES_AT_ONCE and len(pages[some[0]]) * (len(some) + 1) <= CELLS:
                some.append(order.pop())
            p = self._page_scores([pages[k] for k in some], features)
            for j, k in enumerate(some):
                out[k] = p[: len(pages[k]), j]
        return out

    def _page_scores(self, pages: list[list[Block]], features: BlockFeatures) -> np.ndarray:
        steps = max(map(len, pages))
        size = max(1, CELLS // len(pages))
        slices = [(at, min(at + size, steps)) for at in range(0, steps, size)]
        z = np.full((steps, len(pages)), self.by, np.float32)
        read = lambda lo, hi: _padded([features.page(p, lo, hi) for p in pages], hi - lo)
        state, last = None, None
        for lo, hi in slices:
            last = read(lo, hi)
            h, state = self.ahead.run(*last, state)
            z[lo:hi] += h @ self.wy[:HIDDEN]
        state = None
        for lo, hi in reversed(slices):
            x, mask = last if last else read(lo, hi)
            last = None
            h, state = self.behind.run(x[::-1], mask[::-1], state)
            z[lo:hi] += h[::-1] @ self.wy[HIDDEN:]
        return _sigmoid(z)

    def forward(self, x: np.ndarray, mask: np.ndarray):
        """Probabilities, hidden states and the tapes of both directions, for training."""
        ka: list = []
        kb: list = []
        ha, _ = self.ahead.run(x, mask, tape=ka)
        hb, _ = self.behind.run(x[::-1], mask[::-1], tape=kb)
        h = np.concatenate([ha, hb[::-1]], axis=2)
        return _sigmoid(h @ self.wy + self.by), h, ka, kb


def _padded(pages: list[np.ndarray], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    steps = steps or max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 9, batch: int = 16, rate: float = 0.01, seed: int = 5) -> BlockLabeller:
    """Fit by back-propagation through time with Adam on the mean logistic loss of the blocks."""
    rng = np.random.default_rng(seed)

    def direction() -> list[np.ndarray]:
        b = np.zeros(4 * HIDDEN, np.float32)
        b[HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return [rng.normal(0, 0.08, (DIMS, 4 * HIDDEN)).astype(np.float32), rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32), b]

    theta = [*direction(), *direction(), rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    order, step = np.argsort([len(p) for p in pages], kind="stable"), 0
    groups = [order[at : at + batch] for at in range(0, len(order), batch)]
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            some = groups[k]
            net = BlockLabeller(Direction(*theta[:3]), Direction(*theta[3:6]), theta[6], float(theta[7][0]))
            x, mask = _padded([pages[j] for j in some])
            y = np.zeros_like(mask)
            for c, j in enumerate(some):
                y[: len(labels[j]), c] = labels[j]
            p, h, ka, kb = net.forward(x, mask)
            dy = ((p - y) * mask / mask.sum()).astype(np.float32)
            dh = dy[:, :, None] * net.wy
            grads = [*net.ahead.back(x, ka, dh[:, :, :HIDDEN]), *net.behind.back(x[::-1], kb, dh[::-1, :, HIDDEN:]), np.einsum("tp,tph->h", dy, h), np.array([dy.sum()], np.float32)]
            step += 1
            pace = rate * (0.3 if epoch >= epochs * 2 // 3 else 1)
            for q, g, a, b in zip(theta, grads, first, second):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return BlockLabeller(Direction(*theta[:3]), Direction(*theta[3:6]), theta[6], float(theta[7][0]))


@lru_cache(maxsize=1)
def trained(pages: int = 1000, seed: int = 21) -> BlockLabeller:
    from fernwell.llm.page_maker import make_pages

    features, xs, ys = BlockFeatures(), [], []
    for page, main in make_pages(pages, seed):
        found = blocks(page)
        if found:
            xs.append(features.page(found))
            ys.append(np.array([b.text in main for b in found], np.float32))
    return train(xs, ys)


def main_texts(pages: list[str | None], labeller: BlockLabeller, features: BlockFeatures) -> list[str]:
    found = [blocks(p) for p in pages]
    scores = labeller.scores(found, features)
    return ["\n".join([b.text for b, s in zip(bs, ss) if s >= 0.5]) for bs, ss in zip(found, scores)]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep_cols: tuple[str, ...] = ("url",), labeller: BlockLabeller | None = None) -> DataFrame:
    """``id_col``, ``keep_cols``, ``text`` and ``n_chars`` (code points) for every row of ``pages``.

    Null and empty pages, and pages without main text, give the empty text. Null ids and repeated rows are kept as they
    are. No rows: no rows. Other columns are ignored.
    """
    labeller = labeller or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = BlockFeatures()
        for b in batches:
            for at in range(0, b.num_rows, PAGES_AT_ONCE):
                part = b.slice(at, PAGES_AT_ONCE)
                texts = main_texts(part.column(part.num_columns - 1).to_pylist(), labeller, features)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"k{i}" for i in range(part.num_columns - 1)), "text", "n_chars"])

    kept = [id_col, *keep_cols]
    given = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(html_col).cast("string").alias("h"))
    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema[:-1])) + ", text string, n_chars long"
    return given.mapInArrow(run, schema).toDF(*kept, "text", "n_chars")
