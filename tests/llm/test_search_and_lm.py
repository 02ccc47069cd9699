"""BM25 search and back-off scores against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwell.llm import backoff_lm, bm25_search, queries

WORDS = "the of and to in oak elm ash fir yew red blue green stone river cloud".split()


def corpus(seed, n, longest=60):
    r = random.Random(seed)
    texts = [" ".join(r.choices(WORDS, weights=range(len(WORDS), 0, -1), k=r.randint(0, longest))) for _ in range(n)]
    texts += [texts[3], texts[3], "", None, "Ünïcode words, TWICE twice", " ".join(WORDS * 200)]
    return list(enumerate(texts))


def test_bm25_equals_brute_force(spark):
    rows = corpus(1, 300)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    for shard_chars in (10**9, 5_000):
        got = bm25_search.top_k(docs, F.col("doc_id") % 10 == 0, k=5, shard_chars=shard_chars).collect()
        found = {}
        for r in got:
            found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
        tf = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in rows}
        n, avg = len(rows), sum(sum(c.values()) for c in tf.values()) / len(rows)
        df = Counter(w for c in tf.values() for w in c)
        for q in (i for i, _ in rows if i % 10 == 0):
            scores = []
            for d, c in tf.items():
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in tf[q] if w in c)
                if s > 0:
                    scores.append((s, d))
            scores.sort(key=lambda x: (-round(x[0], 9), x[1]))
            best = sorted(found.get(q, []))
            assert [r for r, _, _ in best] == list(range(1, min(5, len(scores)) + 1))
            assert [round(s, 6) for _, _, s in best] == [round(s, 6) for s, _ in scores[:5]]
            exact = [d for s, d in scores[:5] if sum(abs(s - x) < 1e-7 for x, _ in scores) == 1]
            assert all(d in [x for _, x, _ in best] for d in exact)


def test_bm25_empty_and_null(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bm25_search.top_k(empty, F.col("doc_id") % 10 == 0).count() == 0
    blank = spark.createDataFrame([(0, None), (None, "a b"), (10, "a")], "doc_id long, text string")
    got = bm25_search.top_k(blank, F.col("doc_id") % 10 == 0).orderBy("rank").collect()
    assert {(r["query_id"], r["doc_id"]) for r in got} == {(10, 10), (10, None)}


def test_bm25_does_not_copy_queries_to_shards(spark, monkeypatch):
    """The bytes that a search shuffles stay the same with forty times the shards, and so do its hits."""
    monkeypatch.setattr(bm25_search, "QUERY_BYTES", 2_000, raising=False)
    rows = [(i, f"{t} n{i} m{i % 7}") for i, t in corpus(5, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    store, hits, moved = spark.sparkContext._jsc.sc().statusStore(), [], []

    def written() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    total = sum(len(t) for _, t in rows)
    for shard_chars in (10**9, total // 40):
        before = written()
        hits.append({(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bm25_search.top_k(docs, F.col("doc_id") % 2 == 0, k=3, shard_chars=shard_chars).collect()})
        moved.append(written() - before)
    assert len(hits[0]) > 500 and hits[0] == hits[1]
    assert moved[1] < 2 * moved[0]


@pytest.mark.parametrize("rows, k", [(700, 10), (700, 1), (90, 5), (3, 10)])
def test_bm25_sums_often_seen_terms_for_all_queries_at_once(monkeypatch, rows, k):
    """Hits equal a plain sum in double precision, near ties too, and few postings are read for a query."""
    read, plain = [], bm25_search._ranges
    monkeypatch.setattr(bm25_search, "_ranges", lambda starts, stops, values: (read.append(int((stops - starts).sum())), plain(starts, stops, values))[1])
    monkeypatch.setattr(bm25_search, "BATCH", 7, raising=False)
    r = np.random.default_rng(rows)
    texts = [np.unique(np.r_[r.zipf(1.3, 40) % 60, 1000 + r.integers(0, 3000, 3)]).astype(np.int64) for _ in range(rows)]
    texts[rows // 2 :] = [texts[i % 5] for i in range(rows - rows // 2)]  # copies, and lengths that single precision can't tell apart
    lengths = [200_000_000 + int(x) for x in r.integers(0, 40, rows)]
    tfs = [r.integers(1, 4, len(t)).astype(np.int32) if i < rows // 2 else np.ones(len(t), np.int32) for i, t in enumerate(texts)]
    docs = [None, *range(rows - 1, 0, -1)]
    index = bm25_search.ShardIndex(docs, lengths, [t.tobytes() for t in texts], [f.tobytes() for f in tfs], 2e8)
    queries = [*texts[:20], np.array([5_000], np.int64), np.zeros(0, np.int64)]
    weight = {t: 0.1 + float(r.random()) for t in {int(t) for q in queries for t in q}}
    weights = [np.array([weight[int(t)] for t in q]) for q in queries]
    got = list(index.top(np.array([len(q) for q in queries]), np.concatenate(queries), np.concatenate(weights), k))
    whole = 0
    for q, found in zip(queries, got, strict=True):
        scores = []
        for d, n, t, f in zip(docs, lengths, texts, tfs):
            s = 0.0
            for x, y in zip(t.tolist(), f.tolist()):
                if x in q:
                    whole, s = whole + 1, s + weight[x] * (y * 2.2 / (y + 1.2 * (0.25 + 0.75 * n / 2e8)))
            if s > 0:
                scores.append((s, d))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        assert [d for _, d in found] == [d for _, d in scores[:k]]
        assert [s for s, _ in found] == pytest.approx([s for s, _ in scores[:k]], rel=1e-13)
    assert sum(read) < 0.25 * whole


@pytest.mark.parametrize("order, min_count, sizes", [(2, 1, {}), (2, 2, {"block_chars": 3_000, "task_tokens": 500}), (3, 1, {"block_chars": 5_000}), (4, 3, {"task_tokens": 900}), (1, 1, {})])
def test_backoff_equals_brute_force(spark, order, min_count, sizes):
    rows = corpus(2, 120)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    got = {r["doc_id"]: r for r in backoff_lm.scores(docs, order=order, min_count=min_count, **sizes).collect()}
    texts = {i: re.findall(r"\w+", (t or "").lower()) for i, t in rows}
    count, total = Counter(), 0
    for w in texts.values():
        w = ["<s>", *w, "</s>"] if w else []
        total += max(0, len(w) - 1)
        for k in range(1, order + 1):
            count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    def log_score(context, word):
        if not context:
            return math.log(count[(word,)] / total)
        if count[(*context, word)] >= min_count:
            return math.log(count[(*context, word)] / count[context])
        return math.log(0.4) + log_score(context[1:], word)

    assert set(got) == set(texts)
    for i, w in texts.items():
        w = ["<s>", *w, "</s>"] if w else []
        score = sum(log_score(tuple(w[max(0, i - order + 1) : i]), w[i]) for i in range(1, len(w)))
        assert got[i]["n_tokens"] == max(0, len(w) - 1)
        assert got[i]["score"] == pytest.approx(score, abs=1e-6)
        assert (got[i]["mean_score"] is None) == (not w)


def test_backoff_empty_and_ties(spark):
    assert backoff_lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in backoff_lm.scores(twice).collect()}
    assert got == {1: 6, None: 2}


def test_backoff_query_counts_pairs_seen_once(spark, tmp_path):
    rows = [*corpus(7, 60), (900, "seen only here"), (None, "oak seen"), (None, "seen only"), (900, "oak")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in rows]
    context, two = Counter(), Counter()
    for _, w in texts:
        if w:
            context.update(["<s>", *w])
            two.update(zip(["<s>", *w], [*w, "</s>"]))
    assert any(n == 1 for n in two.values())
    want = Counter()
    for i, w in texts:
        want[i] += sum(math.log(two[pair] / context[pair[0]]) for pair in zip(["<s>", *w], [*w, "</s>"])) if w else 0
    got = {r["doc_id"]: r["score"] for r in queries.op7_backoff_lm(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_backoff_blocks_stay_within_memory():
    """Peak bytes a word and order: 72 to 74 before (n-grams with their inverse), 30 to 36 now."""
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(3)
    lengths = r.integers(0, 400, 2_000)
    places = (r.zipf(1.3, int(lengths.sum())) % 50_000).astype(np.uint32)
    table = np.sort(r.integers(1, 2**63, 50_000).astype(np.uint64))
    for order in (2, 3):
        tracemalloc.start()
        block = backoff_lm.Block(table, places, lengths, order)
        gram, n = block.distinct()
        of = block.counts(gram, n)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 48 * order * len(places)
        starts = np.concatenate([np.arange(x) for x in lengths])
        for k in range(order):
            seen = [tuple(places[i - k : i + 1]) for i in np.flatnonzero(starts >= k)]
            times = Counter(seen)
            assert of[k][starts >= k].tolist() == [times[g] for g in seen] and not of[k][starts < k].any()


def test_backoff_query_scores_by_triples(spark, tmp_path):
    """The query counts n-grams of three words too, with those that hold a pair seen once, and gives their score."""
    rows = [*corpus(8, 60), (900, "seen only here seen only here once"), (901, "oak"), (None, "oak seen only twice")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = {i: ["<s>", *w, "</s>"] if (w := re.findall(r"\w+", (t or "").lower())) else [] for i, t in rows}
    count = Counter(tuple(w[i : i + n]) for w in texts.values() for n in (1, 2, 3) for i in range(len(w) - n + 1))
    got = {r["doc_id"]: r for r in queries.op7_backoff_lm(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for i, w in texts.items():
        grams = [tuple(w[max(0, j - 2) : j + 1]) for j in range(1, len(w))]
        assert got[i]["score_3"] == pytest.approx(sum(math.log(count[g] / count[g[:-1]]) for g in grams), abs=1e-6)
        assert (got[i]["mean_score_3"] is None) == (not w)


def test_backoff_triples_of_blank_blocks(spark):
    rows = [(1, None), (2, ""), (3, "a b a b"), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_tokens"] for r in backoff_lm.scores(docs, order=3, lower=(2,), block_chars=1).collect()}
    assert got == {1: 0, 2: 0, 3: 5, 4: 3}
    assert backoff_lm.scores(docs.limit(0), order=3).count() == 0
