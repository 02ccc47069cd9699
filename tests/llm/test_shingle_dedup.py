"""The pipeline's near-copy stage against all pairs."""

import random

import pytest

import corpus_pipeline
from fernwell.llm import shingle_dedup


def brute_kept(rows):
    """Indexes of the rows kept, by comparing all pairs of shingle sets."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if r not in best or d is not None and (rows[best[r]][0] is None or d < rows[best[r]][0]):
            best[r] = i
    return sorted(best.values())


def edited(r, text, edits):
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("chunk", [shingle_dedup.CHUNK, 7])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, chunk):
    monkeypatch.setattr(shingle_dedup.keep_one, "__defaults__", ("doc_id", "text", chunk))
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(60, 400))) for _ in range(12)]
    texts = [*base, *[edited(r, base[i % 12], r.randint(1, 12)) for i in range(120)], *[edited(r, base[0], 2) for _ in range(60)]]
    texts += ["a b c", "A  b c", "a b d", "", None, "one"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, "another text under an id that is taken"), (None, "no id at all, but a text of its own"), (None, texts[20]), (None, texts[3])]
    docs = spark.createDataFrame([(d, t, i, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_chars int, k1 int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x["n_chars"] for x in kept.collect()) == brute_kept(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_only_bands_tell_near_copies_beyond_four_bits(spark):
    """Edits that leave 0.8 and more of the shingles but change more bits than anchors reach."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(40):
        base = " ".join(r.choices(words, k=200))
        rows += [(2 * g, base), (2 * g + 1, edited(r, base, 4))]
    far = sum(bin(shingle_dedup.simhash(shingle_dedup.shingles(a[1])) ^ shingle_dedup.simhash(shingle_dedup.shingles(b[1]))).count("1") > 4 for a, b in zip(rows[::2], rows[1::2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert far >= 10
    assert sorted(x["doc_id"] for x in shingle_dedup.keep_one(docs).collect()) == [rows[i][0] for i in brute_kept(rows)]


def test_rows_alike_in_all_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x")] * 3 + [(None, "a b c d e f", "y"), (2, None, "z"), (2, "", "w"), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string").withColumnRenamed("root", "fp")
    got = shingle_dedup.keep_one(docs)
    assert got.columns == ["doc_id", "text", "fp"]
    kept = [tuple(x) for x in got.collect()]
    assert kept[0][:1] != kept[1][:1] and len(kept) == 2 and (1, "a b c d e f", "x") in kept
