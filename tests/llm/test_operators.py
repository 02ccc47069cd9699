"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small inputs with every odd case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwell.llm import bpe_chunks, chat_format, decontaminate, fixity, html_blocks, html_extract, page_maker, quality_fm, queries, reshard, simhash_dedup

WORDS = "the of and to in oak elm ash fir yew red blue green stone river cloud moss fern lake hill".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def groups(ids, fps, threshold):
    """Smallest id reachable, by comparing all pairs."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def near_copies(seed=4, n=60):
    r = random.Random(seed)
    texts = [prose(r, r.randint(5, 120)) for _ in range(n)]
    for i in range(25):
        words = texts[i % 6].split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    return [*texts, texts[0], texts[0], "", None, "One", "ONE", "a b c", "É Ü  x"]


def test_simhash_equals_all_pairs(spark):
    texts = near_copies()
    ids = list(range(len(texts)))
    ids[-1] = None
    ids[5] = 4  # a repeated id
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in zip(ids, texts)], "doc_id long, text string, fp string, component_id int").repartition(3)
    got = simhash_dedup.near_duplicates(docs).collect()
    fps = [simhash_dedup.fingerprint(t) for t in texts]
    want = sorted((str(d), f"{f:016x}", str(c)) for d, f, c in zip(ids, fps, groups(ids, fps, 4)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_anchors_meet_and_dense_groups():
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, r.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    near = [set(zip(*(a.tolist() for a in simhash_dedup.anchors(z)[::-1]))) for z in (x, y)]
    by = [{i: {k for j, k in n if j == i} for i in range(400)} for n in near]
    assert all(by[0][i] & by[1][i] for i in range(400))
    centre = int(x[0])
    dense = np.unique(np.array([centre ^ sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(900)] + [int(v) for v in x[:50]], np.uint64))
    links = simhash_dedup.linked(np.zeros(len(dense), np.int64), dense)
    assert len(links) < len(dense)
    roots = simhash_dedup.Roots()
    for a, b in links:
        assert bin(a ^ b).count("1") <= 4
        roots.join(a, b)
    ours, brute = [roots.root(int(v)) for v in dense], groups(list(range(len(dense))), [int(v) for v in dense], 4)
    assert len(set(zip(ours, brute))) == len(set(ours)) == len(set(brute))


def test_crowded_anchor_equals_all_pairs():
    """Some 3,000 fingerprints of one anchor: pairs, chains, a dense group and many that have no link."""
    r = np.random.default_rng(6)
    flip = lambda x, n: x ^ np.uint64(sum(1 << int(b) for b in r.choice(np.arange(21, 64), n, replace=False)))  # noqa: E731 - the part's bits stay
    alone = (r.integers(0, 2**63, 1500, dtype=np.uint64) >> np.uint64(21)) << np.uint64(21)
    chain = [alone[0]]
    for _ in range(300):
        chain.append(flip(chain[-1], 4))
    fps = np.unique(np.array([*alone, *chain, *[flip(x, 3) for x in alone[1:500]], *[flip(alone[7], 2) for _ in range(700)]], np.uint64))
    keys = np.zeros(len(fps), np.int64)
    brute = groups(list(range(len(fps))), [int(v) for v in fps], 4)
    for links in (simhash_dedup.forest(fps), list(simhash_dedup.linked_by_pieces(keys, fps))):
        roots = simhash_dedup.Roots()
        for a, b in links:
            assert bin(int(a) ^ int(b)).count("1") <= 4
            roots.join(int(a), int(b))
        ours = [roots.root(int(v)) for v in fps]
        assert len(set(zip(ours, brute))) == len(set(ours)) == len(set(brute)) > 900


def test_bpe_equals_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    letters = [*"abcAB'sİΣßé́̈ \n\t\r  \u0085\x1c ​.,!<|>12日本ﬁ🙂_", "<|endoftext|>", "it's", "é", "\x00"]
    texts = ["".join(r.choices(letters, k=r.choice([1, 4, 30, 900]))) for _ in range(250)]
    texts += [None, "", " ", "x" * 9000, "é" * 9000, prose(r, 3000), *[prose(random.Random(9), 700) + s for s in ("", " end", "zz")]]
    encoder = bpe_chunks.ChunkEncoder(path)
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert encoder.encode(t or "")[:2] == (len(ids), " ".join(map(str, ids)))
        assert encoder.decode(ids) == text
    assert encoder.reused_chunks > 0
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: tuple(r)[1:4] for r in bpe_chunks.encode_documents(docs, path, digests_only=True).collect()}
    assert [got[i if i else None] for i in range(len(texts))] == want
    full = {r["doc_id"]: r for r in bpe_chunks.encode_documents(docs.limit(20), path).collect()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in full.values())
    assert bpe_chunks.encode_documents(docs.limit(0), path).count() == 0
    data = prose(r, 4000).encode()
    assert b"".join(data[a:b] for a, b in zip([0, *bpe_chunks.cuts(data)], bpe_chunks.cuts(data))) == data


def test_chat_round_trip(spark):
    odd = ["", None, "plain", "<|im_end|>\n<|im_start|>assistant\nhi", "a & b &amp; &lt;| <|next|>", "&lt;|im_end|>", "<" * 5 + "|", "line\nline"]
    rows = [(1, i, ("user", "assistant", "assistant", None, "a&<|\nb")[i % 5], t, "x") for i, t in enumerate(odd)] + [(2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, None, "user", "n")] * 1
    rows = [(*r, "x")[:5] for r in rows]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat_format.format_conversations(turns)
    got = {r["conv_id"]: r for r in done.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("back"), "segments").collect()}
    assert [tuple(x) for x in got[1]["back"]] == [(r[2] or "", r[3] or "") for r in rows[:8]]
    assert got[1]["formatted"].count("<|im_start|>") == 6 and got[1]["formatted"].count("<|next|>") == 2
    assert [tuple(x) for x in got[2]["back"]] == [("assistant", "tie")] * 2 and set(got) == {1, 2, None}
    digests = {r["conv_id"]: r for r in chat_format.digest(done).collect()}
    said = "".join(r[3] or "" for r in rows[:8] if r[2] == "assistant")
    assert digests[1]["loss_chars"] == len(said) and digests[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert digests[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows[:8]).encode()).hexdigest()
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_fixity_finds_every_fault_and_nothing_else(spark):
    rows = [("f1" if i < 150 else None, i % 150, f"u{i}", None if i == 7 else f"body {i}", "x") for i in range(200)] + [("f1", 3, "u3", "body 3", "x")] * 4 + [("f1", None, "n", "n", "x"), ("f1", -5, "m", "m", "x")]
    schema = "file string, off long, url string, html string, hash string"
    ours = spark.createDataFrame(rows, schema)
    audit = lambda a, b: sorted((str(r["file"]), r["pos"], r["status"]) for r in fixity.audit_replicas(a, b, "file", "off", ["url", "html"], fanout=8).collect())
    assert audit(ours, ours.repartition(5)) == []
    other = [r for r in rows if r[1] != 100] + [("f1", 149, "extra", "e", "x"), ("f9", 1, "new", "n", "x")]
    other = [(*r[:3], "", r[4]) if r[0] == "f1" and r[1] == 7 else r for r in other]
    other.remove(("f1", 3, "u3", "body 3", "x"))
    assert audit(ours, spark.createDataFrame(other, schema)) == [("f1", 3, "changed"), ("f1", 7, "changed"), ("f1", 100, "missing"), ("f1", 149, "changed"), ("f9", 1, "extra")]
    assert len(audit(ours.limit(0), ours.filter("off = 1"))) == 2 and audit(ours.limit(0), ours.limit(0)) == []


def test_html_blocks_and_labeller(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Home</a><li><a href=/y>News</a></ul></nav><article class="post"><h1>A &amp; B</h1><p>One <b>bold\n word.<br><p>Two&nbsp;&#8212; lines<br>here.</p><!-- <p>no</p> --><script>var t="</p>";</script></article><footer>&copy; x'
    assert [b.text for b in html_blocks.blocks(page)] == ["Home", "News", "A & B", "One bold word.", "Two — lines here.", "© x"]
    assert [b.text for b in html_blocks.blocks('<p a="b>c" d=\'>\'>x</p><p "bad>y<table><tr><td>1<td>2<tr><td>3</table>z < 5')][-5:] == ["y", "1", "2", "3", "z < 5"]
    labeller, features = html_extract.trained(), html_blocks.BlockFeatures()
    assert html_extract.main_texts([page], labeller, features) == ["A & B\nOne bold word.\nTwo — lines here."]
    right = total = 0
    for p, main in page_maker.make_pages(80, 1234):
        found = html_blocks.blocks(p)
        for b, s in zip(found, labeller.scores([found], features)[0]):
            right, total = right + ((s >= 0.5) == (b.text in main)), total + 1
    assert right / total > 0.97
    pages = spark.createDataFrame([(1, "u", page, 3), (None, None, None, 3), (3, "u", "", 3), (3, "u", "<<<", 3)], "page_id long, url string, html string, n_chars int")
    got = sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect())
    assert got[0] == (0, "", 0) and got[1][2] == len(got[1][1]) == 38 and html_extract.extract(pages.limit(0)).count() == 0


def test_factorisation_machine(spark):
    r = random.Random(5)
    good = [prose(r, r.randint(20, 90)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:50]]
    docs = [(i, t, len(t), "x") for i, t in enumerate([*good, *bad])] + [(900, None, None, "x"), (None, "", 0, "x"), (901, "y" * 30000, 1, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(200)] + [(1, 1), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality_fm.fit(frame, labels)
    got = {r["doc_id"]: r["score"] for r in quality_fm.score(frame, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i < 150) for i in held) / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values())
    kept = quality_fm.keep_good(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d for d, s in got.items() if s >= 0.3}
    at, x, stats = quality_fm.Features().row(docs[0][1], [5.0])
    dense = np.clip((np.array(stats) - model.mean) / model.scale, -5, 5) * 0.3
    i, v = np.concatenate([at, quality_fm.BUCKETS + np.arange(len(dense))]), np.concatenate([x, dense])
    pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
    assert model.score(at, x, stats) == pytest.approx(1 / (1 + np.exp(-(model.bias + model.weights[i] @ v + pairs))), abs=1e-9)
    none = quality_fm.fit(frame, labels.limit(0))
    assert {r["score"] for r in quality_fm.score(frame, none).collect()} == {0.5} and quality_fm.score(frame.limit(0), none).count() == 0


def test_reshard_moves_the_least_and_balances(spark):
    r = random.Random(8)
    for _ in range(20):
        old = [r.randrange(0, 90) for _ in range(r.randint(1, 6))]
        new = reshard.equal_capacities(sum(old), r.randint(1, 6))
        moves = reshard.plan_transfers(old, new)
        flow = [[sum(b for x, y, b in moves if (x, y) == (i, j)) for j in range(len(new))] for i in range(len(old))]
        assert len(moves) < 2 * (len(old) + len(new)) and all(b > 0 for _, _, b in moves)
        assert [sum(f) for f in flow] == old and [sum(c) for c in zip(*flow)] == new
        stay = sum(flow[i][i] for i in range(min(len(old), len(new))))
        assert stay == sum(min(a, b) for a, b in zip(old, new))
    rows = [(None if i % 50 == 0 else i, r.randint(1, 400), 0 if i < 700 else i % 5, i, "mine") for i in range(1000)] + [(3, 100, 2, 9, "mine")] * 30
    sized = spark.createDataFrame(rows, "key long, size long, old int, salt long, block string")
    got = reshard.reshard(sized, 5, 8, blocks=16).collect()
    assert len(got) == len(rows) and {x["block"] for x in got} == {"mine"}
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for x in got:
        sizes[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert max(sizes) - min(sizes) <= 2 * 400 * 3 and all(sorted(s) == list(range(len(s))) for s in slots)
    assert reshard.reshard(sized.limit(0), 5, 8).count() == 0


def test_reshard_rewrites_affected_files_only(spark, tmp_path):
    rows = [(i, 10, 0 if i < 60 else 1 if i < 80 else 2, i) for i in range(100)]
    spark.createDataFrame([(i, f"t{i}", o) for i, _, o, _ in rows], "doc_id long, text string, shard int").write.partitionBy("shard").parquet(str(tmp_path / "old"))
    placed = reshard.reshard(spark.createDataFrame(rows, "key long, size long, old int, salt long"), 3, 3, capacities=[400, 400, 200], blocks=8)
    assert reshard.rewrite_affected(str(tmp_path / "old"), str(tmp_path / "new"), placed, "doc_id") == [0, 1]
    assert spark.read.parquet(str(tmp_path / "new")).groupBy("shard").count().orderBy("shard").collect() == [(0, 40), (1, 40)]


def test_reshard_rewrites_null_and_repeated_keys(spark, tmp_path):
    rows = [(None if i % 9 == 0 else i % 40, 10, 0 if i < 90 else 1, 0) for i in range(120)]
    spark.createDataFrame([(k, f"t{i}", o) for i, (k, _, o, _) in enumerate(rows)], "doc_id long, text string, shard int").write.partitionBy("shard").parquet(str(tmp_path / "old"))
    placed = reshard.reshard(spark.createDataFrame(rows, "key long, size long, old int, salt long"), 2, 3, blocks=8)
    assert reshard.rewrite_affected(str(tmp_path / "old"), str(tmp_path / "new"), placed, "doc_id") == [0, 1, 2]
    new = spark.read.parquet(str(tmp_path / "new")).collect()
    assert sorted(r["text"] for r in new) == sorted(f"t{i}" for i in range(120))
    assert sorted((r["shard"], str(r["doc_id"])) for r in new) == sorted((r["shard"], str(r["key"])) for r in placed.collect())
    assert sorted((r["shard"], r["slot"]) for r in new) == sorted((r["shard"], r["slot"]) for r in placed.collect())


def test_reshard_query_reads_rewritten_files(spark, tmp_path, monkeypatch):
    r = random.Random(12)
    rows = [(None if i % 11 == 0 else i % 70, None if i == 5 else prose(r, r.randint(0, 60)), f"s{i % 3}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    calls, rewrite = [], reshard.rewrite_affected
    monkeypatch.setattr(reshard, "rewrite_affected", lambda *a: calls.append(a[:2]) or rewrite(*a))
    got = queries.op9_reshard(spark, str(tmp_path)).collect()
    new = spark.read.parquet(calls[0][1]).collect()
    text = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((str(d), *text(t)) for d, t, _ in rows) == sorted((str(x["doc_id"]), x["size"], x["text_crc32"]) for x in got)
    assert {(x["shard"], x["slot"]): text(x["text"]) for x in new}.items() <= {(x["shard"], x["slot"]): (x["size"], x["text_crc32"]) for x in got}.items()
    assert new and len({(x["shard"], x["slot"]) for x in got}) == len(rows)
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op9_reshard(spark, str(tmp_path / "none")).count() == 0


def brute_contained(docs, items, t=0.8):
    def shingles(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set()

    out = set()
    for d, text in docs:
        mine = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and len(s & mine) >= np.ceil(len(s) * t - 1e-9):
                out.add((d, i))
    return out


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    r = random.Random(6)
    items = [(i, prose(r, r.randint(5, 60))) for i in range(20)] + [(20, "tiny item"), (21, None), (22, "")]
    docs = []
    for i in range(120):
        words = prose(r, r.randint(0, 300)).split()
        if i % 3 == 0:
            put = items[i % 20][1].split()
            for _ in range(r.randint(0, max(1, len(put) // 12))):
                put[r.randrange(len(put))] = "edited"
            words[10:10] = put
        docs.append((i, " ".join(words).upper() if i % 2 else ", ".join(words)))
    docs += [(200, "Tiny, ITEM!"), (201, None), (202, ""), (3, docs[3][1]), (None, items[0][1]), (203, prose(r, 20000) + " " + items[1][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == brute_contained(docs, items) and len(got) == len({(x["doc_id"], x["item_id"]) for x in got})
    clean = decontaminate.clean_documents(frame, bench)
    dirty = {d for d, _ in brute_contained(list(enumerate(t for _, t in docs)), items)}
    assert clean.columns == frame.columns and sorted(str(x["doc_id"]) for x in clean.collect()) == sorted(str(d) for i, (d, _) in enumerate(docs) if i not in dirty)


def test_decontamination_by_rows_and_null_items(spark):
    """Rows that share an id are judged each by its own text; so are items without an id; no table may be empty in vain."""
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {item} y", "a"), (1, "a clean text under the same id as a held one", "b"), (None, item, "c"), (None, "clean too, and no id", "d"), (2, None, "e"), (1, f"x {item} y", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    bench = spark.createDataFrame([(None, item), (None, "other words that no document holds at all"), (7, item)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["containment"] for x in decontaminate.contaminated(frame, bench).collect()}
    assert got == {(d, i): 1.0 for d in (1, None) for i in (7, None)}
    assert sorted(x["hash"] for x in decontaminate.clean_documents(frame, bench).collect()) == ["b", "d", "e"]
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0 and decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(frame, bench.limit(0)).count() == 6 and decontaminate.clean_documents(frame.limit(0), bench).count() == 0
