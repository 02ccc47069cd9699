"""The pipeline against a version in plain Python, on the smallest tables."""

import hashlib

from test_operators import brute_contained
from test_shingle_dedup import brute_kept

import corpus_pipeline
from fernwell.llm import quality_fm, queries

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality_fm.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    features = quality_fm.Features()
    good = [d for d, r in rows.items() if model.score(*features.row(r["text"], [r["n_chars"]])) >= quality_fm.THRESHOLD]
    one = [good[i] for i in brute_kept([(d, rows[d]["text"]) for d in good])]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, _ in brute_contained([(d, rows[d]["text"]) for d in one], items)}
    library = Tokenizer.from_file(queries.tokenizer_file())
    want = {}
    for d in one:
        if d not in held:
            ids = library.encode(rows[d]["text"] or "", add_special_tokens=False).ids
            want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated ids and rows, ties, a clashing column, and no rows at all."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    some = [r.asDict() for r in given.limit(12).collect()]
    odd = [*some, some[0], some[1] | {"doc_id": None}, some[2] | {"text": None}, some[3] | {"text": ""}, dict.fromkeys(given.columns), some[4] | {"doc_id": some[5]["doc_id"]}, some[6] | {"text": "word " * 30_000}]
    docs = spark.createDataFrame([(*r.values(), i) for i, r in enumerate(odd)], f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in given.schema)}, k1 int")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "encoding":
            assert out.columns == docs.columns
            left[name] = {r["k1"] for r in out.collect()}
        else:
            assert out.count() == len(odd)
    assert {0 if i == 12 else i for i in left["near_duplicates"]} == set(brute_kept([(r["doc_id"], r["text"]) for r in odd]))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert left["decontamination"] == set(range(len(odd))) - {i for i, _ in brute_contained([(i, r["text"]) for i, r in enumerate(odd)], items)}
