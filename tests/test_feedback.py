"""Ingestion, cleaning, labelling and the whole analysis on small inputs with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from fernwell.functions import numbers as N
from fernwell.functions import text as T
from fernwell.operators import analytics as A
from fernwell.operators import cleaning as C
from fernwell.operators import evaluation as E
from fernwell.operators import labelling as L
from fernwell.plans.evaluate import evaluate
from fernwell.plans.insights import generate
from fernwell.plans.pipeline import PipelineError, run_analysis
from fernwell.sources import sinks
from fernwell.sources.feedback import CleaningReport, DataValidationError, load_csv, sniff_encoding, standardize_columns
from fernwell.sources.profile import ProfileError, load_profile, normalize_header
from fernwell.sources.synthetic import dirty_feedback


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_parsers(spark):
    assert column(spark, ["4", "4.0", "4/5", "4 stars", "four", "Five Stars", "1 star", "abc", "", "N/A", "null", "4/10", "great", None], lambda c: T.parse_rating(c, 5)) == [4, 4, 4, 4, 4, 5, 1] + [None] * 7
    assert column(spark, ["35 min", "$1,234.50", "SAR 40", "-5", "none", None], T.parse_number) == [35, 1234.5, 40, -5, None, None]
    assert column(spark, ["  Great<br>food &amp; fast  ", "N/A", "<p> </p>", "&lt;b&gt;x"], T.clean_text) == ["Great food & fast", None, None, "x"]
    day = datetime.date(2025, 3, 5)
    assert column(spark, ["2025-03-05", "March 5, 2025", "05 Mar 2025", "2025-03-05 18:30:00", "03/05/2025", "not a date", None], T.parse_date) == [day] * 5 + [None] * 2
    assert column(spark, [" Runs small ;Thin; ;Runs small"], T.split_labels) == [["Runs small", "Thin"]]
    assert column(spark, ["Élan, VITAL!  x"], T.for_matching) == ["élan vital x"]
    assert column(spark, ["1.0", "Yes", "0", "maybe", None], lambda c: T.parse_outcome(c, ["1", "yes"], ["0", "no"])) == [1, 1, 0, None, None]
    assert column(spark, ["Good. But slow however cheap"], T.sentences) == [["Good.", "But slow", "cheap"]]
    assert [normalize_header(h) for h in ("  Review Text ", "Delivery-Time (min)")] == ["review_text", "delivery_time_min"]
    assert sniff_encoding("naïve".encode()) == "UTF-8" and sniff_encoding(b"na\xefve") == "windows-1252"


def test_keywords_and_bands(spark):
    fee = T.keyword_regex(["fee", "return", "doesn't work"])
    assert column(spark, ["fees", "feelings", "Returned", "it doesn't work"], lambda c: c.rlike(fee)) == [True, False, True, True]
    bins, names = [0, 30, 45], ["a", "b"]
    assert column(spark, [0.0, 30.0, 31.0, 45.0, 46.0, None], lambda c: T.band(c, bins, names), "double") == ["a", "a", "b", "b", None, None]
    assert column(spark, [0.0, 30.0, 45.0], lambda c: T.band(c, bins, names, "left"), "double") == ["a", "b", None]


def test_statistics(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert tuple(get(N.wilson(F.lit(50), F.lit(100)))) == (40.4, 59.6)
    assert get(N.wilson(F.lit(0), F.lit(0))) is None
    assert get(N.two_proportion_p(F.lit(10.0), F.lit(1000), F.lit(10.0), F.lit(1000))) == 1.0
    assert get(N.two_proportion_p(F.lit(10.0), F.lit(1000), F.lit(20.0), F.lit(1000))) < 0.001
    assert get(N.two_proportion_p(F.lit(10.0), F.lit(0), F.lit(20.0), F.lit(1000))) is None
    assert get(N.erfc(F.lit(0.5))) == pytest.approx(0.4795001, abs=1e-6)
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p double")
    assert [r["q_value"] for r in A.benjamini_hochberg(p, "p").orderBy("i").collect()] == [0.02, 0.04, 0.04, 0.02]
    xy = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "x double, rating double")
    assert A.spearman(xy, "x").first()["rho"] == 1.0


def test_multilabel_and_weights(spark):
    rows = spark.createDataFrame([(["A", "B"], ["A"]), ([], ["B"]), (["C"], ["C"])], "t array<string>, p array<string>")
    got = E.multilabel_summary(rows, "t", "p").first()
    assert (got["micro_f1"], got["exact_pct"]) == (0.667, 33.3)
    yes = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "t boolean, p boolean")
    b = E.binary_metrics(yes, F.col("t"), F.col("p")).first()
    assert (b["accuracy"], b["precision"], b["recall"], b["f1"]) == (50.0, 0.5, 0.5, 0.5)
    assert L.allocate(1000, {"Negative": 1000, "Neutral": 1000, "Positive": 8000}, L.ALLOCATION) == {"Negative": 500, "Neutral": 250, "Positive": 250}
    assert L.allocate(1000, {"Negative": 100, "Neutral": 3000, "Positive": 6900}, L.ALLOCATION) == {"Negative": 100, "Neutral": 450, "Positive": 450}
    population = spark.createDataFrame([(i, "neg" if i < 100 else "pos") for i in range(1000)], "id long, s string")
    sample = population.filter("id < 50 or id >= 950")
    assert {(r["s"], r["weight"]) for r in E.population_weights(sample, population, "s").collect()} == {("neg", 2.0), ("pos", 18.0)}
    assert len(E.calibration_grid()) > 500


CSV = """id,review,stars,created_at,product,channel
1,"Broken, and support was no help.",1,2025-01-05,Lamp,web
1,"Great product, works well. Easy to use.",five,2025-03-06,lamp ,web
,Great product works well easy to use,5/5,"March 7, 2025",Lamp,shop
7,"Great product works well, easy to use!",5,2025-03-06,Lamp,shop
8,N/A,abc,2025-02-01,Chair,shop
9,,4.5,2031-01-01,Chair,shop
1,"Broken, and support was no help.",1,2025-01-05,Lamp,web
"""


def test_clean_and_analyse(spark):
    result = run_analysis(spark, CSV.encode(), reference_date="2026-06-30")
    report = result.report
    assert report.rows_received == 7 and report.rows_received - report.rows_removed == report.rows_retained
    assert report.removed["Exact duplicate row"] == 1 and report.removed["No review text and no valid rating"] == 1
    assert report.flagged["Future or implausible date (cleared)"] == 1 and report.flagged["Fractional rating rounded to whole star"] == 1
    rows = {r["review_id"]: r for r in result.data.collect()}
    assert "1_dup1" in rows and "gen_000001" in rows and rows["9"]["rating"] == 5.0
    assert {r["product"] for r in rows.values()} == {"Lamp", "Chair"}
    assert rows["1"]["issue_ai"] == "Defective or broken" and rows["1"]["sentiment"] == "Negative"
    trend = {str(r["month"]): r["reviews"] for r in result.table("trend").collect()}
    assert trend["2025-02-01"] == 0 and trend["2025-01-01"] == 1
    topics = {r["topic"]: r for r in result.table("topics").collect()}
    assert topics["Product"]["reviews_complaint"] == 1
    only = result.filtered({"channel": "web"})
    assert only.data.count() == 2 and result.data.count() == report.rows_retained
    with pytest.raises(PipelineError):
        result.filtered({"nope": 1})
    for t in result.tables.values():
        if t.available:
            t.frame().collect()
        else:
            assert t.reason
    assert all(i.table in result.tables for i in generate(result))


def test_errors(spark):
    with pytest.raises(DataValidationError):
        run_analysis(spark, b"a,b\n1,2\n")
    with pytest.raises(DataValidationError):
        load_csv(spark, b"")
    with pytest.raises(PipelineError):
        run_analysis(spark, CSV.encode(), labelling="ai")
    with pytest.raises(ProfileError) as e:
        load_profile({"name": "x", "taxonomy": {"A": {}}, "rating_scale": {"negative_max": 4, "positive_min": 3}})
    assert "Other" in str(e.value) and "rating_scale" in str(e.value) and "no issues" in str(e.value)


def test_path_csv_and_headers(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text(",Clothing ID,Review Text,Review Text\n0,7,good,again\n1,,#N/A,\n", encoding="utf-8-sig")
    loaded = load_csv(spark, str(p))
    report = CleaningReport()
    named = standardize_columns(loaded, report, load_profile({"name": "a", "taxonomy": {"Other": {"Other": "x"}}, "columns": {"unnamed_0": "review_id", "clothing_id": "product_id"}, "entity": {"column": "product_id"}}))
    assert named.columns[:3] == ["review_id", "product_id", "review_text"] and report.row_number_columns == ["review_id"]
    assert named.filter("review_text is null").count() == 1


def test_sampling_weights(spark):
    rows = [(f"r{i}", True, "Negative" if i < 100 else "Neutral" if i < 200 else "Positive") for i in range(1000)]
    d = spark.createDataFrame(rows, "review_id string, has_text boolean, sentiment_from_rating string")
    s = L.sample_with_weights(d, 100)
    got = {r["s"]: (r["n"], r["w"]) for r in s.groupBy(F.col("sentiment_from_rating").alias("s")).agg(F.count("*").alias("n"), F.sum("sample_weight").alias("w")).collect()}
    assert got == {"Negative": (50, 100.0), "Neutral": (25, 100.0), "Positive": (25, 800.0)}


def test_model_labels_fall_back(spark):
    profile = load_profile()
    d = spark.createDataFrame([("a", "It broke."), ("b", "skip me"), ("c", None)], "review_id string, analysis_text string").withColumn("has_text", F.col("analysis_text").isNotNull())

    def client(pairs):
        if any(t == "skip me" for _, t in pairs):
            raise RuntimeError("too much")
        return {i: {"sentiment": "Negative", "primary_topic": "nope", "aspects": [{"topic": "x", "polarity": "negative", "issue": "Late delivery"}] * 2, "confidence": "sure"} for i, _ in pairs}

    got = {r["review_id"]: r for r in L.label_with(d, client, profile).collect()}
    assert got["a"]["label_source"] == "ai" and got["a"]["primary_topic_ai"] == "Delivery" and len(got["a"]["aspects_ai"]) == 1 and got["a"]["confidence_ai"] == "medium"
    assert got["b"]["label_source"] == "baseline_fallback" and got["c"]["label_source"] == "no_text"


def test_synthetic_end_to_end(spark, tmp_path):
    data = dirty_feedback(spark, 400)
    result = run_analysis(spark, data, reference_date="2026-12-31")
    assert result.report.removed["Exact duplicate row"] > 0 and result.report.removed["Re-submitted review"] > 0
    assert "issue_priority" in sinks.write_tables(result, str(tmp_path / "t"), "parquet")
    sinks.save_labels(result.data, str(tmp_path / "labels"))
    assert sinks.load_labels(result.data.select("review_id", "has_text"), str(tmp_path / "labels")).filter("label_source = 'baseline'").count() > 300
    truth = result.data.filter("has_text").limit(50).select("review_id", F.col("sentiment_ai").alias("true_sentiment"), F.col("primary_topic_ai").alias("true_topic"), F.concat_ws(";", F.transform(F.filter("aspects_ai", lambda a: a["polarity"] == "negative"), lambda a: a["issue"])).alias("true_issues"))
    sections = evaluate(result, truth)
    assert sections["Sentiment"].first()["accuracy"] == 100.0 and sections["Issues"].first()["exact_pct"] == 100.0
    faults = E.validate_truth(spark.createDataFrame([("zz", "negative", "", ["nope"])], "review_id string, true_sentiment string, true_topic string, true_issues array<string>"), result.data, ["Positive", "Neutral", "Negative"], list(result.profile.taxonomy), result.profile.issue_topic)
    assert any("did you mean Negative" in r["problem"] for r in faults.collect()) and faults.count() == 4


def test_truncation(spark):
    cut = [("x" * 490 + f"{i:05d}",) for i in range(25)] + [("short.",)]
    d = C.truncation(spark.createDataFrame(cut, "review_text string"))
    assert d.filter("text_truncated").count() == 25
    assert C.truncation(spark.createDataFrame([("fine text.",)] * 30, "review_text string")).filter("text_truncated").count() == 0


def test_stream(spark, tmp_path):
    from fernwell.streaming.live import windowed_metrics

    rows = [(datetime.datetime(2025, 1, d), 1.0 if d % 2 else 5.0, "Negative" if d % 2 else "Positive") for d in range(1, 21)]
    spark.createDataFrame(rows, "ts timestamp, rating double, sentiment string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, rating double, sentiment string").parquet(str(tmp_path / "in"))
    q = windowed_metrics(stream, "ts", window="10 days").writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(reviews) from live").first()[0] == 20


def test_encodings_by_path(spark, tmp_path):
    from fernwell.sources.feedback import load_csv

    head = "review_text,rating\r\n" + "plain,5\r\n" * 9000  # more than the head that is sniffed
    (tmp_path / "a.csv").write_bytes(("review_text,rating\r\n“curly” – 5 €,5\r\n").encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(head.encode() + "late é €,4\r\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(("\ufeff" + head).encode() + "übrig €,4\r\n".encode())
    texts = {n: {r["review_text"] for r in load_csv(spark, str(tmp_path / n)).select("review_text").distinct().collect()} for n in ("a.csv", "b.csv", "c.csv")}
    assert texts == {"a.csv": {"“curly” – 5 €"}, "b.csv": {"plain", "late é €"}, "c.csv": {"plain", "übrig €"}}
    assert load_csv(spark, str(tmp_path / "c.csv"), multi_line=False).count() == 9001


def test_references_are_looked_up_without_parsing_their_table(spark):
    """Every reference gives its sign, and the table of names is one literal of the plan, not a text read for each reference."""
    from html.entities import name2codepoint

    said = {f"a&{n};b": f"a{chr(c)}b" for n, c in name2codepoint.items()} | {"&#x41;&#X42;&#67;": "ABC", "&#0128;&#x9F;": "€Ÿ", "&#129;": "\x81", "&#0;&#xD800;&#1114112;": "�" * 3, "&amp;lt;&apos;&no;": "&lt;'&no;", "&#;&amp": "&#;&amp"}
    assert column(spark, list(said), T.unescape) == list(said.values())
    rows = spark.createDataFrame([("&lt;",)], "v string").select(T.unescape(F.col("v")).alias("x"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "str_to_map" not in plan
