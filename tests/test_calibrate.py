"""Calibration, readiness and progress over a small table."""

from fernwell.operators.labelling import by_score
from fernwell.plans import calibrate as K
from fernwell.plans import evaluate as EV
from fernwell.sources import sinks
from fernwell.sources.profile import load_profile


def reviews(spark):
    texts = [("great and lovely, works well", "Positive"), ("terrible, broken and late", "Negative"), ("it is a thing", "Neutral"), ("good but the box was broken", "Negative")]
    rows = [(str(i), texts[i % 4][0], True, texts[i % 4][1]) for i in range(80)] + [("x", None, False, None)]
    return spark.createDataFrame(rows, "review_id string, analysis_text string, has_text boolean, sentiment_from_rating string")


def test_calibration_and_its_report(spark):
    profile = load_profile(None)
    seen = spark.createDataFrame([("1",), ("2",)], "review_id string")
    chosen, sections = K.calibrate(reviews(spark), profile, seen, [(-0.3, 0.2, 0.0), (-0.05, 0.3, 0.1), (-0.05, 0.05, 0.5)])
    rows = [r for r in K.scored(reviews(spark), profile, seen).collect()]
    assert {r["side"] for r in rows} == {"tune", "test", "excluded"} and sum(r["side"] == "excluded" for r in rows) == 2 and len(rows) == 80
    sides = {r["side"]: r["n"] for r in sections["Sides"].collect()}
    assert sum(sides.values()) == 80 and chosen in [(-0.3, 0.2, 0.0), (-0.05, 0.3, 0.1), (-0.05, 0.05, 0.5)]
    held = sections["Held out confusion"].collect()
    assert sum(r["n"] for r in held) == sides["test"] and "**Product**" in sinks.labelling_guide(profile) and by_score is not None


def test_readiness_progress_and_sample(spark):
    data, profile = reviews(spark), load_profile(None)
    truth = spark.createDataFrame([(str(i), ("Positive", "Negative", "", "Awful")[i % 4], "Product", "") for i in range(40)], "review_id string, true_sentiment string, true_topic string, true_issues string")
    found = EV.progress(truth, data, profile)
    assert found["Progress"].first().asDict() == {"rows": 40, "labelled": 30, "open": 10}
    assert any(r["problem"].startswith("unknown sentiment: Awful") and r["n"] == 10 for r in found["Problems"].collect())
    said = EV.readiness(data, profile, "your-key", truth, 3.0, 15.0)
    assert said["Key"].startswith("missing") and said["Texts"] == "80 in 4 batches" and "10 warnings" in said["Hand labels"]
    assert EV.readiness(data, profile, "k-1", None, 3.0, 15.0)["Key"] == "given"
    some = EV.sample_truth(truth, 12).groupBy("true_sentiment").count().collect()
    assert {r["true_sentiment"]: r["count"] for r in some} == {"Positive": 4, "Negative": 4, "Awful": 4} and EV.sample_truth(truth, 99).count() == 30
