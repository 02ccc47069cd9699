"""Labels against hand labels: every section of the evaluation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernwell.functions.text import parse_aspects, split_labels, to_bool
from fernwell.operators import evaluation as E
from fernwell.operators.analytics import SENTIMENTS
from fernwell.operators.labelling import estimate_cost
from fernwell.operators.model_labels import usable_key
from fernwell.sources.profile import Profile


def prepare_truth(truth: DataFrame) -> DataFrame:
    """Adds ``issues``, ``main_issue`` and ``praise`` from whichever of the three layouts the table has."""
    if "true_aspects" in truth.columns:
        aspects = parse_aspects(F.col("true_aspects"))
        issues = F.array_distinct(F.transform(F.filter(aspects, lambda a: (a["polarity"] == "negative") & a["issue"].isNotNull()), lambda a: a["issue"]))
        praise = F.array_distinct(F.transform(F.filter(aspects, lambda a: a["polarity"] == "positive"), lambda a: a["topic"]))
    elif "true_issues" in truth.columns:
        issues = split_labels(F.col("true_issues"))
        praise = split_labels(F.col("true_praise_topics")) if "true_praise_topics" in truth.columns else F.array().cast("array<string>")
    else:
        issues = F.filter(split_labels(F.col("true_issue")), lambda x: F.lower(x) != "none")
        praise = F.array().cast("array<string>")
    return truth.withColumn("issues", issues).withColumn("praise", praise).withColumn("main_issue", F.get("issues", F.lit(0)))


def evaluate(result, truth: DataFrame) -> dict[str, DataFrame]:
    """Sentiment, topic, issue, praise and flag metrics of the text labels; unlabelled truth rows are left out."""
    flags = [f for f in result.profile.flags if f"true_{f}" in truth.columns]
    known = prepare_truth(truth).filter("coalesce(true_sentiment, '') <> ''").select("review_id", "true_sentiment", "true_topic", "issues", "praise", "main_issue", *(to_bool(F.col(f"true_{f}")).alias(f"true_{f}") for f in flags))
    rows = result.data.join(known, "review_id").withColumns(
        {
            "pred_issues": F.transform(F.filter("aspects_ai", lambda a: a["polarity"] == "negative"), lambda a: a["issue"]),
            "pred_praise": F.transform(F.filter("aspects_ai", lambda a: a["polarity"] == "positive"), lambda a: a["topic"]),
        }
    )
    sentiment, topic = E.confusion(rows, "true_sentiment", "sentiment_ai"), E.confusion(rows, "true_topic", "primary_topic_ai")
    by_rating = E.confusion(rows.filter(F.col("sentiment_from_rating").isNotNull()), "true_sentiment", "sentiment_from_rating")
    weighted = E.population_weights(rows.withColumn("stratum", F.coalesce("sentiment_from_rating", F.lit("Unrated"))), result.data.filter("has_text").withColumn("stratum", F.coalesce("sentiment_from_rating", F.lit("Unrated"))), "stratum")
    return {
        "Sentiment": E.classification_summary(sentiment, list(SENTIMENTS)),
        "Sentiment by class": E.class_metrics(sentiment, list(SENTIMENTS)),
        "Sentiment confusion": sentiment,
        "Rating rule": E.classification_summary(by_rating, list(SENTIMENTS)),
        "Weighted sentiment": E.weighted_accuracy(weighted, F.col("true_sentiment") == F.col("sentiment_ai"), F.col("weight")),
        "Topic": E.classification_summary(topic, list(result.profile.taxonomy)),
        "Issues": E.multilabel_summary(rows, "issues", "pred_issues"),
        "Issues by label": E.multilabel_labels(rows, "issues", "pred_issues"),
        "Praise": E.multilabel_summary(rows, "praise", "pred_praise"),
        "Complaint": E.binary_metrics(rows, F.size("issues") > 0, F.size("pred_issues") > 0),
        **{f"Flag {f}": E.binary_metrics(rows, F.col(f"true_{f}"), F.col(f"flag_{f}")) for f in flags},
    }


def sample_truth(truth: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All labelled rows if they are ``n`` at most, else the same share of each true sentiment, by seeded hash."""
    labelled = truth.filter("coalesce(true_sentiment, '') <> ''")
    sizes = labelled.groupBy("true_sentiment").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("whole"))  # one row
    order = F.sha2(F.concat_ws("|", F.col("review_id"), F.lit(str(seed))), 256)
    nth = F.row_number().over(Window.partitionBy("true_sentiment").orderBy(order, "review_id"))
    rows = labelled.withColumn("__nth", nth).join(F.broadcast(sizes.crossJoin(whole)), "true_sentiment")  # a row for each sentiment
    return rows.filter((F.col("whole") <= n) | (F.col("__nth") <= F.rint(F.col("n") * n / F.col("whole")))).select(*truth.columns)


def progress(truth: DataFrame, data: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    """How many rows are labelled, and what is wrong with them."""
    known = prepare_truth(truth)
    problems = E.validate_truth(known.select("review_id", "true_sentiment", "true_topic", F.col("issues").alias("true_issues")), data.select("review_id"), list(SENTIMENTS), list(profile.taxonomy), profile.issue_topic)
    done = F.coalesce(F.col("true_sentiment"), F.lit("")) != ""
    return {"Progress": truth.agg(F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("labelled"), F.count_if(~done).alias("open")), "Problems": problems.groupBy("level", "problem").agg(F.count(F.lit(1)).alias("n")).orderBy("level", "problem")}


def readiness(data: DataFrame, profile: Profile, key: str | None, truth: DataFrame | None, input_price: float, output_price: float) -> dict[str, str]:
    """What a labelling run by a model would need, without a request; the key itself is never shown."""
    cost = estimate_cost(data, "analysis_text", input_price, output_price).first()  # one row
    out = {"Profile": f"{profile.name}, {len(profile.taxonomy)} topics", "Key": "given" if usable_key(key) else "missing or a placeholder", "Texts": f"{cost['reviews']} in {cost['batches']} batches", "Cost": f"{cost['cost']:.2f} at most"}
    if truth is not None:
        found = {r["level"]: r["n"] for r in progress(truth, data, profile)["Problems"].groupBy("level").agg(F.sum("n").alias("n")).collect()}  # two levels
        out["Hand labels"] = f"{found.get('error', 0)} errors, {found.get('warning', 0)} warnings"
    return out
