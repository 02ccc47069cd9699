"""Thresholds of the baseline sentiment, chosen on one half of the rated reviews and reported on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwell.functions.numbers import percent
from fernwell.functions.polarity import polarity
from fernwell.functions.text import split_side
from fernwell.operators import evaluation as E
from fernwell.operators import labelling as L
from fernwell.operators.analytics import SENTIMENTS
from fernwell.sources.profile import Profile

PLAIN = (L.NEGATIVE_MAX, L.POSITIVE_MIN, 0.0)


def scored(data: DataFrame, profile: Profile, excluded: DataFrame | None = None) -> DataFrame:
    """``score``, ``complaints``, ``true`` and ``side`` (tune, test or excluded) of rated reviews with text."""
    rows = L.baseline_labels(data.filter("has_text and sentiment_from_rating is not null"), profile, calibration=None)
    out = rows.select("review_id", polarity(F.col("analysis_text")).alias("score"), F.size(F.filter("aspects_ai", lambda a: a["polarity"] == "negative")).alias("complaints"), F.col("sentiment_from_rating").alias("true"), split_side(F.col("review_id")).alias("side"))
    if excluded is None:
        return out
    known = excluded.select("review_id").distinct().withColumn("__out", F.lit(True))
    return out.join(known, "review_id", "left").withColumn("side", F.when(F.col("__out"), "excluded").otherwise(F.col("side"))).drop("__out")


def by_setting(rows: DataFrame, setting: tuple[float, float, float]) -> DataFrame:
    """Confusion of the rule with one setting."""
    low, high, penalty = setting
    return E.confusion(rows.withColumn("pred", L.by_score(F.col("score") - penalty * F.col("complaints"), low, high)), "true", "pred")


def describe(matrix: DataFrame) -> DataFrame:
    """Where each true class went: counts and the share of the class."""
    whole = matrix.groupBy("true").agg(F.sum("n").alias("support"))
    return matrix.join(whole, "true").select("true", "pred", "n", percent(F.col("n"), F.col("support")).alias("pct_of_class")).orderBy("true", "pred")


def calibrate(data: DataFrame, profile: Profile, excluded: DataFrame | None = None, grid: list[tuple[float, float, float]] | None = None) -> tuple[tuple[float, float, float], dict[str, DataFrame]]:
    """The best setting on the tuning half, and the sections of its report."""
    rows = scored(data, profile, excluded).persist()
    tune, test = rows.filter("side = 'tune'"), rows.filter("side = 'test'")
    ranking = E.calibrate(tune, "score", "complaints", "true", grid or E.calibration_grid())
    best = ranking.first()  # the first of the grid
    chosen = (best["negative_max"], best["positive_min"], best["penalty"]) if best else PLAIN
    matrix = by_setting(test, chosen)
    return chosen, {
        "Sides": rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).orderBy("side"),
        "Best settings": ranking.limit(10),
        "Held out": E.classification_summary(matrix, list(SENTIMENTS)),
        "Held out by class": E.class_metrics(matrix, list(SENTIMENTS)),
        "Held out confusion": describe(matrix),
        "Plain rule held out": E.classification_summary(by_setting(test, PLAIN), list(SENTIMENTS)),
    }
