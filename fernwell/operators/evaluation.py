"""Label quality: confusion, binary and multi-label metrics, agreement, population weights, truth checks, calibration.

Each metric is computed from one small contingency table that one aggregation makes; nothing is collected on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwell.functions.numbers import half_even, percent, ratio, wilson
from fernwell.operators.analytics import Scale

NONE = "(none)"


def confusion(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Counts by (true, predicted); rows without truth are dropped, no prediction is ``(none)``."""
    return df.filter(F.col(true_col).isNotNull()).groupBy(F.col(true_col).alias("true"), F.coalesce(F.col(pred_col), F.lit(NONE)).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def class_metrics(matrix: DataFrame, labels: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 (3 decimals) and support of every label, from a confusion table."""
    every = matrix.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (F.col("true") == x).alias("t"), (F.col("pred") == x).alias("p")) for x in labels])).alias("x"))
    sums = every.groupBy(*keys, F.col("x.label").alias("label")).agg(
        F.sum(F.when(F.col("x.t") & F.col("x.p"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.p"), F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(F.col("x.t"), F.col("n")).otherwise(0)).alias("support")
    )
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return sums.select(*keys, "label", half_even(p, 3).alias("precision"), half_even(r, 3).alias("recall"), half_even(f1(p, r), 3).alias("f1"), "support")


def classification_summary(matrix: DataFrame, labels: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy with its Wilson interval, and the mean of the supported labels' rounded F1."""
    right = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    totals = matrix.groupBy(*keys).agg(F.sum("n").alias("n"), right.alias("correct"))
    macro = class_metrics(matrix, labels, keys).filter("support > 0").groupBy(*keys).agg(half_even(F.avg("f1"), 3).alias("macro_f1"))
    both = totals.join(macro, list(keys), "left") if keys else totals.crossJoin(F.broadcast(macro))  # one row each
    w = wilson(F.col("correct"), F.col("n"))
    return both.select(*keys, "n", percent(F.col("correct"), F.col("n")).alias("accuracy"), w["low"].alias("ci_low"), w["high"].alias("ci_high"), "macro_f1")


def binary_metrics(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    """Accuracy, precision, recall (with its interval) and F1 of yes/no labels; rows without either are dropped."""
    rows = df.select(true.alias("t"), pred.alias("p")).filter(F.col("t").isNotNull() & F.col("p").isNotNull())
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in (("tp", F.col("t") & F.col("p")), ("fp", ~F.col("t") & F.col("p")), ("fn", F.col("t") & ~F.col("p")), ("tn", ~F.col("t") & ~F.col("p")))))
    c = F.col
    p = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(0.0)
    r = F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn"))).otherwise(0.0)
    w = wilson(c("tp"), c("tp") + c("fn"))
    return sums.select("n", percent(c("tp") + c("tn"), c("n")).alias("accuracy"), half_even(p, 3).alias("precision"), half_even(r, 3).alias("recall"), half_even(f1(p, r), 3).alias("f1"), w["low"].alias("recall_low"), w["high"].alias("recall_high"))


def multilabel_labels(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """tp, fp, fn and F1 of each label of two array columns."""
    t, p = F.coalesce(F.array_distinct(true_col), F.array()), F.coalesce(F.array_distinct(pred_col), F.array())
    each = df.select(t.alias("t"), p.alias("p")).select(F.explode(F.array_union("t", "p")).alias("label"), "t", "p")
    marks = each.select("label", F.array_contains("t", F.col("label")).alias("t"), F.array_contains("p", F.col("label")).alias("p"))
    sums = marks.groupBy("label").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    c = F.col
    return sums.select("label", "tp", "fp", "fn", half_even(2 * c("tp") / (2 * c("tp") + c("fp") + c("fn")), 3).alias("f1"), (c("tp") + c("fn")).alias("support")).orderBy(F.desc("support"), "label")


def multilabel_summary(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Micro and macro F1 and the share of rows whose sets agree exactly."""
    c = F.col
    t, p = F.coalesce(F.array_distinct(true_col), F.array()), F.coalesce(F.array_distinct(pred_col), F.array())
    exact = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.sort_array(t) == F.sort_array(p)).alias("e"))
    micro = multilabel_labels(df, true_col, pred_col).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), half_even(F.avg(F.when(c("support") > 0, c("f1"))), 3).alias("macro_f1"))
    both = exact.crossJoin(F.broadcast(micro))  # one row each
    whole = 2 * c("tp") + c("fp") + c("fn")
    return both.select("n", F.when(whole > 0, half_even(2 * c("tp") / whole, 3)).alias("micro_f1"), "macro_f1", percent(c("e"), c("n")).alias("exact_pct"))


def population_weights(sample: DataFrame, population: DataFrame, stratum_col: str) -> DataFrame:
    """``sample`` with ``weight``: rows of the stratum in the population for each in the sample."""
    big = population.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("__big"))
    small = sample.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("__small"))
    return sample.join(big.join(small, stratum_col), stratum_col).withColumn("weight", F.col("__big") / F.col("__small")).drop("__big", "__small")


def weighted_accuracy(df: DataFrame, correct: Column, weight: Column) -> DataFrame:
    w = F.coalesce(weight, F.lit(0.0))
    return df.agg(percent(F.sum(F.when(correct, w).otherwise(0.0)), F.sum(w)).alias("weighted_accuracy"))


def outcome_agreement(df: DataFrame, outcome_col: str, scale: Scale = Scale()) -> DataFrame:
    """Agreement of clearly good or bad ratings with a yes/no outcome."""
    rating, o = F.col("rating"), F.col(outcome_col)
    clear = df.filter(o.isNotNull() & ((rating <= scale.negative_max) | (rating >= scale.positive_min)))
    good = rating >= scale.positive_min
    sums = clear.agg(F.count(F.lit(1)).alias("n"), F.count_if(good == (o == 1.0)).alias("agree"), F.count_if(good & (o == 0.0)).alias("positive_but_no"), F.count_if(~good & (o == 1.0)).alias("negative_but_yes"))
    w = wilson(F.col("agree"), F.col("n"))
    return sums.select("n", percent(F.col("agree"), F.col("n")).alias("agreement_pct"), w["low"].alias("ci_low"), w["high"].alias("ci_high"), "positive_but_no", "negative_but_yes")


def rating_outcome_table(df: DataFrame, outcome_col: str) -> DataFrame:
    rows = df.filter(F.col("rating").isNotNull() & F.col(outcome_col).isNotNull())
    return rows.groupBy("rating").agg(F.count_if(F.col(outcome_col) == 0.0).alias("no"), F.count_if(F.col(outcome_col) == 1.0).alias("yes")).orderBy("rating")


def calibration_grid(negative_steps: int = 10, positive_steps: int = 14, penalties: tuple[float, ...] = (0.0, 0.05, 0.1, 0.15, 0.2)) -> list[tuple[float, float, float]]:
    """(negative_max, positive_min, penalty) with negative_max below positive_min."""
    lows = [round(-0.5 + 0.1 * i, 2) for i in range(negative_steps)]
    highs = [round(0.05 + 0.05 * i, 2) for i in range(positive_steps)]
    return [(a, b, p) for a in lows for b in highs for p in penalties if a < b]


def calibrate(df: DataFrame, score_col: str, complaints_col: str, true_col: str, grid: list[tuple[float, float, float]], labels: list[str] | None = None) -> DataFrame:
    """Accuracy and macro-F1 of every setting, best first: rows are counted by (score, complaints, truth) before they meet the grid."""
    counts = df.filter(F.col(true_col).isNotNull() & F.col(score_col).isNotNull()).groupBy(half_even(F.col(score_col), 4).alias("score"), F.col(complaints_col).alias("k"), F.col(true_col).alias("true")).agg(F.count(F.lit(1)).alias("n"))
    settings = df.sparkSession.createDataFrame(grid, "negative_max double, positive_min double, penalty double")  # the grid is a parameter
    adjusted = F.col("score") - F.col("penalty") * F.col("k")
    pred = F.when(adjusted <= F.col("negative_max"), "Negative").when(adjusted >= F.col("positive_min"), "Positive").otherwise("Neutral")
    keys = ("negative_max", "positive_min", "penalty")
    matrix = counts.crossJoin(F.broadcast(settings)).withColumn("pred", pred).groupBy(*keys, "true", "pred").agg(F.sum("n").alias("n"))
    return classification_summary(matrix, labels or ["Positive", "Neutral", "Negative"], keys).orderBy(F.desc("macro_f1"), F.desc("accuracy"), *keys)


def validate_truth(truth: DataFrame, known_ids: DataFrame, labels: list[str], topics: list[str], issue_topic: dict[str, str]) -> DataFrame:
    """``review_id``, ``level``, ``problem`` for every fault of a hand-labelled table (columns review_id, true_sentiment, true_topic, true_issues array)."""

    def named(c: Column, allowed: list[str], what: str) -> Column:
        hint = F.lit(None).cast("string")
        for a in allowed:
            hint = F.when(F.lower(c) == a.lower(), a).otherwise(hint)
        said = F.concat(F.lit(f"unknown {what}: "), c, F.when(hint.isNotNull(), F.concat(F.lit(" (did you mean "), hint, F.lit("?)"))).otherwise(""))
        return F.when(c.isNotNull() & (c != "") & ~c.isin(*allowed), said)

    known = known_ids.select(F.col("review_id").alias("__id")).distinct()
    repeated = F.count(F.lit(1)).over(Window.partitionBy("review_id"))
    rows = truth.withColumn("__times", repeated).join(known, F.col("review_id") == F.col("__id"), "left")
    s, t, i = F.col("true_sentiment"), F.col("true_topic"), F.coalesce(F.col("true_issues"), F.array())
    started = (F.coalesce(s, F.lit("")) != "") | (F.coalesce(t, F.lit("")) != "")
    of_topic = F.create_map(*[F.lit(x) for kv in issue_topic.items() for x in kv])
    checks = [
        ("error", named(s, labels, "sentiment")),
        ("error", named(t, topics, "topic")),
        ("error", F.when(started & (F.coalesce(t, F.lit("")) == ""), "topic is empty")),
        ("error", F.when(started & (F.coalesce(s, F.lit("")) == ""), "sentiment is empty")),
        ("error", F.when(F.exists(i, lambda x: ~x.isin(*issue_topic)), "unknown issue")),
        ("error", F.when(F.col("__times") > 1, "repeated review_id")),
        ("error", F.when(F.col("__id").isNull(), "review_id is not in the data")),
        ("warning", F.when((s == "Negative") & (F.size(i) == 0), "negative without an issue")),
        ("warning", F.when((F.size(i) > 0) & (t != of_topic[F.get(i, F.lit(0))]), "main issue is of another topic")),
    ]
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(level).alias("level"), c.alias("problem")) for level, c in checks]), lambda x: x["problem"].isNotNull()))
    return rows.select("review_id", each.alias("x")).select("review_id", "x.level", "x.problem").distinct()
