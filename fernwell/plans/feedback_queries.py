"""Registered queries of the feedback engine: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwell.functions import text as T
from fernwell.operators import analytics as A
from fernwell.operators import cleaning as C
from fernwell.operators import evaluation as E
from fernwell.operators import labelling as L
from fernwell.operators.analytics import Scale
from fernwell.plans import pipeline as P
from fernwell.plans import views
from fernwell.plans.views import fb_orders
from fernwell.sources.feedback import ORDER
from fernwell.sources.profile import load_profile
from fernwell.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CALIBRATION = [(a / 10, b / 10, p / 10) for a in (-3, -1) for b in (2, 5) for p in (0, 1)]
DIMENSIONS = ("entity", "priority", "segment", "region")


def on_orders(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(fb_orders(spark, sf_dir)))
        return f

    return register


def plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so that engines agree on their type."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def ungrouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", (F.col("review_id") * 37) % 1009)


on_orders("kpis_overview")(lambda d: A.overview(d, "sentiment", "weight", dimensions=("entity", "priority")))
on_orders("rating_distribution")(lambda d: A.rating_distribution(d))
on_orders("sentiment_distribution")(lambda d: A.sentiment_distribution(d, "sentiment", "weight"))
on_orders("sentiment_sources")(lambda d: A.value_counts(d.withColumn("sentiment_source", F.when(F.col("rating").isNotNull(), "rating").when(F.col("review_id") % 2 == 0, "text_baseline")), "sentiment_source", ["rating", "text_ai", "text_baseline", "none"]))
on_orders("trend_monthly")(lambda d: A.over_time(d.withColumn("month", F.when(F.month("month") != 7, F.col("month"))), "sentiment", "weight"))
on_orders("sentiment_trend")(lambda d: A.sentiment_over_time(d, "sentiment", "weight"))
on_orders("recent_change")(lambda d: A.recent_change(d, "entity", "sentiment", "weight"))
on_orders("group_summary")(lambda d: A.group_summary(d, "entity", "sentiment", "weight", outcomes=("fulfilled",)))
on_orders("breakdown_observed")(lambda d: A.group_summary(d, "priority", "sentiment", "weight", observed_sentiment="sentiment"))
on_orders("breakdowns_fused")(lambda d: A.breakdowns(d, DIMENSIONS, "sentiment", "weight"))
on_orders("band_fixed")(lambda d: A.band_summary(d, "value", [0, 50000, 150000, 300000, 100000000], ["low", "mid", "high", "top"]))
on_orders("band_quantile")(lambda d: A.band_summary(ungrouped(d), "bucket"))
on_orders("spearman")(lambda d: A.spearman(ungrouped(d).withColumn("x", F.col("bucket") + F.col("rating") * 20), "x"))
on_orders("low_rating_drivers")(lambda d: A.low_rating_drivers(d, DIMENSIONS))
on_orders("priority")(lambda d: A.priority_table(d, "entity", "sentiment", "weight"))
on_orders("outcome_agreement")(lambda d: E.outcome_agreement(d, "fulfilled"))
on_orders("filtered_group_summary")(lambda d: A.group_summary(d.filter(F.col("region").isin("ASIA", "EUROPE") & F.col("priority").isin("1-URGENT", "2-HIGH")), "entity", "sentiment", "weight"))


# Queries over derived columns: cleaning, labels and evaluation.


def rows_of(name: str, table: str) -> Callable:
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(views.table(spark, sf_dir, table)))
        return f

    return register


@rows_of("dedup_exact", "documents")
def dedup_exact(d: DataFrame) -> DataFrame:
    return C.first_rows(d.select("doc_id", "text", "lang", F.col("doc_id").alias(ORDER)), [F.col("text")]).select("doc_id", "lang")


@rows_of("dedup_resubmission", "documents")
def dedup_resubmission(d: DataFrame) -> DataFrame:
    return C.drop_resubmissions(d.select("doc_id", "text", "lang", F.col("doc_id").alias(ORDER)), "text", ["lang"]).select("doc_id", "lang")


@on_orders("canonical_labels")
def canonical_labels(d: DataFrame) -> DataFrame:
    k = F.col("review_id")
    spelt = F.when(k % 3 == 0, F.upper("region")).when(k % 5 == 1, F.concat(F.lower("region"), F.lit(" "))).otherwise(F.initcap("region"))
    return C.canonical_labels(d.select("review_id", spelt.alias("label"), k.alias(ORDER)), "label").select("review_id", "label")


@on_orders("id_repair")
def id_repair(d: DataFrame) -> DataFrame:
    k = F.col("review_id")
    return C.ensure_ids(d.select(k.alias("k"), F.when(k % 50 != 0, (k % 9000).cast("string")).alias("review_id"), k.alias(ORDER))).select("k", "review_id")


@on_orders("parse_values")
def parse_values(d: DataFrame) -> DataFrame:
    k = F.col("review_id")
    stars = 1 + k % 7
    said = F.when(k % 4 == 0, F.concat(stars.cast("string"), F.lit(" stars"))).when(k % 4 == 1, F.concat(stars.cast("string"), F.lit("/5"))).when(k % 4 == 2, F.concat(stars.cast("string"), F.lit("/10"))).otherwise(F.concat(stars.cast("string"), F.lit(".5")))
    money = F.concat(F.lit("about $"), F.format_number(k * 10, 0), F.lit(".25 in all"))
    return d.select("review_id", T.valid_rating(T.parse_rating(said, 5), 1, 5).alias("rating"), T.parse_number(money).alias("amount"), T.parse_date(F.date_format("date", "MMMM d, yyyy")).alias("day"))


@rows_of("keyword_hits", "documents")
def keyword_hits(d: DataFrame) -> DataFrame:
    hit = lambda *w: F.col("text").rlike(T.keyword_regex(list(w)))
    return d.groupBy("lang").agg(F.count_if(hit("the", "and")).alias("english"), F.count_if(hit("und", "der")).alias("german"), F.count_if(hit("with")).alias("rare"))


@rows_of("sentence_split", "conversations")
def sentence_split(d: DataFrame) -> DataFrame:
    return d.select("conv_id", "turn", F.size(T.sentences(F.col("text"))).alias("n_sentences"), T.word_count(F.col("text")).alias("n_words"))


@rows_of("tuning_split", "documents")
def tuning_split(d: DataFrame) -> DataFrame:
    return d.select("doc_id", T.split_side(F.col("doc_id")).alias("side"))


@on_orders("semi_filter")
def semi_filter(d: DataFrame) -> DataFrame:
    ids = d.filter(F.col("fulfilled") == 1.0).select("review_id")
    return d.join(ids, "review_id", "left_semi").groupBy("entity").agg(F.count("*").alias("n"))


@on_orders("anti_filter")
def anti_filter(d: DataFrame) -> DataFrame:
    ids = d.filter(F.col("fulfilled") == 1.0).select("review_id")
    return d.join(ids, "review_id", "left_anti").groupBy("entity").agg(F.count("*").alias("n"))


def labelled(d: DataFrame) -> DataFrame:
    """Reviews with aspects that follow from their keys."""
    k = F.col("review_id")
    bad = F.struct(F.col("priority").alias("topic"), F.lit("negative").alias("polarity"), F.concat(F.col("priority"), F.lit(" issue")).alias("issue"))
    good = F.struct(F.col("segment").alias("topic"), F.lit("positive").alias("polarity"), F.lit(None).cast("string").alias("issue"))
    also = F.struct(F.col("segment").alias("topic"), F.lit("negative").alias("polarity"), F.concat(F.col("segment"), F.lit(" issue")).alias("issue"))
    aspects = F.filter(F.array(F.when(F.col("rating") <= 3, bad), F.when(k % 2 == 0, good), F.when(k % 7 == 0, also)), lambda a: a.isNotNull())
    return d.filter("has_text").withColumns({"aspects_ai": aspects, "label_source": F.lit("baseline"), "sample_weight": F.coalesce("weight", F.lit(1.0)), "flag_late": k % 11 == 0, "flag_again": k % 6 == 0})


def exploded(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = labelled(d)
    return rows, L.explode_aspects(rows, ["review_id", "rating", "sentiment", "sample_weight", "entity", "region"]), rows.agg(F.sum("sample_weight").alias("total"))


@on_orders("aspect_explode")
def aspect_explode(d: DataFrame) -> DataFrame:
    return exploded(d)[1].select("review_id", "topic", "polarity", "issue")


@on_orders("topics_outer")
def topics_outer(d: DataFrame) -> DataFrame:
    _, aspects, total = exploded(d)
    return P.topic_table(aspects, total)


@on_orders("praise")
def praise(d: DataFrame) -> DataFrame:
    _, aspects, total = exploded(d)
    return P.mention_table(aspects, "positive", "topic", total)


@on_orders("flags")
def flags(d: DataFrame) -> DataFrame:
    return P.flag_table(labelled(d), {"late": "came late", "again": "bought again"})


@on_orders("issues_by_segment")
def issues_by_segment(d: DataFrame) -> DataFrame:
    rows, aspects, _ = exploded(d)
    return P.issues_by(aspects, rows, "region", 4)


@on_orders("issue_priority")
def issue_priority(d: DataFrame) -> DataFrame:
    rows, _, total = exploded(d)
    return A.priority_table(L.complaints(rows, ["rating", "sentiment", "sample_weight"]), "issue", "sentiment", "sample_weight", total)


def predicted(d: DataFrame) -> DataFrame:
    k = F.col("review_id")
    pred = F.when(k % 17 == 0, F.lit(None)).when(k % 3 == 0, "Negative").when((k * 13) % 7 < 2, "Neutral").otherwise(F.coalesce("sentiment", F.lit("Positive")))
    return d.withColumn("pred", pred)


@on_orders("confusion")
def confusion(d: DataFrame) -> DataFrame:
    return E.confusion(predicted(d), "sentiment", "pred")


@on_orders("class_metrics")
def class_metrics(d: DataFrame) -> DataFrame:
    return E.class_metrics(E.confusion(predicted(d), "sentiment", "pred"), list(A.SENTIMENTS))


@on_orders("classification_summary")
def classification_summary(d: DataFrame) -> DataFrame:
    return E.classification_summary(E.confusion(predicted(d), "sentiment", "pred"), list(A.SENTIMENTS))


@on_orders("binary_metrics")
def binary_metrics(d: DataFrame) -> DataFrame:
    return E.binary_metrics(predicted(d), F.col("sentiment") == "Negative", F.col("pred") == "Negative")


@on_orders("multilabel_summary")
def multilabel_summary(d: DataFrame) -> DataFrame:
    pick = lambda m: F.filter(F.array(*[F.when(F.col("review_id") % (i + m) == 0, F.lit(f"L{i}")) for i in range(2, 6)]), lambda x: x.isNotNull())
    return E.multilabel_summary(d.select(pick(0).alias("t"), pick(1).alias("p")), "t", "p")


@on_orders("population_accuracy")
def population_accuracy(d: DataFrame) -> DataFrame:
    rows = predicted(d).filter(F.col("sentiment").isNotNull())
    sample = E.population_weights(rows.filter((F.col("review_id") % 5 == 0) | (F.col("sentiment") == "Negative")), rows, "sentiment")
    return E.weighted_accuracy(sample, F.coalesce(F.col("sentiment") == F.col("pred"), F.lit(False)), F.col("weight"))


@on_orders("rating_outcome_table")
def rating_outcome_table(d: DataFrame) -> DataFrame:
    return E.rating_outcome_table(d, "fulfilled")


@on_orders("calibration")
def calibration(d: DataFrame) -> DataFrame:
    rows = d.withColumns({"score": ((F.col("review_id") * 7) % 200 - 100) / 100.0, "complaints": (F.col("review_id") % 3).cast("int")})
    return E.calibrate(rows, "score", "complaints", "sentiment", CALIBRATION)


@rows_of("events_windows", "events")
def events_windows(d: DataFrame) -> DataFrame:
    rows = d.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (1 + F.col("event_id") % 5).cast("double").alias("rating"), Scale().sentiment((1 + F.col("event_id") % 5).cast("double")).alias("sentiment"))
    return live.windowed_metrics(rows, "ts", window="1 day", by="event_type").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@rows_of("stratified_sample", "documents")
def stratified_sample(d: DataFrame) -> DataFrame:
    rows = d.select(F.col("doc_id").alias("review_id"), F.lit(True).alias("has_text"), F.when(F.col("doc_id") % 10 == 0, "Negative").when(F.col("doc_id") % 10 < 4, "Neutral").when(F.col("doc_id") % 10 < 9, "Positive").alias("sentiment_from_rating"))
    return L.sample_with_weights(rows, 200).groupBy(F.coalesce("sentiment_from_rating", F.lit("Unrated")).alias("stratum")).agg(F.count("*").alias("n"), F.round(F.sum("sample_weight")).cast("long").alias("weight"))


@rows_of("baseline_labels", "documents")
def baseline_labels(d: DataFrame) -> DataFrame:
    """The keyword baseline over whole documents, with a profile whose words occur in them."""
    profile = load_profile({"name": "prose", "taxonomy": {"A": {"Says the": "x"}, "B": {"Says und": "x"}, "Other": {"Other": "x"}}, "baseline_keywords": {"issues": {"Says the": ["the"], "Says und": ["und"]}, "praise": {"A": ["que"]}}})
    rows = L.baseline_labels(d.select(F.col("doc_id").alias("review_id"), F.col("text").alias("analysis_text")), profile)
    return rows.groupBy("primary_topic_ai", "sentiment_ai").agg(F.count("*").alias("n"), F.sum(F.size("aspects_ai")).alias("aspects"))
