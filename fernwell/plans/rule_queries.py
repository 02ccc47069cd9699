"""Registered queries of single rules: parsers, repairs, weights, label joins and checks, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwell.functions import text as T
from fernwell.operators import analytics as A
from fernwell.operators import cleaning as C
from fernwell.operators import evaluation as E
from fernwell.operators import labelling as L
from fernwell.plans import evaluate as EV
from fernwell.plans import pipeline as P
from fernwell.plans.feedback_queries import DIMENSIONS, QUERIES, exploded, labelled, on_orders, predicted, rows_of
from fernwell.sources import sinks
from fernwell.sources.profile import load_profile

def key() -> Column:
    return F.col("review_id")



def one_of(*values: str | None) -> Column:
    """A value by the review's number."""
    out = F.lit(values[-1]).cast("string")
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(key() % len(values) == i, F.lit(v)).otherwise(out)
    return out


@on_orders("numeric_range")
def numeric_range(d: DataFrame) -> DataFrame:
    said = F.concat(F.lit("about "), (key() % 900 - 200).cast("string"), F.lit(" minutes"))
    return d.select("review_id", T.in_range(T.parse_number(said), (0, 500)).alias("minutes"))


@on_orders("plausible_dates")
def plausible_dates(d: DataFrame) -> DataFrame:
    return d.select("review_id", T.plausible_date(F.col("date"), "1997-06-30", "1993-02-01").alias("day"))


@on_orders("outcome_tokens")
def outcome_tokens(d: DataFrame) -> DataFrame:
    said = one_of("Yes", " TRUE ", "1.0", "0", "no", "N", "maybe", None, "2", "0.0")
    return d.select("review_id", T.parse_outcome(said, ["1", "yes", "true", "y"], ["0", "no", "false", "n"]).alias("outcome"))


@on_orders("value_aliases")
def value_aliases(d: DataFrame) -> DataFrame:
    aliases = {"ASIA": "Asia-Pacific", "EUROPE": "Europe"}
    out = d.withColumn("was", F.col("region").isin(*aliases)).withColumn("region", T.corrected(F.col("region"), aliases))
    return out.groupBy("region").agg(F.count("*").alias("n"), F.count_if("was").alias("corrected"))


@on_orders("title_and_text")
def title_and_text(d: DataFrame) -> DataFrame:
    title, text = one_of("Good value", "Why?", None, "Late.", None), F.when(key() % 3 != 0, F.concat(F.lit("From "), F.col("entity")))
    out = T.with_title(title, text)
    return d.select("review_id", out.alias("analysis_text"), out.isNotNull().alias("has_text"))


TOKENS = ("", " n/a ", "NaN", "none", "-", "--", "?", "NULL", "na", "0", "fine", None, "no")


@on_orders("missing_tokens")
def missing_tokens(d: DataFrame) -> DataFrame:
    return C.missing_counts(d.select(one_of(*TOKENS).alias("review_text"), F.col("rating").cast("string").alias("rating"), F.when(key() % 4 != 0, "x").alias("review_id")), ["review_text", "rating", "review_id"])


@on_orders("csv_nulls")
def csv_nulls(d: DataFrame) -> DataFrame:
    return d.select(T.csv_null(one_of("#N/A", "NULL", "null", "None", "none", "<NA>", "-nan", "n/a", "N/a", "", "x")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


MARKUP = "&lt;b&gt;Tom &amp; {entity}&nbsp;&#8212; caf&eacute; &#x2019;{region}&#150; &amp;lt; &unknown;  <i>x</i>"


@on_orders("character_references")
def character_references(d: DataFrame) -> DataFrame:
    a, b, c = MARKUP.replace("{region}", "{entity}").split("{entity}")
    text = F.concat(F.lit(a), F.col("entity"), F.lit(b), F.col("region"), F.lit(c))
    return d.select("review_id", T.clean_text(F.when(key() % 9 != 0, text).otherwise("&nbsp; &#160;")).alias("text"))


@on_orders("label_lists")
def label_lists(d: DataFrame) -> DataFrame:
    said = F.concat(F.col("entity"), F.lit("; "), F.col("region"), F.lit(";;"), F.when(key() % 2 == 0, F.col("entity")).otherwise(""), F.lit(" ; "), F.col("segment"))
    items = T.split_labels(F.when(key() % 10 != 0, said))
    return d.select("review_id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


@on_orders("truth_from_aspects")
def truth_from_aspects(d: DataFrame) -> DataFrame:
    said = F.concat(F.col("segment"), F.lit(":negative:"), F.col("priority"), F.when(key() % 3 == 0, F.concat(F.lit("|"), F.col("region"), F.lit(":positive:"))).otherwise(""), F.when(key() % 4 == 0, F.concat(F.lit(" | "), F.col("region"), F.lit(" : negative : "), F.col("priority"))).otherwise(""))
    out = EV.prepare_truth(d.select("review_id", F.when(key() % 5 != 0, said).alias("true_aspects")))
    return out.select("review_id", F.array_join("issues", "|").alias("issues"), F.array_join("praise", "|").alias("praise"), "main_issue")


@on_orders("truth_from_lists")
def truth_from_lists(d: DataFrame) -> DataFrame:
    out = EV.prepare_truth(d.select("review_id", F.concat_ws(";", F.when(key() % 2 == 0, F.col("priority")), F.when(key() % 3 == 0, F.col("segment"))).alias("true_issues"), F.when(key() % 7 == 0, F.col("region")).alias("true_praise_topics")))
    return out.select("review_id", F.array_join("issues", "|").alias("issues"), F.array_join("praise", "|").alias("praise"), "main_issue")


@on_orders("truth_from_one_issue")
def truth_from_one_issue(d: DataFrame) -> DataFrame:
    out = EV.prepare_truth(d.select("review_id", F.when(key() % 3 == 0, "None").when(key() % 3 == 1, F.col("segment")).alias("true_issue")))
    return out.groupBy("main_issue").agg(F.count("*").alias("n"), F.sum(F.size("issues")).alias("issues"))


@on_orders("truth_values")
def truth_values(d: DataFrame) -> DataFrame:
    return d.select("review_id", T.to_bool(one_of("True", " yes", "1", "Y", "false", "NO", "0", "n", "", "perhaps", None)).cast("string").alias("flag"))


@on_orders("primary_issue")
def primary_issue(d: DataFrame) -> DataFrame:
    return L.with_primary_issue(labelled(d)).select("review_id", "issue_ai")


@on_orders("aspect_sides")
def aspect_sides(d: DataFrame) -> DataFrame:
    pick = lambda p, f: F.array_join(F.transform(F.filter("aspects_ai", lambda a: a["polarity"] == p), lambda a: a[f]), "|")
    return labelled(d).select("review_id", pick("negative", "issue").alias("issues"), pick("positive", "topic").alias("topics"))


@on_orders("score_sentiment")
def score_sentiment(d: DataFrame) -> DataFrame:
    score = ((key() * 7) % 200 - 100) / 100.0
    return d.select("review_id", L.by_score(score, -0.05, 0.05).alias("plain"), L.by_score(score - 0.25 * (key() % 3), -0.25, 0.5).alias("calibrated"))


def resolved(d: DataFrame) -> DataFrame:
    source = one_of("ai", "cache", "baseline", "baseline_fallback", "not_sampled", "no_text", "failed")
    rows = d.select("review_id", "rating", "entity", "has_text", F.when(F.col("rating").isNotNull() & (key() % 4 != 0), A.Scale().sentiment(F.col("rating"))).alias("sentiment_from_rating"), one_of("Positive", "Negative", None, "Neutral").alias("sentiment_ai"), source.alias("label_source"), (1 + key() % 3).cast("double").alias("sample_weight"))
    return P.add_weights(L.resolve_sentiment(rows))


@on_orders("resolved_sentiment")
def resolved_sentiment(d: DataFrame) -> DataFrame:
    return resolved(d).select("review_id", "sentiment", "sentiment_source", "in_label_sample", "sample_weight", "sentiment_weight")


@on_orders("label_sample")
def label_sample(d: DataFrame) -> DataFrame:
    return resolved(d).filter("in_label_sample").groupBy("entity").agg(F.count("*").alias("n"))


@on_orders("sampling_strata")
def sampling_strata(d: DataFrame) -> DataFrame:
    return L.strata(resolved(d))


@on_orders("no_text_labels")
def no_text_labels(d: DataFrame) -> DataFrame:
    out, _ = P.label(d.select("review_id", "has_text"), load_profile(None), "none", None, 0, 0, None)
    return out.groupBy("label_source").agg(F.count("*").alias("n"), F.count("sentiment_ai").alias("labelled"), F.count("sample_weight").alias("weighted"))


@on_orders("usable_rows")
def usable_rows(d: DataFrame) -> DataFrame:
    return d.filter(C.usable()).groupBy("region").agg(F.count("*").alias("n"))


@rows_of("cut_texts", "documents")
def cut_texts(d: DataFrame) -> DataFrame:
    """Texts as a source that cuts at 500 characters would give them; those that were cut are found again."""
    cut = C.truncation(d.select("doc_id", F.substring("text", 1, 500).alias("review_text")))
    return cut.select("doc_id", "text_truncated")


@rows_of("prompt_guard", "documents")
def prompt_guard(d: DataFrame) -> DataFrame:
    t = T.guarded(F.col("text"), 2000)
    return d.groupBy("lang").agg(F.count_if(F.length("text") > 2000).alias("cut"), F.sum(F.length(t)).alias("chars"), F.sum(F.length(T.escape(t))).alias("escaped_chars"))


@rows_of("cache_keys", "documents")
def cache_keys(d: DataFrame) -> DataFrame:
    return d.select("doc_id", sinks.cache_key("model-1", "v2", "abcdef", "text").alias("key"))


REPAIR = {"name": "prose", "taxonomy": {"A": {"Late": "x", "Lost": "x"}, "B": {"Rude": "x"}, "Other": {"Other": "x"}}}


@on_orders("label_repair")
def label_repair(d: DataFrame) -> DataFrame:
    aspect = lambda t, p, i: F.struct(t.alias("topic"), p.alias("polarity"), i.alias("issue"))
    aspects = F.array(aspect(one_of("A", "B", "Z"), one_of("negative", "positive", "mixed", "negative"), one_of("Late", "Rude", "Unknown", None, "Lost")), aspect(F.lit("B"), F.lit("negative"), F.lit("Rude")), aspect(F.lit("B"), F.lit("positive"), F.lit("Rude")), aspect(F.lit("A"), F.lit("negative"), one_of("Late", "Lost")))
    rows = d.select("review_id", one_of("Positive", "negative", None, "Neutral").alias("sentiment_ai"), one_of("A", "Q", None).alias("primary_topic_ai"), F.when(key() % 6 != 0, aspects).alias("aspects_ai"), one_of("low", "sure", None).alias("confidence_ai"))
    out = L.repair_label(L.repair_label(rows, load_profile(REPAIR)), load_profile(REPAIR))
    shown = F.array_join(F.transform("aspects_ai", lambda a: F.concat_ws(":", a["topic"], a["polarity"], F.coalesce(a["issue"], F.lit("")))), "|")
    return out.select("review_id", "sentiment_ai", "primary_topic_ai", "confidence_ai", shown.alias("aspects"))


@on_orders("flag_metrics")
def flag_metrics(d: DataFrame) -> DataFrame:
    rows = d.select(T.to_bool(one_of("yes", "no", "", "no", "1")).alias("true"), F.when(key() % 7 != 0, key() % 3 == 0).alias("pred"))
    return E.binary_metrics(rows, F.col("true"), F.col("pred"))


@on_orders("truth_problems")
def truth_problems(d: DataFrame) -> DataFrame:
    truth = d.filter(key() % 5 == 0).select(F.when(key() % 50 == 0, -key()).otherwise(key()).alias("review_id"), one_of("Positive", "Negative", "positive", "", "Awful", "Negative").alias("true_sentiment"), one_of("A", "", "B", "a").alias("true_topic"), F.when(key() % 3 == 0, F.array(one_of("Late", "Rude", "Unheard", "Lost"))).otherwise(F.array().cast("array<string>")).alias("true_issues"))
    found = E.validate_truth(truth, d.select("review_id"), list(A.SENTIMENTS), ["A", "B"], {"Late": "A", "Lost": "A", "Rude": "B"})
    return found.groupBy("level", "problem").agg(F.count("*").alias("n"))


@on_orders("truth_agreement")
def truth_agreement(d: DataFrame) -> DataFrame:
    """Labels joined to hand labels of some reviews, by rating."""
    truth = d.filter(key() % 3 == 0).select("review_id", F.col("sentiment").alias("true_sentiment"))
    return predicted(d).join(truth, "review_id").groupBy("rating").agg(F.count("true_sentiment").alias("n"), F.count_if(F.col("true_sentiment") == F.col("pred")).alias("right"))


@on_orders("cost_estimate")
def cost_estimate(d: DataFrame) -> DataFrame:
    return L.estimate_cost(d.select(F.when(F.col("has_text"), F.repeat(F.col("entity"), (key() % 300).cast("int"))).alias("t")), "t", 3.0, 15.0)


@on_orders("multilabel_by_label")
def multilabel_by_label(d: DataFrame) -> DataFrame:
    pick = lambda m: F.filter(F.array(*[F.when(key() % (i + m) == 0, F.lit(f"L{i}")) for i in range(2, 6)]), lambda x: x.isNotNull())
    return E.multilabel_labels(d.select(pick(0).alias("t"), pick(1).alias("p")), "t", "p")


@on_orders("band_left")
def band_left(d: DataFrame) -> DataFrame:
    return d.select("review_id", T.band(key() % 120, [0, 20, 50, 100], ["few", "some", "many"], "left").alias("band"), T.band(key() % 120, [0, 20, 50, 100], ["few", "some", "many"]).alias("right_band"))


@on_orders("significant_drivers")
def significant_drivers(d: DataFrame) -> DataFrame:
    return A.low_rating_drivers(d, DIMENSIONS).filter("significant and lift > 1").select("dimension", "group", "lift")


@on_orders("issue_months")
def issue_months(d: DataFrame) -> DataFrame:
    rows, _, _ = exploded(d)
    return L.explode_aspects(rows, ["review_id", "month"]).filter("issue = '1-URGENT issue'").groupBy("month").agg(F.count("*").alias("n"))


@on_orders("true_issue_months")
def true_issue_months(d: DataFrame) -> DataFrame:
    """Reviews with their hand-labelled issue, whether they have one or not."""
    truth = d.filter(key() % 4 == 0).select("review_id", F.col("priority").alias("true_issue"))
    return d.join(truth, "review_id", "left").groupBy("region", "true_issue").agg(F.count("*").alias("n"))


@on_orders("sample_by_truth")
def sample_by_truth(d: DataFrame) -> DataFrame:
    return L.sample_by(d, "sentiment", 50, 7).select("review_id", "sentiment")


@on_orders("tuning_exclusions")
def tuning_exclusions(d: DataFrame) -> DataFrame:
    out = d.filter(key() % 6 == 0).select("review_id", F.lit(True).alias("excluded"))
    side = F.when(F.col("excluded"), "excluded").otherwise(T.split_side(key()))
    return d.join(out, "review_id", "left").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


