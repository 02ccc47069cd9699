"""The analysis: clean, label, weight, explode, and the registry of result tables.

Tables are lazy plans over one persisted feedback table. A table that the data can't give is registered as unavailable,
with its reason, before anything is planned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwell.functions.numbers import percent
from fernwell.operators import analytics as A
from fernwell.operators import evaluation as E
from fernwell.operators import labelling as L
from fernwell.operators.cleaning import process
from fernwell.sources.feedback import CleaningReport
from fernwell.sources.profile import Profile, Roles


class PipelineError(RuntimeError):
    """An analysis that can't go on."""


@dataclass
class Table:
    name: str
    title: str
    basis: str
    sentiment_col: str | None = None
    weighted: bool = False
    build: Callable[[], DataFrame] | None = None
    reason: str = ""
    note: Callable[[], DataFrame] | None = None

    @property
    def available(self) -> bool:
        return self.build is not None

    def frame(self) -> DataFrame:
        if self.build is None:
            raise PipelineError(f"{self.name}: {self.reason}")
        return self.build()


@dataclass
class AnalysisResult:
    data: DataFrame
    profile: Profile
    roles: Roles
    report: CleaningReport
    method: str
    sampling: dict = field(default_factory=dict)
    kpis: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise PipelineError(f"no table {name}")
        return self.tables[name].frame()

    @property
    def aspects(self) -> DataFrame:
        carry = ["review_id", "rating", "date", "month", "sentiment_ai", "sentiment", "sentiment_source", "label_source", "sample_weight", *(f"flag_{f}" for f in self.profile.flags), *self.roles.dimensions]
        return L.explode_aspects(self.data, carry)

    def filtered(self, by: dict | Column | Callable[[DataFrame], DataFrame]) -> AnalysisResult:
        """The same tables over some rows, which keep their weights. A dictionary holds allowed values by column."""
        if callable(by) and not isinstance(by, Column):
            rows = by(self.data)
        elif isinstance(by, dict):
            if unknown := [c for c in by if c not in self.data.columns]:
                raise PipelineError(f"unknown columns: {', '.join(unknown)}")
            rows = self.data.filter(reduce(lambda a, b: a & b, [F.col(c).isin(*(v if isinstance(v, (list, tuple, set)) else [v])) for c, v in by.items()], F.lit(True)))
        else:
            rows = self.data.filter(by)
        out = AnalysisResult(rows, self.profile, self.roles, self.report, self.method, self.sampling)
        build_tables(out)
        return out


def run_analysis(spark: SparkSession, source, profile=None, labelling: str = "baseline", client=None, max_ai_rows: int = 2000, seed: int = 0, reference_date: str | None = None, score=None, folder: str | None = None) -> AnalysisResult:
    """Analyse feedback. ``labelling``: baseline, ai (with an injected ``client``) or none."""
    if labelling not in ("baseline", "ai", "none"):
        raise PipelineError("labelling must be baseline, ai or none")
    if labelling == "ai" and client is None:
        raise PipelineError("labelling by a model needs a client")
    data, report, found = process(spark, source, profile, reference_date, folder=folder)
    roles = found.resolve_roles(data.columns)
    data, sampling = label(data, found, labelling, client, max_ai_rows, seed, score)
    data = add_weights(L.resolve_sentiment(data)).persist(StorageLevel.MEMORY_AND_DISK)
    sums = data.agg(F.count_if("has_text").alias("texts"), F.sum("sample_weight").alias("w"), F.count_if("in_label_sample").alias("labelled")).first()  # one row
    if labelling != "none" and abs((sums["w"] or 0.0) - sums["texts"]) > 1e-6 * max(1, sums["texts"]):
        raise PipelineError("sample weights do not add up to the reviews with text")
    result = AnalysisResult(data, found, roles, report, labelling, sampling | {"labelled": sums["labelled"], "with_text": sums["texts"], "weight": sums["w"]})
    build_tables(result)
    return result


def label(data: DataFrame, profile: Profile, labelling: str, client, max_rows: int, seed: int, score) -> tuple[DataFrame, dict]:
    flags = [f"flag_{f}" for f in profile.flags]
    empty = {"sentiment_ai": "string", "primary_topic_ai": "string", "aspects_ai": f"array<{L.ASPECT}>", "confidence_ai": "string", "issue_ai": "string", **dict.fromkeys(flags, "boolean"), "sample_weight": "double"}
    none = lambda df, source: df.withColumns({c: F.lit(None).cast(k) for c, k in empty.items()} | {"label_source": F.when(F.col("has_text"), source).otherwise("no_text")})
    if labelling == "none":
        return none(data, "not_sampled"), {"method": "none"}
    if labelling == "baseline":
        done = L.baseline_labels(data, profile, **({"score": score} if score else {}))
        return done.withColumn("sample_weight", F.when(F.col("has_text"), 1.0)), {"method": "baseline"}
    chosen = L.sample_with_weights(data, max_rows, seed).persist()
    labelled = L.label_with(chosen, client, profile)
    rest = none(data.join(chosen.select("review_id"), "review_id", "left_anti"), "not_sampled")
    return labelled.select(*rest.columns).unionByName(rest), {"method": "ai", "max_rows": max_rows}


def add_weights(df: DataFrame) -> DataFrame:
    """1 for sentiment by rating, the sample weight for sentiment by text."""
    labelled = L.is_labelled(F.col("label_source"))
    return df.withColumn("in_label_sample", labelled).withColumn("sample_weight", F.when(labelled, F.col("sample_weight"))).withColumn("sentiment_weight", F.when(F.col("sentiment_source") == "rating", 1.0).when(F.col("sentiment_source").isNotNull(), F.col("sample_weight")))


def mention_table(aspects: DataFrame, polarity: str, key: str, total: DataFrame) -> DataFrame:
    """Reviews that mention each key, once a review, and their estimated share."""
    once = aspects.filter(F.col("polarity") == polarity).groupBy("review_id", key).agg(F.max("sample_weight").alias("w"))
    sums = once.groupBy(key).agg(F.count(F.lit(1)).alias("reviews"), F.sum("w").alias("w")).crossJoin(F.broadcast(total))  # one row
    return sums.select(key, "reviews", percent(F.col("w"), F.col("total")).alias("est_pct_of_reviews")).orderBy(F.desc("est_pct_of_reviews"), key)


def topic_table(aspects: DataFrame, total: DataFrame) -> DataFrame:
    """Complaints and praise by topic, zeros where there are none."""
    once = aspects.groupBy("review_id", "topic", "polarity").agg(F.max("sample_weight").alias("w"))
    pick = lambda p, v: F.coalesce(F.sum(F.when(F.col("polarity") == p, v)), F.lit(0))
    sums = once.groupBy("topic").agg(*[x for p, n in (("negative", "complaint"), ("positive", "praise")) for x in (pick(p, F.lit(1)).alias(f"reviews_{n}"), pick(p, F.col("w")).alias(f"w_{n}"))])
    cols = [x for n in ("complaint", "praise") for x in (F.col(f"reviews_{n}"), percent(F.col(f"w_{n}"), F.col("total")).alias(f"est_pct_of_reviews_{n}"))]
    return sums.crossJoin(F.broadcast(total)).select("topic", *cols).orderBy(F.desc("est_pct_of_reviews_complaint"), "topic")  # one row


def flag_table(labelled: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Count and weighted share of every flag, from one wide aggregation."""
    w = F.coalesce("sample_weight", F.lit(0.0))
    sums = labelled.agg(F.sum(w).alias("total"), *[x for f in flags for x in (F.count_if(F.col(f"flag_{f}")).alias(f"n_{f}"), F.sum(F.when(F.col(f"flag_{f}"), w).otherwise(0.0)).alias(f"w_{f}"))])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"n_{f}").alias("reviews"), percent(F.col(f"w_{f}"), F.col("total")).alias("est_pct_of_reviews"), F.lit(d).alias("definition")) for f, d in flags.items()]))
    return sums.select(each.alias("x")).select("x.*")


def issues_by(aspects: DataFrame, labelled: DataFrame, segment: str, top: int = 10) -> DataFrame:
    """The most frequent issues by segment, as a share of the segment's labelled weight."""
    once = aspects.filter(F.col("polarity") == "negative").groupBy("review_id", "issue", segment).agg(F.max("sample_weight").alias("w"))
    best = once.groupBy("issue").agg(F.sum("w").alias("all")).orderBy(F.desc("all"), "issue").limit(top).select("issue")
    sums = once.join(F.broadcast(best), "issue", "left_semi").filter(F.col(segment).isNotNull()).groupBy(segment, "issue").agg(F.count(F.lit(1)).alias("reviews"), F.sum("w").alias("w"))  # top rows
    whole = labelled.groupBy(segment).agg(F.sum("sample_weight").alias("total"))
    return sums.join(whole, segment).select(segment, "issue", "reviews", percent(F.col("w"), F.col("total")).alias("est_pct_of_segment")).orderBy(segment, F.desc("est_pct_of_segment"), "issue")


def build_tables(r: AnalysisResult) -> None:
    """Register every table over ``r.data``."""
    d, scale, roles = r.data, r.profile.scale, r.roles
    dims, out = roles.dimensions, tuple(o.column for o in roles.outcomes)
    labelled = d.filter("in_label_sample")
    seen = d.agg(F.count("rating").alias("rated"), F.count("date").alias("dated") if "date" in d.columns else F.lit(0).alias("dated"), F.count_if("in_label_sample").alias("labelled"), *[F.count(o).alias(f"o_{o}") for o in out]).first()  # one row
    rated, dated, texts = seen["rated"] > 0, seen["dated"] > 0, seen["labelled"] > 0
    total = labelled.agg(F.sum("sample_weight").alias("total"))
    r.kpis = {"primary": A.overview(d, "sentiment", "sentiment_weight", scale, dims)}
    if rated:
        r.kpis["rating"] = A.overview(d, "sentiment_from_rating", None, scale, dims)
    if texts:
        r.kpis["text"] = A.overview(labelled, "sentiment_ai", "sample_weight", scale, dims)
    no = {"rating": "there is no rating", "date": "there is no date", "label": "no text is labelled", "entity": "no column is the reviewed entity"}

    def add(name: str, title: str, basis: str, build: Callable[[], DataFrame], need: str | None = None, ok: bool = True, sentiment: str | None = None, weighted: bool = False, note=None) -> None:
        r.tables[name] = Table(name, title, basis, sentiment, weighted, build if ok else None, "" if ok else no[need], note)

    add("rating_distribution", "Ratings", "rated", lambda: A.rating_distribution(d, scale), "rating", rated)
    add("sentiment_primary", "Sentiment", "all", lambda: A.sentiment_distribution(d, "sentiment", "sentiment_weight"), sentiment="sentiment", weighted=True)
    add("sentiment_sources", "Where sentiment comes from", "all", lambda: A.value_counts(d, "sentiment_source", ["rating", "text_ai", "text_baseline", "none"]))
    add("sentiment_text", "Sentiment of texts", "labelled", lambda: A.sentiment_distribution(labelled, "sentiment_ai", "sample_weight"), "label", texts, "sentiment_ai", True)
    add("trend", "Months", "all", lambda: A.over_time(d, "sentiment", "sentiment_weight", scale), "date", dated, "sentiment", True)
    add("trend_rating", "Months by rating", "rated", lambda: A.over_time(d.filter(F.col("rating").isNotNull()), "sentiment_from_rating", None, scale), "date", dated, "sentiment_from_rating")
    add("sentiment_trend", "Sentiment by month", "all", lambda: A.sentiment_over_time(d, "sentiment", "sentiment_weight"), "date", dated, "sentiment", True)
    add("recent_change", "Recent change", "all", lambda: A.recent_change(d, roles.entity, "sentiment", "sentiment_weight"), "entity" if dated else "date", dated and bool(roles.entity), "sentiment", True)
    for c in dims:
        add(f"breakdown:{c}", roles.label_for(c), "all", lambda c=c: A.group_summary(d, c, "sentiment", "sentiment_weight", scale, out, observed_sentiment="sentiment"), sentiment="sentiment", weighted=True)
    for n in roles.numeric:
        add(f"numeric:{n.column}", n.label, "rated", lambda n=n: A.band_summary(d, n.column, list(n.bins) or None, list(n.band_labels) or None, n.closed, scale=scale), "rating", rated, note=lambda n=n: A.spearman(d, n.column))
    add("low_rating_drivers", "Drivers of low ratings", "rated", lambda: A.low_rating_drivers(d, dims, scale), "rating" if not rated else "entity", rated and bool(dims))
    for o in roles.outcomes:
        add(f"outcome_agreement:{o.column}", o.label, "rated", lambda o=o: E.rating_outcome_table(d, o.column), "rating", rated and seen[f"o_{o.column}"] > 0, note=lambda o=o: E.outcome_agreement(d, o.column, scale))
    aspects = r.aspects
    add("topics", "Topics", "labelled", lambda: topic_table(aspects, total), "label", texts, "sentiment_ai", True)
    add("issue_priority", "Issues by priority", "labelled", lambda: A.priority_table(L.complaints(labelled, ["rating", "sentiment", "sample_weight"]), "issue", "sentiment", "sample_weight", total, scale), "label", texts, "sentiment", True)
    add("praise", "Praise", "labelled", lambda: mention_table(aspects, "positive", "topic", total), "label", texts, "sentiment_ai", True)
    add("flags", "Flags", "labelled", lambda: flag_table(labelled, r.profile.flags), "label", texts and bool(r.profile.flags), weighted=True)
    for c in roles.segments:
        add(f"issues_by:{c}", f"Issues by {roles.label_for(c).lower()}", "labelled", lambda c=c: issues_by(aspects, labelled, c), "label", texts, weighted=True)
