"""Text labels: keyword baseline, repair of any label into the taxonomy, sampling with weights, aspects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwell.functions.polarity import polarity
from fernwell.functions.text import guarded, keyword_regex, sentences
from fernwell.operators.analytics import SENTIMENTS
from fernwell.sources.profile import Calibration, Profile

POSITIVE_MIN, NEGATIVE_MAX, MOST_ASPECTS = 0.05, -0.05, 3
LABELLED = ("ai", "cache", "baseline", "baseline_fallback")
ALLOCATION = {"Negative": 0.50, "Neutral": 0.25, "Positive": 0.25}
ASPECT = "struct<topic:string,polarity:string,issue:string>"
FROM_PROFILE = object()


def by_score(score: Column, negative_max: float, positive_min: float) -> Column:
    return F.when(score <= negative_max, "Negative").when(score >= positive_min, "Positive").otherwise("Neutral")


def first_match(text: Column, words: dict[str, list[str]]) -> Column:
    """The first key, in order, one of whose keywords is in the text."""
    found = F.lit(None).cast("string")
    for name, keys in reversed(list(words.items())):
        if keys:
            found = F.when(text.rlike(keyword_regex(keys)), name).otherwise(found)
    return found


def lookup(mapping: dict[str, str], c: Column) -> Column:
    found = F.lit(None).cast("string")
    for k, v in mapping.items():
        found = F.when(c == k, v).otherwise(found)
    return found


def repair_aspects(aspects: Column, profile: Profile) -> Column:
    """Known topics and issues only, a listed issue deciding its topic, no repeats, three at most."""
    topic_of = {i: t for i, t in profile.issue_topic.items() if i != "Other"}

    def one(a: Column) -> Column:
        negative = a["polarity"] == "negative"
        topic = F.when(a["topic"].isin(*profile.taxonomy), a["topic"]).otherwise("Other")
        listed = a["issue"].isin(*topic_of) if topic_of else F.lit(False)
        issue = F.when(negative, F.when(listed, a["issue"]).otherwise("Other"))
        return F.struct(F.when(negative & listed, lookup(topic_of, a["issue"])).otherwise(topic).alias("topic"), a["polarity"].alias("polarity"), issue.alias("issue"))

    valid = F.filter(F.coalesce(aspects, F.array().cast(f"array<{ASPECT}>")), lambda a: a["polarity"].isin("positive", "negative"))
    return F.slice(F.array_distinct(F.transform(valid, one)), 1, MOST_ASPECTS)


def repair_label(df: DataFrame, profile: Profile) -> DataFrame:
    """Columns sentiment_ai, primary_topic_ai, aspects_ai and confidence_ai made valid; doing it twice changes nothing."""
    every = F.transform(F.filter(F.coalesce("aspects_ai", F.array().cast(f"array<{ASPECT}>")), lambda a: a["polarity"].isin("positive", "negative")), lambda a: a["topic"])
    df = df.withColumn("__topics", every).withColumn("aspects_ai", repair_aspects(F.col("aspects_ai"), profile))
    primary = F.when(F.col("primary_topic_ai").isin(*profile.taxonomy), F.col("primary_topic_ai")).otherwise(F.coalesce(F.get("aspects_ai", F.lit(0))["topic"], F.lit("Other")))
    return df.withColumns(
        {
            "sentiment_ai": F.when(F.col("sentiment_ai").isin(*SENTIMENTS), F.col("sentiment_ai")).otherwise("Neutral"),
            "primary_topic_ai": primary,
            "confidence_ai": F.when(F.col("confidence_ai").isin("low", "medium", "high"), F.col("confidence_ai")).otherwise("medium"),
        }
    ).drop("__topics")


def baseline_labels(df: DataFrame, profile: Profile, text_col: str = "analysis_text", score: Callable[[Column], Column] = polarity, calibration: Calibration | None | object = FROM_PROFILE) -> DataFrame:
    """Adds the baseline's label columns. ``calibration``: the profile's unless given; None is the plain rule."""
    rule = profile.calibration if calibration is FROM_PROFILE else calibration
    issues, praise, flags = (profile.keywords(k) for k in ("issues", "praise", "flags"))

    # what a sentence shows is computed once, as fields that the rule then refers to
    def seen(s: Column) -> Column:
        return F.struct((score(s) >= POSITIVE_MIN).alias("good"), first_match(s, issues).alias("issue"), first_match(s, praise).alias("topic"))

    def sentence(x: Column) -> Column:
        complaint = F.struct(lookup(profile.issue_topic, x["issue"]).alias("topic"), F.lit("negative").alias("polarity"), x["issue"].alias("issue"))
        thanks = F.struct(x["topic"].alias("topic"), F.lit("positive").alias("polarity"), F.lit(None).cast("string").alias("issue"))
        return F.when(~x["good"] & x["issue"].isNotNull(), complaint).when(x["good"] & x["topic"].isNotNull(), thanks)

    text = F.col(text_col)
    found = F.filter(F.transform(F.transform(sentences(text), seen), sentence), lambda a: a.isNotNull())
    out = df.withColumn("__score", score(text)).withColumn("__found", found)
    negative = F.filter("__found", lambda a: a["polarity"] == "negative")
    primary = F.coalesce(F.get(negative, F.lit(0))["topic"], F.get(F.col("__found"), F.lit(0))["topic"], F.lit("Other"))
    out = out.withColumn("primary_topic_ai", primary).withColumn("aspects_ai", repair_aspects(F.col("__found"), profile)).withColumn("__complaints", F.size(F.filter("aspects_ai", lambda a: a["polarity"] == "negative")))
    if rule is None:
        plain = by_score(F.col("__score"), NEGATIVE_MAX, POSITIVE_MIN)
        sentiment = F.when((plain == "Positive") & (F.col("__complaints") > 0), "Neutral").otherwise(plain)
    else:
        sentiment = by_score(F.col("__score") - rule.complaint_penalty * F.col("__complaints"), rule.negative_max, rule.positive_min)
    out = out.withColumn("sentiment_ai", sentiment).withColumn("confidence_ai", F.lit("low")).withColumn("label_source", F.lit("baseline"))
    out = out.withColumns({f"flag_{f}": text.rlike(keyword_regex(flags[f])) if flags.get(f) else F.lit(False) for f in profile.flags})
    return with_primary_issue(blank_unlabelled(out, text, profile)).drop("__score", "__found", "__complaints")


def blank_unlabelled(df: DataFrame, text: Column, profile: Profile) -> DataFrame:
    """Rows without text have no label."""
    cols = ["sentiment_ai", "primary_topic_ai", "aspects_ai", "confidence_ai", *(f"flag_{f}" for f in profile.flags)]
    return df.withColumns({c: F.when(text.isNotNull(), F.col(c)) for c in cols} | {"label_source": F.when(text.isNotNull(), F.col("label_source")).otherwise("no_text")})


def with_primary_issue(df: DataFrame) -> DataFrame:
    return df.withColumn("issue_ai", F.get(F.filter("aspects_ai", lambda a: a["polarity"] == "negative"), F.lit(0))["issue"])


def is_labelled(c: Column) -> Column:
    return c.isin(*LABELLED)


def resolve_sentiment(df: DataFrame) -> DataFrame:
    """``sentiment`` by the rating, else by the text label, and where it came from."""
    usable = is_labelled(F.col("label_source")) & F.col("sentiment_ai").isNotNull()
    text_source = F.when(F.col("label_source").isin("ai", "cache"), "text_ai").otherwise("text_baseline")
    rated = F.col("sentiment_from_rating").isNotNull()
    return df.withColumn("sentiment", F.when(rated, F.col("sentiment_from_rating")).when(usable, F.col("sentiment_ai"))).withColumn("sentiment_source", F.when(rated, "rating").when(usable, text_source))


def allocate(budget: int, capacity: dict[str, int], shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers that share out ``budget``, none above its capacity; what full strata leave goes to the others."""
    given = dict.fromkeys(capacity, 0)
    open_now = {k for k, n in capacity.items() if n and shares.get(k)}
    while open_now and budget > 0:
        whole = sum(shares[k] for k in open_now)
        want = {k: budget * shares[k] / whole for k in open_now}
        full = {k for k in open_now if want[k] >= capacity[k]}
        if full:
            for k in full:
                given[k] = capacity[k]
            budget -= sum(capacity[k] for k in full)
            open_now -= full
            continue
        for k in open_now:
            given[k] = int(want[k])
        short = budget - sum(given[k] for k in open_now)
        for k in sorted(open_now, key=lambda k: (given[k] - want[k], k))[:short]:
            given[k] += 1
        break
    return given


def sample_with_weights(df: DataFrame, max_rows: int = 2000, seed: int = 0, allocation: dict[str, float] | None = None) -> DataFrame:
    """Rows with text and their ``sample_weight``: all of them if they fit, else an exact number of each rating stratum.

    A stratum's sample is its rows of smallest hash, by an ordered limit: every task keeps its best n and only those move.
    """
    stratum = F.coalesce("sentiment_from_rating", F.lit("Unrated"))
    texts = df.filter("has_text").withColumn("__stratum", stratum)
    # four strata at most
    sizes = {r["__stratum"]: r["n"] for r in texts.groupBy("__stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(sizes.values())
    if whole <= max_rows:
        return texts.drop("__stratum").withColumn("sample_weight", F.lit(1.0))
    unrated = min(round(max_rows * sizes.get("Unrated", 0) / whole), sizes.get("Unrated", 0))
    targets = allocate(max_rows - unrated, {k: v for k, v in sizes.items() if k != "Unrated"}, allocation or ALLOCATION) | ({"Unrated": unrated} if unrated else {})
    out = None
    for k, n in sorted(targets.items()):
        if n:
            part = texts.filter(F.col("__stratum") == k).orderBy(F.xxhash64("review_id", F.lit(seed)), "review_id").limit(n).withColumn("sample_weight", F.lit(sizes[k] / n))
            out = part if out is None else out.unionByName(part)
    return (out if out is not None else texts.limit(0).withColumn("sample_weight", F.lit(1.0))).drop("__stratum")


def sample_by(df: DataFrame, by: str, n: int, seed: int = 0, id_col: str = "review_id") -> DataFrame:
    """At most ``n`` rows of each value of ``by``: those whose seeded SHA-256 of the id is smallest. Null is a value."""
    order = F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))), 256)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order, id_col))
    return df.withColumn("__nth", nth).filter(F.col("__nth") <= n).drop("__nth")


def strata(df: DataFrame) -> DataFrame:
    """Population, labelled reviews and weights of each rating stratum of an analysis."""
    stratum = F.coalesce("sentiment_from_rating", F.lit("Unrated")).alias("stratum")
    labelled = F.col("in_label_sample")
    return df.filter("has_text").groupBy(stratum).agg(F.count(F.lit(1)).alias("with_text"), F.count_if(labelled).alias("labelled"), F.sum(F.when(labelled, F.col("sample_weight"))).alias("weight"))


def estimate_cost(df: DataFrame, text_col: str, input_price: float, output_price: float, batch: int = 25, prompt_tokens: int = 1200, output_tokens: int = 120) -> DataFrame:
    """Rows, batches, tokens and the upper cost of labelling every text by a hosted model; prices are per million tokens."""
    sums = df.filter(F.col(text_col).isNotNull()).agg(F.count(F.lit(1)).alias("reviews"), F.coalesce(F.sum(F.ceil(F.least(F.length(text_col), F.lit(2000)) / 4)), F.lit(0)).alias("text_tokens"))
    batches = F.ceil(F.col("reviews") / batch)
    tokens_in, tokens_out = F.col("text_tokens") + batches * prompt_tokens, F.col("reviews") * output_tokens
    return sums.select("reviews", batches.alias("batches"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"), F.round((tokens_in * input_price + tokens_out * output_price) / 1e6, 2).alias("cost"))


def explode_aspects(df: DataFrame, carry: list[str]) -> DataFrame:
    """A row for every aspect of a labelled review, with the review's columns carried along (no join)."""
    here = [c for c in carry if c in df.columns]
    return df.filter(is_labelled(F.col("label_source"))).select(*here, F.explode("aspects_ai").alias("__a")).select(*here, "__a.topic", "__a.polarity", "__a.issue")


def complaints(df: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each distinct issue of a labelled review, made distinct where the review lies."""
    here = [c for c in carry if c in df.columns]
    issues = F.array_distinct(F.transform(F.filter("aspects_ai", lambda a: a["polarity"] == "negative"), lambda a: a["issue"]))
    return df.filter(is_labelled(F.col("label_source"))).select(*here, F.explode(issues).alias("issue"))


def ask_model(texts: DataFrame, client: Callable[[list[tuple[str, str]]], dict[str, dict]], batch: int = 25) -> DataFrame:
    """``review_id`` and ``raw`` (JSON, null where there is none) for rows of ``review_id`` and ``t``, asked where they lie.

    A failing batch is halved until single texts, unless the failure is fatal; texts that a reply leaves out are asked for
    once more.
    """
    import json

    def ask(pairs: list[tuple[str, str]]) -> dict[str, dict]:
        try:
            return client(pairs)
        except Exception as e:  # noqa: BLE001 - any failure of the client is tried again on less
            if getattr(e, "fatal", False) or len(pairs) == 1:
                return {}
            half = len(pairs) // 2
            return {**ask(pairs[:half]), **ask(pairs[half:])}

    def run(frames):
        import pandas as pd

        for f in frames:
            pairs = [(str(i), t) for i, t in zip(f["review_id"], f["t"])]
            out: dict[str, dict] = {}
            for at in range(0, len(pairs), batch):
                some = pairs[at : at + batch]
                got = ask(some)
                if got and (skipped := [p for p in some if p[0] not in got]):
                    got = {**ask(skipped), **got}
                out.update(got)
            yield pd.DataFrame({"review_id": [i for i, _ in pairs], "raw": [json.dumps(out[i]) if i in out else None for i, _ in pairs]})

    return texts.select(F.col("review_id").cast("string"), "t").mapInPandas(run, "review_id string, raw string")


def with_raw_labels(df: DataFrame, profile: Profile, text_col: str, source: Column) -> DataFrame:
    """Label columns from the JSON in column ``raw``, by the baseline where there is none; ``source`` names where ``raw`` is from."""
    kind = f"struct<sentiment:string,primary_topic:string,aspects:array<{ASPECT}>,confidence:string,flags:map<string,boolean>>"
    out = baseline_labels(df.withColumn("__l", F.from_json("raw", kind)), profile, text_col)
    asked = F.col("__l").isNotNull()
    fields = {"sentiment_ai": "sentiment", "primary_topic_ai": "primary_topic", "aspects_ai": "aspects", "confidence_ai": "confidence"}
    out = out.withColumns({c: F.when(asked, F.col(f"__l.{f}")).otherwise(F.col(c)) for c, f in fields.items()})
    out = out.withColumns({f"flag_{f}": F.when(asked, F.coalesce(F.col("__l.flags")[f], F.lit(False))).otherwise(F.col(f"flag_{f}")) for f in profile.flags})
    out = out.withColumn("label_source", F.when(asked, source).when(F.col("label_source") == "baseline", "baseline_fallback").otherwise(F.col("label_source"))).drop("__l", "raw")
    labelled = repair_label(out.filter(is_labelled(F.col("label_source"))), profile)
    return with_primary_issue(labelled.unionByName(out.filter(~is_labelled(F.col("label_source")))))


def label_with(df: DataFrame, client: Callable[[list[tuple[str, str]]], dict[str, dict]], profile: Profile, text_col: str = "analysis_text", batch: int = 25, most_chars: int = 2000) -> DataFrame:
    """Labels from an injected model client, by batches of texts where the rows lie; no network is used unless the client does.

    ``client`` takes (id, text) pairs and returns raw labels by id. What it leaves out falls back to the baseline.
    """
    raw = ask_model(df.filter(F.col(text_col).isNotNull()).select("review_id", guarded(F.col(text_col), most_chars).alias("t")), client, batch)
    return with_raw_labels(df.join(raw, "review_id", "left"), profile, text_col, F.lit("ai"))
