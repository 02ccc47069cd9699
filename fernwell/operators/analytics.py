"""Analytics tables over a feedback DataFrame: KPIs, distributions, trends, groups, bands, significance and priority.

Every table is one aggregation of additive parts followed by a projection. Counts are raw; shares and averages are
weighted. A missing weight column weighs 1, a null weight 0. Absent columns give null metrics, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwell.functions.numbers import half_even, percent, ratio, strength, two_proportion_p
from fernwell.functions.text import band

SENTIMENTS = ("Positive", "Neutral", "Negative")
MIN_GROUP = 15
TREND_POINTS, SIGNIFICANCE = 2.0, 0.05
HIGH_INDEX, MEDIUM_INDEX = 60, 25


@dataclass(frozen=True)
class Scale:
    low: int = 1
    high: int = 5
    negative_max: int = 2
    positive_min: int = 4

    def sentiment(self, rating: Column) -> Column:
        return F.when(rating <= self.negative_max, "Negative").when(rating >= self.positive_min, "Positive").when(rating.isNotNull(), "Neutral")


def column(df: DataFrame, name: str | None, kind: str) -> Column:
    return F.col(name).cast(kind) if name and name in df.columns else F.lit(None).cast(kind)


def weights(df: DataFrame, name: str | None) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name and name in df.columns else F.lit(1.0)


def parts(df: DataFrame, sentiment_col: str, weight_col: str | None, scale: Scale, outcomes: tuple[str, ...] = ()) -> list[Column]:
    """The additive parts of every metric."""
    w, rating, s = weights(df, weight_col), column(df, "rating", "double"), column(df, sentiment_col, "string")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    given = lambda cond, v: F.when(cond, v).otherwise(0.0)
    out = [
        F.count(F.lit(1)).alias("n"),
        total(w).alias("w"),
        F.count(rating).alias("n_rated"),
        total(given(rating.isNotNull(), w)).alias("w_rated"),
        total(given(rating.isNotNull(), w * rating)).alias("w_rating"),
        total(given(rating <= scale.negative_max, w)).alias("w_low"),
        F.count(s).alias("n_sent"),
        total(given(s.isNotNull(), w)).alias("w_sent"),
        total(given(s.isNotNull(), w * w)).alias("w2_sent"),
        *(total(given(s == x, w)).alias(f"w_{x.lower()}") for x in SENTIMENTS),
    ]
    for o in outcomes:
        v = column(df, o, "double")
        out += [total(given(v.isNotNull(), w)).alias(f"w_{o}_valid"), total(given(v == 1.0, w)).alias(f"w_{o}_yes")]
    return out


def metrics(outcomes: tuple[str, ...] = ()) -> list[Column]:
    """The metrics of summed parts."""
    c = F.col
    return [
        c("n").alias("reviews"),
        ratio(c("w_rating"), c("w_rated")).alias("avg_rating"),
        percent(c("w_negative"), c("w_sent")).alias("pct_negative"),
        percent(c("w_low"), c("w_rated")).alias("pct_low_rating"),
        *(percent(c(f"w_{o}_yes"), c(f"w_{o}_valid")).alias(f"pct_{o}") for o in outcomes),
    ]


def overview(df: DataFrame, sentiment_col: str, weight_col: str | None = None, scale: Scale = Scale(), dimensions: tuple[str, ...] = ()) -> DataFrame:
    """All key figures in one row, by one aggregation."""
    w = weights(df, weight_col)
    text = column(df, "has_text", "boolean")
    extra = [
        F.count_if(text).alias("reviews_with_text"),
        F.coalesce(F.max(F.abs(w - 1.0)) > 1e-5, F.lit(False)).alias("weighted"),
        F.min(column(df, "date", "date")).alias("date_min"),
        F.max(column(df, "date", "date")).alias("date_max"),
        *(F.count_distinct(F.col(d)).alias(f"n_{d}") for d in dimensions if d in df.columns),
    ]
    c = F.col
    return df.agg(*parts(df, sentiment_col, weight_col, scale), *extra).select(
        c("n").alias("total_reviews"),
        "reviews_with_text",
        c("n_rated").alias("rated_reviews"),
        ratio(c("w_rating"), c("w_rated")).alias("avg_rating"),
        *(percent(c(f"w_{s.lower()}"), c("w_sent")).alias(f"pct_{s.lower()}") for s in SENTIMENTS),
        percent(c("w_low"), c("w_rated")).alias("pct_low_rating"),
        "weighted",
        "date_min",
        "date_max",
        *(f"n_{d}" for d in dimensions if d in df.columns),
    )


def _spine(df: DataFrame, values: list, name: str, kind: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} {kind}, __nth int")


def rating_distribution(df: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Count and share of every step of the scale, none left out."""
    counts = df.filter(F.col("rating").isNotNull()).groupBy(F.col("rating").cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("k"))
    steps = _spine(df, list(range(scale.low, scale.high + 1)), "rating", "int")
    total = counts.agg(F.sum("k").alias("total"))  # one row
    joined = steps.join(counts, "rating", "left").crossJoin(F.broadcast(total))
    k = F.coalesce("k", F.lit(0))
    return joined.select("rating", k.cast("long").alias("reviews"), percent(k, F.col("total")).alias("pct")).orderBy("rating")


def sentiment_distribution(df: DataFrame, sentiment_col: str, weight_col: str | None = None) -> DataFrame:
    """Raw counts and weighted shares of the three sentiments."""
    w = weights(df, weight_col)
    counts = df.filter(F.col(sentiment_col).isNotNull()).groupBy(F.col(sentiment_col).alias("sentiment")).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"))
    total = counts.agg(F.sum("w").alias("total"))  # one row
    joined = _spine(df, list(SENTIMENTS), "sentiment", "string").join(counts, "sentiment", "left").crossJoin(F.broadcast(total))
    return joined.orderBy("__nth").select("sentiment", F.coalesce("k", F.lit(0)).cast("long").alias("reviews"), percent(F.coalesce("w", F.lit(0.0)), F.col("total")).alias("pct"))


def value_counts(df: DataFrame, col: str, order: list[str], none: str = "none", name: str | None = None) -> DataFrame:
    """Counts of the listed values, null as ``none``, with their share of all rows."""
    name = name or col
    counts = df.groupBy(F.coalesce(F.col(col), F.lit(none)).alias(name)).agg(F.count(F.lit(1)).alias("k"))
    total = counts.agg(F.sum("k").alias("total"))  # one row
    joined = _spine(df, order, name, "string").join(counts, name).crossJoin(F.broadcast(total))
    return joined.orderBy("__nth").select(name, F.col("k").alias("reviews"), percent(F.col("k"), F.col("total")).alias("pct_of_rows"))


def month_of(c: Column) -> Column:
    return F.trunc(c.cast("date"), "MM")


def over_time(df: DataFrame, sentiment_col: str, weight_col: str | None = None, scale: Scale = Scale(), month_col: str = "month") -> DataFrame:
    """A row for every month from the first to the last; months without a review have null metrics."""
    months = df.filter(F.col(month_col).isNotNull()).groupBy(F.col(month_col).alias("month")).agg(*parts(df, sentiment_col, weight_col, scale))
    span = months.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return (
        span.join(months, "month", "left")
        .select("month", n.alias("reviews"), ratio(F.col("w_rating"), F.col("w_rated")).alias("avg_rating"), percent(F.col("w_negative"), F.col("w_sent")).alias("pct_negative"), (n >= MIN_GROUP).alias("reliable"))
        .orderBy("month")
    )


def sentiment_over_time(df: DataFrame, sentiment_col: str, weight_col: str | None = None, month_col: str = "month") -> DataFrame:
    """Three rows for every month with a sentiment; gaps are not filled."""
    rows = df.filter(F.col(month_col).isNotNull() & F.col(sentiment_col).isNotNull())
    w = weights(df, weight_col)
    sums = [x for s in SENTIMENTS for x in (F.count_if(F.col(sentiment_col) == s).alias(f"n_{s}"), F.coalesce(F.sum(F.when(F.col(sentiment_col) == s, w)), F.lit(0.0)).alias(f"w_{s}"))]
    months = rows.groupBy(F.col(month_col).alias("month")).agg(F.sum(w).alias("total"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(s).alias("sentiment"), F.col(f"n_{s}").alias("reviews"), percent(F.col(f"w_{s}"), F.col("total")).alias("pct")) for i, s in enumerate(SENTIMENTS)]))
    return months.select("month", each.alias("x")).orderBy("month", "x.nth").select("month", "x.sentiment", "x.reviews", "x.pct")


def recent_change(df: DataFrame, group_col: str, sentiment_col: str, weight_col: str | None = None, months: int = 3, month_col: str = "month") -> DataFrame:
    """The last ``months`` months against those before, by group; both windows hang on the newest month of all rows."""
    last = df.agg(F.max(month_col).alias("last"))  # one row
    w, s = weights(df, weight_col), F.col(sentiment_col)
    rows = df.filter(F.col(group_col).isNotNull() & F.col(month_col).isNotNull()).crossJoin(F.broadcast(last))
    ago = F.months_between(F.col("last"), F.col(month_col))
    spans = {"recent": ago < months, "previous": (ago >= months) & (ago < 2 * months)}
    sums = []
    for name, inside in spans.items():
        held = inside & s.isNotNull()
        sums += [
            F.count_if(held).alias(f"{name}_reviews"),
            F.sum(F.when(held, w)).alias(f"{name}_w"),
            F.sum(F.when(held, w * w)).alias(f"{name}_w2"),
            F.coalesce(F.sum(F.when(held & (s == "Negative"), w)), F.lit(0.0)).alias(f"{name}_neg"),
        ]
    by_group = rows.filter(ago < 2 * months).groupBy(F.col(group_col).alias("group")).agg(*sums)
    pct = {k: percent(F.col(f"{k}_neg"), F.col(f"{k}_w")) for k in spans}
    kish = {k: F.when(F.col(f"{k}_w2") > 0, F.col(f"{k}_w") * F.col(f"{k}_w") / F.col(f"{k}_w2")) for k in spans}
    done = by_group.select("group", *[c for k in ("previous", "recent") for c in (F.col(f"{k}_reviews"), pct[k].alias(f"{k}_pct_negative"), kish[k].alias(f"{k}_n"))]).withColumn(
        "change_pp", half_even(F.col("recent_pct_negative") - F.col("previous_pct_negative"), 1)
    )
    p = two_proportion_p(F.col("recent_pct_negative"), F.col("recent_n"), F.col("previous_pct_negative"), F.col("previous_n"))
    done = done.withColumn("p_value", p).withColumn("reliable", F.least("recent_reviews", "previous_reviews") >= MIN_GROUP)
    sure = F.col("reliable") & (F.col("p_value") < SIGNIFICANCE)
    direction = (
        F.when(F.col("change_pp").isNull() | ~F.col("reliable"), "Not enough data")
        .when(sure & (F.col("change_pp") >= TREND_POINTS), "Increasing")
        .when(sure & (F.col("change_pp") <= -TREND_POINTS), "Decreasing")
        .otherwise("No clear change")
    )
    return done.select("group", "previous_reviews", "previous_pct_negative", "recent_reviews", "recent_pct_negative", "change_pp", "p_value", direction.alias("direction"), "reliable").orderBy(F.desc_nulls_last("change_pp"), "group")


def group_summary(df: DataFrame, by: str, sentiment_col: str, weight_col: str | None = None, scale: Scale = Scale(), outcomes: tuple[str, ...] = (), observed_sentiment: str | None = None) -> DataFrame:
    """Metrics of every non-null group. With ``observed_sentiment`` all metrics but pct_negative are unweighted."""
    rows = df.filter(F.col(by).isNotNull())
    if observed_sentiment is None:
        groups = rows.groupBy(F.col(by).alias("group")).agg(*parts(df, sentiment_col, weight_col, scale, outcomes))
        measured = groups.select("group", *metrics(outcomes), "w")
    else:
        w, s = weights(df, weight_col), F.col(sentiment_col)
        own = [F.coalesce(F.sum(F.when(s == "Negative", w)), F.lit(0.0)).alias("p_neg"), F.coalesce(F.sum(F.when(s.isNotNull(), w)), F.lit(0.0)).alias("p_sent")]
        groups = rows.groupBy(F.col(by).alias("group")).agg(*parts(df, observed_sentiment, None, scale, outcomes), *own)
        measured = groups.select("group", *metrics(outcomes), "w", percent(F.col("p_neg"), F.col("p_sent")).alias("primary")).withColumn("pct_negative", F.col("primary"))
    total = measured.agg(F.sum("w").alias("total"))  # one row
    c = F.col
    return (
        measured.crossJoin(F.broadcast(total))
        .select("group", "reviews", percent(c("w"), c("total")).alias("pct_of_reviews"), "avg_rating", "pct_negative", "pct_low_rating", *(f"pct_{o}" for o in outcomes), (c("reviews") >= MIN_GROUP).alias("reliable"))
        .orderBy(F.desc("reviews"), "group")
    )


def breakdowns(df: DataFrame, dimensions: tuple[str, ...], sentiment_col: str, weight_col: str | None = None, scale: Scale = Scale(), outcomes: tuple[str, ...] = ()) -> DataFrame:
    """``group_summary`` of several dimensions in one scan, by grouping sets over an unpivoted key."""
    key = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions]))
    rows = df.withColumn("__key", key).filter(F.col("__key.group").isNotNull())
    groups = rows.groupBy(F.col("__key.dimension").alias("dimension"), F.col("__key.group").alias("group")).agg(*parts(df, sentiment_col, weight_col, scale, outcomes))
    total = F.sum("w").over(Window.partitionBy("dimension"))
    return groups.select("dimension", "group", *metrics(outcomes), percent(F.col("w"), total).alias("pct_of_reviews"), (F.col("n") >= MIN_GROUP).alias("reliable")).orderBy("dimension", F.desc("reviews"), "group")


def band_summary(df: DataFrame, col: str, bins: list[float] | None = None, labels: list[str] | None = None, closed: str = "right", quantiles: int = 4, scale: Scale = Scale()) -> DataFrame:
    """Metrics of every band, empty ones too; without ``bins`` the bands are quantiles with interpolated edges."""
    rated = df.filter(F.col("rating").isNotNull() & F.col(col).isNotNull())
    if bins is None:
        bins = sorted(set(quantiles_of(rated, col, [i / quantiles for i in range(quantiles + 1)])))
        labels = [f"{a:,.0f}–{b:,.0f}" for a, b in zip(bins, bins[1:])]
        if len(set(labels)) < len(labels):
            labels = [f"({a:g}, {b:g}]" for a, b in zip(bins, bins[1:])]
        closed = "right"
    labels = labels or []
    value = F.col(col).cast("double")
    low = F.sum(F.when(F.col("rating") <= scale.negative_max, 1).otherwise(0))
    found = rated.withColumn("band", band(value, bins, labels, closed)).filter(F.col("band").isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.avg("rating").alias("a"), low.alias("l"))
    k = F.coalesce("k", F.lit(0)).cast("long")
    return _spine(df, labels, "band", "string").join(found, "band", "left").orderBy("__nth").select("band", k.alias("reviews"), half_even(F.col("a"), 2).alias("avg_rating"), percent(F.col("l"), F.col("k")).alias("pct_low_rating"), (k >= MIN_GROUP).alias("reliable"))


def cumulative(counts: DataFrame, pieces: int = 64) -> DataFrame:
    """``v``, ``k`` and ``upto``, the rows up to and with each value, of distinct values and their counts.

    Values are dealt over range pieces, whose sums give each piece its start, so that no task orders all of them.
    """
    edges = counts.agg(F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 1000).alias("e")).first()["e"] or []  # pieces numbers
    piece = reduce(lambda a, e: a + F.when(F.col("v") > e, 1).otherwise(0), sorted(set(edges)), F.lit(0))
    counts = counts.withColumn("piece", piece)
    starts = counts.groupBy("piece").agg(F.sum("k").alias("s")).withColumn("start", F.coalesce(F.sum("s").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("k").over(Window.partitionBy("piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("inside", inside).join(F.broadcast(starts.select("piece", "start")), "piece").select("v", "k", (F.col("start") + F.col("inside")).alias("upto"))  # pieces rows


def quantiles_of(df: DataFrame, col: str, shares: list[float]) -> list[float]:
    """Exact quantiles, interpolated between neighbours; no rows: none."""
    upto = cumulative(df.groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k")))
    n = df.count()
    if not n:
        return []
    at = [share * (n - 1) for share in shares]
    places = sorted({int(x) for x in at} | {min(int(x) + 1, n - 1) for x in at})
    found = upto.agg(*[F.min(F.when(F.col("upto") > i, F.col("v"))).alias(f"p{i}") for i in places]).first()  # two numbers a share
    value = {i: found[f"p{i}"] for i in places}
    return [value[int(x)] + (value[min(int(x) + 1, n - 1)] - value[int(x)]) * (x - int(x)) for x in at]


def average_ranks(counts: DataFrame) -> DataFrame:
    """Each value of ``counts`` (``v``, ``k``) with its average rank."""
    return cumulative(counts).select("v", (F.col("upto") - F.col("k") + (F.col("k") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, col: str, target: str = "rating") -> DataFrame:
    """One row: n, rho (3 decimals) and strength; null below 15 rows or two distinct values.

    Rows are counted by pair of values first; ranks and their correlation come from the counts.
    """
    rows = df.filter(F.col(col).isNotNull() & F.col(target).isNotNull())
    pairs = rows.groupBy(F.col(col).cast("double").alias("x"), F.col(target).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    of = lambda c, name: average_ranks(pairs.groupBy(F.col(c).alias("v")).agg(F.sum("k").alias("k"))).select(F.col("v").alias(c), F.col("rank").alias(name))
    ranked = pairs.join(of("x", "rx"), "x").join(of("y", "ry"), "y")
    middle = pairs.agg(((F.sum("k") + 1) / 2).alias("mid"))  # ranks are taken from their mean, which keeps the sums small
    a, b, k = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid"), F.col("k")
    sums = ranked.crossJoin(F.broadcast(middle)).agg(F.coalesce(F.sum(k), F.lit(0)).alias("n"), F.sum(k * a * b).alias("ab"), F.sum(k * a * a).alias("aa"), F.sum(k * b * b).alias("bb"))  # one row
    enough = (F.col("n") >= MIN_GROUP) & (F.col("aa") > 0) & (F.col("bb") > 0)
    return sums.select("n", F.when(enough, half_even(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 3)).alias("rho")).withColumn("strength", strength(F.col("rho")))


def benjamini_hochberg(df: DataFrame, p_col: str, q_col: str = "q_value") -> DataFrame:
    """Adds the false-discovery-rate adjusted p; null counts as 1. One row per tested group, so the windows are small."""
    p = F.coalesce(F.col(p_col), F.lit(1.0))
    ranked = df.withColumn("__p", p).withColumn("__rank", F.row_number().over(Window.orderBy("__p"))).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy()))
    low = F.min(F.col("__p") * F.col("__m") / F.col("__rank")).over(Window.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(q_col, half_even(F.least(low, F.lit(1.0)), 4)).drop("__p", "__rank", "__m")


def low_rating_drivers(df: DataFrame, dimensions: tuple[str, ...], scale: Scale = Scale(), min_group: int = MIN_GROUP) -> DataFrame:
    """Groups whose share of low ratings differs from the rest, over all dimensions together, in one scan."""
    rated = df.filter(F.col("rating").isNotNull())
    key = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions]))
    low = F.when(F.col("rating") <= scale.negative_max, 1).otherwise(0)
    groups = rated.select(key.alias("k"), low.alias("low")).filter(F.col("k.group").isNotNull()).groupBy(F.col("k.dimension").alias("dimension"), F.col("k.group").alias("group")).agg(F.count(F.lit(1)).alias("reviews"), F.sum("low").alias("l"))
    total = rated.agg(F.count(F.lit(1)).alias("all_n"), F.sum(low).alias("all_low"))  # one row
    c = F.col
    kept = groups.filter(c("reviews") >= min_group).withColumn("pct_low_rating", percent(c("l"), c("reviews"))).crossJoin(F.broadcast(total)).filter("all_low > 0")
    group_low = c("pct_low_rating") / 100.0 * c("reviews")  # from the rounded share, as it is shown
    rest_n = c("all_n") - c("reviews")
    rest_pct = F.when(rest_n > 0, 100.0 * (c("all_low") - group_low) / rest_n)
    tested = kept.withColumn("lift", half_even(c("pct_low_rating") / (100.0 * c("all_low") / c("all_n")), 2)).withColumn("p_value", two_proportion_p(c("pct_low_rating"), c("reviews"), rest_pct, rest_n))
    found = benjamini_hochberg(tested, "p_value")
    return found.select("dimension", "group", "reviews", "pct_low_rating", "lift", "p_value", "q_value", (c("q_value") < SIGNIFICANCE).alias("significant")).orderBy(F.desc("lift"), "dimension", "group")


def priority_table(df: DataFrame, group_col: str, sentiment_col: str, weight_col: str | None = None, total_weight: DataFrame | None = None, scale: Scale = Scale(), min_group: int = MIN_GROUP) -> DataFrame:
    """Groups by frequency times severity, on an index whose top eligible group has 100.

    ``total_weight``: one row with ``total``, where the weight of all rows of ``df`` is not it.
    """
    groups = df.filter(F.col(group_col).isNotNull()).groupBy(F.col(group_col).alias("group")).agg(*parts(df, sentiment_col, weight_col, scale))
    whole = df.agg(F.sum(weights(df, weight_col)).alias("total")) if total_weight is None else total_weight  # one row
    c = F.col
    total = c("total")
    gap = F.coalesce(F.least(F.greatest((scale.high - c("avg_rating")) / (scale.high - scale.low), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    scored = (
        groups.crossJoin(F.broadcast(whole))
        .select("group", *metrics(), percent(c("w"), total).alias("frequency_pct"))
        .withColumn("severity", half_even(F.coalesce(c("pct_negative"), F.lit(0.0)) / 100 * gap, 3))
        .withColumn("score", c("frequency_pct") / 100 * c("severity"))
        .withColumn("eligible", c("reviews") >= min_group)
    )
    best = scored.agg(F.max(F.when(c("eligible"), c("score"))).alias("top"))  # one row
    scored = scored.crossJoin(F.broadcast(best))
    index = F.when(c("eligible"), F.when(c("top") > 0, F.rint(100 * c("score") / c("top"))).otherwise(0.0))
    level = F.when(~c("eligible"), "Insufficient data").when(c("priority_index") >= HIGH_INDEX, "High").when(c("priority_index") >= MEDIUM_INDEX, "Medium").otherwise("Low")
    place = F.when(c("priority") == "High", 0).when(c("priority") == "Medium", 1).when(c("priority") == "Low", 2).otherwise(3)
    ranked = scored.withColumn("priority_index", index).withColumn("priority", level)
    return ranked.orderBy(place, F.desc_nulls_last("priority_index"), "group").select("group", "reviews", "frequency_pct", "avg_rating", "pct_negative", "severity", "priority_index", "priority")
