"""From string columns to the typed feedback table, with an audit of every change.

Keep-first rules are aggregations (``min_by`` on the row order), not windows: a group of a third of all rows is combined
before the shuffle and never gathered.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernwell.functions import text as T
from fernwell.operators.analytics import Scale, month_of
from fernwell.sources.feedback import ORDER, CleaningReport, DataValidationError, load_csv, standardize_columns, validate_schema
from fernwell.sources.profile import Profile, detect_profile, load_profile

SHORTEST_DUPLICATE, TRUNCATION_SHARE, TRUNCATION_WINDOW, TRUNCATION_LEAST = 20, 0.01, 10, 20


def first_rows(df: DataFrame, keys: list[Column], order: str = ORDER) -> DataFrame:
    """The first row, by ``order``, of every key; null keys are equal."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(order)).alias("r")).select("r.*")


def drop_exact_duplicates(df: DataFrame, ignore: list[str] = ()) -> DataFrame:
    return first_rows(df, [F.col(f"`{c}`") for c in df.columns if c != ORDER and c not in ignore])


def drop_resubmissions(df: DataFrame, text_col: str, keys: list[str], shortest: int = SHORTEST_DUPLICATE) -> DataFrame:
    """The first of the rows whose normalised text and keys are equal; short texts are all kept.

    Texts are told apart by their length and 128 bits of hash, so that no text is part of a key; a short text's key is its row.
    """
    seen = df.withColumn("__m", T.for_matching(F.col(text_col)))
    m, long = F.col("__m"), F.coalesce(F.length("__m") >= shortest, F.lit(False))
    key = F.when(long, F.struct(F.length(m).cast("long").alias("n"), F.xxhash64(m).alias("a"), F.xxhash64(F.lit(1), m).alias("b"))).otherwise(F.struct(F.lit(-1).cast("long").alias("n"), F.col(ORDER).alias("a"), F.col(ORDER).alias("b")))
    return first_rows(seen.withColumn("__m", key), [F.col("__m.n"), F.col("__m.a"), F.col("__m.b"), *[F.col(k) for k in keys]]).drop("__m")


def canonical_labels(df: DataFrame, col: str, order: str = ORDER) -> DataFrame:
    """Each label becomes the most frequent spelling of its case-insensitive group; ties go to the one seen first."""
    cleaned = T.clean_text(F.col(col))
    rows = df.withColumn(col, cleaned).withColumn("__key", F.lower(F.col(col)))
    spellings = rows.filter(F.col("__key").isNotNull()).groupBy("__key", col).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    best = spellings.groupBy("__key").agg(F.max_by(col, F.struct(F.col("n"), -F.col("o"))).alias("__best"))
    return rows.join(best, "__key", "left").withColumn(col, F.col("__best")).drop("__key", "__best")


def numbered(df: DataFrame, name: str, order: str = ORDER) -> DataFrame:
    """Rows numbered from 1 in ``order``, without one task ordering all: read partitions are counted first."""
    piece = F.shiftright(F.col(order), 33)
    counts = df.groupBy(piece.alias("__piece")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("__piece", F.coalesce(F.sum("n").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row for each read partition
    inside = F.row_number().over(Window.partitionBy("__piece").orderBy(order))
    return df.withColumn("__piece", piece).join(starts, "__piece").withColumn(name, F.col("__start") + inside).drop("__piece", "__start")


def ensure_ids(df: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Missing ids are generated in row order, repeated ones get a suffix."""
    if id_col not in df.columns:
        df = df.withColumn(id_col, F.lit(None).cast("string"))
    df = df.withColumn(id_col, T.clean_text(F.col(id_col).cast("string")))
    made = numbered(df.filter(F.col(id_col).isNull()), "__nth").withColumn(id_col, F.format_string("gen_%06d", F.col("__nth"))).drop("__nth")
    every = df.filter(F.col(id_col).isNotNull()).unionByName(made.select(*df.columns))
    again = F.row_number().over(Window.partitionBy(id_col).orderBy(ORDER)) - 1
    return every.withColumn("__again", again).withColumn(id_col, F.when(F.col("__again") > 0, F.concat(F.col(id_col), F.lit("_dup"), F.col("__again").cast("string"))).otherwise(F.col(id_col))).drop("__again")


def truncation(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Adds ``text_truncated``: texts near the longest length that end mid-sentence, if there are many of them."""
    length = F.length(text_col)
    longest = df.agg(F.max(length).alias("m"), F.count(text_col).alias("n")).first()  # one row
    if longest["m"] is None:
        return df.withColumn("text_truncated", F.lit(False))
    near = length >= longest["m"] - TRUNCATION_WINDOW
    if df.filter(near).count() < max(TRUNCATION_LEAST, TRUNCATION_SHARE * longest["n"]):
        return df.withColumn("text_truncated", F.lit(False))
    return df.withColumn("text_truncated", F.coalesce(near & ~F.col(text_col).rlike("[.!?…\"'”’)\\]]\\s*$"), F.lit(False)))


def usable() -> Column:
    """Whether a row has a text or a rating."""
    return F.col("has_text") | F.col("rating").isNotNull()


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values of each column are missing."""
    return df.agg(*[F.count_if(T.is_missing(F.col(c))).alias(c) for c in columns])


def derived(df: DataFrame, scale: Scale) -> DataFrame:
    rating = F.col("rating")
    out = df.withColumn("word_count", T.word_count(F.col("review_text"))).withColumn("sentiment_from_rating", scale.sentiment(rating)).withColumn("is_low_rating", F.coalesce(rating <= scale.negative_max, F.lit(False)))
    return out.withColumn("month", month_of(F.col("date"))) if "date" in out.columns else out


def clean(df: DataFrame, report: CleaningReport, profile: Profile, reference_date: str | None = None) -> DataFrame:
    """The typed feedback table of a string DataFrame with canonical names; ``report`` is filled by a few aggregations."""
    reference_date = reference_date or datetime.date.today().isoformat()
    scale, roles = profile.scale, profile.resolve_roles(df.columns)
    missing = [F.count_if(T.is_missing(F.col(c))).alias(c) for c in df.columns if c in ("review_id", "review_text", "review_title", "rating", "date")]
    received = df.agg(F.count(F.lit(1)).alias("__n"), *missing).first()
    report.rows_received, report.missing_values_before = received["__n"], {k: v for k, v in received.asDict().items() if k != "__n"}
    data = drop_exact_duplicates(df, report.row_number_columns)
    flags: dict[str, Column] = {}
    raw = lambda c: F.col(f"__raw_{c}")
    given = lambda c: ~T.is_missing(raw(c))
    typed = [c for c in ("rating", "date", *(n.column for n in roles.numeric), *(o.column for o in roles.outcomes)) if c in data.columns]
    data = data.withColumns({f"__raw_{c}": F.col(c) for c in typed})
    data = data.withColumn("review_text", T.clean_text(F.col("review_text")))
    flags["Missing or empty review text"] = F.col("review_text").isNull()
    if "review_title" in data.columns:
        data = data.withColumn("review_title", T.clean_text(F.col("review_title")))
        flags["Title used as text (review text missing)"] = F.col("review_text").isNull() & F.col("review_title").isNotNull()
        data = data.withColumn("analysis_text", T.with_title(F.col("review_title"), F.col("review_text")))
    else:
        data = data.withColumn("analysis_text", F.col("review_text"))
    data = data.withColumn("has_text", F.col("analysis_text").isNotNull())
    has_rating, has_date = "rating" in data.columns, "date" in data.columns
    if has_rating:
        parsed = T.parse_rating(raw("rating"), scale.high)
        data = data.withColumn("rating", T.valid_rating(parsed, scale.low, scale.high))
        flags["Invalid rating (cleared)"] = given("rating") & F.col("rating").isNull()
        flags["Missing rating"] = ~given("rating")
        flags["Fractional rating rounded to whole star"] = F.col("rating").isNotNull() & (parsed != F.rint(parsed))
    else:
        data = data.withColumn("rating", F.lit(None).cast("double"))
        report.notes.append("No rating column: rating tables are not available.")
    if has_date:
        day = T.parse_date(raw("date"))
        data = data.withColumn("date", T.plausible_date(day, reference_date))
        flags["Unreadable date (cleared)"] = given("date") & day.isNull()
        flags["Future or implausible date (cleared)"] = day.isNotNull() & F.col("date").isNull()
    else:
        report.notes.append("No date column: trends are not available.")
    for c, aliases in (profile.raw.get("value_aliases") or {}).items():
        if c in data.columns:
            data = data.withColumn(f"__alias_{c}", F.col(c).isin(*aliases)).withColumn(c, T.corrected(F.col(c), aliases))
            flags[f"{roles.label_for(c)} value corrected"] = F.coalesce(F.col(f"__alias_{c}"), F.lit(False))
    for c in roles.dimensions:
        data = canonical_labels(data.withColumn(f"__raw_{c}", F.col(c)), c)
        before = T.clean_text(raw(c))
        flags[f"{roles.label_for(c)} name variant merged"] = before.isNotNull() & (before != F.col(c))
    for n in roles.numeric:
        data = data.withColumn(n.column, T.in_range(T.parse_number(raw(n.column)), n.valid_range))
        flags[f"Implausible {n.label.lower()} (cleared)"] = given(n.column) & F.col(n.column).isNull()
        if n.bins and n.band_column:
            data = data.withColumn(n.band_column, T.band(F.col(n.column), list(n.bins), list(n.band_labels), n.closed))
    for o in roles.outcomes:
        data = data.withColumn(o.column, T.parse_outcome(raw(o.column), list(o.positive), list(o.negative)))
        flags[f"Unreadable {o.label.lower()} value (cleared)"] = given(o.column) & F.col(o.column).isNull()
    data = truncation(data).persist()
    try:
        counts = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(~usable()).alias("bad"), F.count_if("text_truncated").alias("cut"), *[F.count_if(c).alias(f"f{i}") for i, c in enumerate(flags.values())]).first()
        report.flagged = {k: counts[f"f{i}"] for i, k in enumerate(flags) if counts[f"f{i}"]}
        if counts["cut"]:
            report.flagged["Text appears cut off by the source"] = counts["cut"]
        report.removed = {"Exact duplicate row": report.rows_received - counts["n"], "No review text and no valid rating" if has_rating else "No review text": counts["bad"]}
        kept = data.filter(usable()).drop(*[c for c in data.columns if c.startswith("__raw_") or c.startswith("__alias_")])
        keys = [*(["rating"] if has_rating else []), *([roles.entity] if roles.entity else []), *(["date"] if has_date else [])]
        unique = drop_resubmissions(kept, "analysis_text", keys)
        done = derived(ensure_ids(unique), scale)
        report.rows_retained = done.count()
        report.removed["Re-submitted review"] = counts["n"] - counts["bad"] - report.rows_retained
        report.removed = {k: v for k, v in report.removed.items() if v}
        return done.drop(ORDER)
    finally:
        data.unpersist()


def process(spark, source, profile: str | Profile | dict | None = None, reference_date: str | None = None, max_rows: int | None = None, folder: str | None = None) -> tuple[DataFrame, CleaningReport, Profile]:
    """Read, map, check and clean: the feedback table, its report and the profile in use."""
    report = CleaningReport()
    loaded = load_csv(spark, source, max_rows)
    names = [c for c in loaded.columns if c != ORDER]
    found, why = (load_profile(profile, folder), "given") if profile is not None else detect_profile(names, folder)
    report.notes.append(f"Profile {found.name}: {why}.")
    data = standardize_columns(loaded, report, found)
    validate_schema(data)
    if data.filter(~T.is_missing(F.col("review_text"))).isEmpty() and ("review_title" not in data.columns or data.filter(~T.is_missing(F.col("review_title"))).isEmpty()):
        raise DataValidationError("No row has a text.")
    cleaned = clean(data, report, found, reference_date)
    if report.rows_retained == 0:
        raise DataValidationError("No row is left after cleaning.")
    return cleaned, report, found
