"""Text and value parsers as column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mean no value, in any case.
MISSING_TOKENS = ("", "nan", "none", "null", "n/a", "na", "-", "--", "?")
#: Tokens that the CSV reader itself takes for null.
CSV_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Number words of ratings.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
#: What named references stand for, by Python's table, the usual ones first, as a map is searched in its order; and those to
#: 128-159, by Windows-1252, blank where it has no sign.
_NAMED = {k: chr(name2codepoint[k]) for k in ("amp", "lt", "gt", "quot", "nbsp")} | {"apos": "'"} | {k: chr(v) for k, v in name2codepoint.items()}
_WINDOWS = [bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)]
#: Date layouts in the order in which they are tried; ambiguous dates are month first.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy", "M/d/yyyy H:mm", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "yyyy/M/d", "d.M.yyyy", "yyyyMMdd")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*MISSING_TOKENS)


def csv_null(c: Column) -> Column:
    return F.when(~c.isin(*CSV_NULLS), c)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescape(c: Column) -> Column:
    """Character references decoded once, named and numeric: each distinct one is replaced, those that give ``&`` last."""

    def value(ref: Column) -> Column:
        inside = lambda at: F.substring(ref, F.lit(at), F.length(ref) - at)  # noqa: E731 - up to the semicolon
        code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(inside(4), 16, 10)).otherwise(inside(3)).try_cast("int")
        # a fixed map: it is made once, when the query is planned
        named = F.try_element_at(F.str_to_map(F.lit("\n".join(f"{k} {v}" for k, v in _NAMED.items())), F.lit("\n"), F.lit(" ")), inside(2))
        sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), 0xFFFD).otherwise(n)), 8, "0")), "UTF-32")
        numeric = _with(code, lambda n: F.when(n.between(128, 159), F.coalesce(F.nullif(F.get(F.split(F.lit("\n".join(_WINDOWS)), "\n"), n - 128), F.lit("")), sign(n))).otherwise(sign(n)))
        return F.when(ref.startswith("&#"), numeric).otherwise(named)

    def decoded(text: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#\d{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,9});"), 0))
        pairs = F.filter(F.transform(refs, lambda r: F.struct(r.alias("r"), value(r).alias("v"))), lambda p: p["v"].isNotNull())
        in_turn = F.array_sort(F.transform(pairs, lambda p: F.struct((p["v"] == "&").alias("last"), p["r"].alias("r"), p["v"].alias("v"))))
        return F.aggregate(in_turn, text, lambda acc, p: F.replace(acc, p["r"], p["v"]))

    return F.when(c.contains("&"), _with(c, decoded)).otherwise(c)


def escape(c: Column) -> Column:
    """Text that can't open a tag or an attribute."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def guarded(c: Column, most_chars: int) -> Column:
    """At most so many characters, for a model's prompt."""
    return F.when(F.length(c) > most_chars, F.substring(c, 1, most_chars)).otherwise(c)


def clean_text(c: Column) -> Column:
    """References decoded, then tags made spaces, then white space made one space; null where nothing is left."""
    plain = trimmed(F.regexp_replace(F.regexp_replace(unescape(c), r"<[^>]+>", " "), r"(?U)\s+", " "))
    return F.when(~is_missing(c), _with(plain, lambda p: F.when(~is_missing(p), p)))


def for_matching(c: Column) -> Column:
    """Lower case, marks made spaces, white space made one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def parse_rating(c: Column, scale_max: int) -> Column:
    """A number out of ``4``, ``4.0``, ``4/5``, ``4 stars``, ``four``; x/N only if N is the scale's maximum."""
    t = F.lower(trimmed(c))
    word = trimmed(F.regexp_replace(t, r"\s*stars?$", ""))
    named = F.lit(None).cast("double")
    for n, w in reversed(list(enumerate(NUMBER_WORDS))):
        named = F.when(word == w, float(n)).otherwise(named)
    # a fixed pattern
    pattern = r"^(-?\d+(?:\.\d+)?)\s*(?:/(\d+)|stars?|★)?$"
    of = F.regexp_extract(t, pattern, 2)
    number = F.when(t.rlike(pattern) & ((of == "") | (of == str(scale_max))), F.regexp_extract(t, pattern, 1).try_cast("double"))
    return F.when(~is_missing(c), F.coalesce(named, number))


def valid_rating(parsed: Column, low: float, high: float) -> Column:
    return F.when(parsed.between(low, high), F.floor(parsed + 0.5).cast("double"))


def parse_number(c: Column) -> Column:
    """The first number in the text, without thousands separators."""
    # a fixed pattern
    found = F.regexp_extract(c, r"(-?\d[\d,]*(?:\.\d+)?|-?\.\d+)", 1)
    return F.when(~is_missing(c), F.replace(found, F.lit(","), F.lit("")).try_cast("double"))


def in_range(value: Column, valid_range: tuple[float, float] | None) -> Column:
    """The value, or null outside the range, both ends included."""
    return F.when(value.between(*valid_range), value) if valid_range else value


def corrected(c: Column, aliases: dict[str, str]) -> Column:
    """The value that an alias stands for, else the value."""
    out = c
    for k, v in aliases.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def parse_date(c: Column) -> Column:
    t = trimmed(c)
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]
    offset = t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$")
    return F.when(~is_missing(c), F.when(offset, t.try_cast("timestamp").cast("date")).otherwise(F.coalesce(*tries).cast("date")))


def plausible_date(d: Column, reference_date: str, earliest: str = "2000-01-01") -> Column:
    return F.when((d <= F.lit(reference_date).cast("date")) & (d >= F.lit(earliest).cast("date")), d)


def parse_outcome(c: Column, positive: list[str], negative: list[str]) -> Column:
    """1 or 0 by token, else null; ``1.0`` counts as ``1``."""
    t = F.lower(trimmed(c))
    n = t.try_cast("double")
    t = F.when(n.isNotNull() & (n == F.floor(n)), F.floor(n).cast("string")).otherwise(t)
    return F.when(t.isin(*positive), 1.0).when(t.isin(*negative), 0.0)


def with_title(title: Column, text: Column) -> Column:
    """Title, a full stop where it has no end mark, and text; else whichever there is."""
    end = F.when(title.rlike(r"[.!?]$"), " ").otherwise(". ")
    return F.when(title.isNotNull() & text.isNotNull(), F.concat(title, end, text)).otherwise(F.coalesce(title, text))


def word_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def split_labels(c: Column) -> Column:
    """Items between semicolons, trimmed, in order, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))


def to_bool(c: Column) -> Column:
    t = F.lower(trimmed(c.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def parse_aspects(c: Column) -> Column:
    """``Topic:polarity:Issue|…`` as an array of structs; issue null where empty."""
    parts = F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x) != ""), lambda x: F.split(x, ":"))
    at = lambda p, i: F.trim(F.coalesce(F.get(p, F.lit(i)), F.lit("")))
    return F.transform(parts, lambda p: F.struct(at(p, 0).alias("topic"), at(p, 1).alias("polarity"), F.when(at(p, 2) != "", at(p, 2)).alias("issue")))


def keyword_regex(words: list[str]) -> str:
    """Whole words or phrases with regular endings, never the start of a longer word."""
    quoted = [re.sub(r"([^\w\s])", r"\\\1", w) + ("(?:s|d)?" if w.lower().endswith("e") else "(?:s|es|ed|ing)?") for w in words]
    return r"(?iU)\b(?:" + "|".join(quoted) + r")(?!\w)"


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?iU)(?<=[.!?])\s+|\s+(?:but|however|unfortunately)\s+"), lambda s: s != "")


def split_side(id_col: Column) -> Column:
    """``tune`` where the SHA-256 of the id is even, else ``test``."""
    last = F.conv(F.right(F.sha2(id_col.cast("string"), 256), F.lit(1)), 16, 10).cast("int")
    return F.when(last % 2 == 0, "tune").otherwise("test")


def band(c: Column, bins: list[float], labels: list[str], closed: str = "right") -> Column:
    """The label of the band that holds the value. ``right``: (a, b], the first closed on both sides; ``left``: [a, b)."""
    chosen = F.lit(None).cast("string")
    for i in range(len(labels) - 1, -1, -1):
        low, high = bins[i], bins[i + 1]
        inside = (c >= low) & (c < high) if closed == "left" else ((c >= low) if i == 0 else (c > low)) & (c <= high)
        chosen = F.when(inside, labels[i]).otherwise(chosen)
    return chosen
