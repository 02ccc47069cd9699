"""Findings in words, each of which names the table that it rests on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from fernwell.functions.numbers import half_even
from fernwell.operators.analytics import MIN_GROUP
from fernwell.plans.pipeline import AnalysisResult


@dataclass(frozen=True)
class Insight:
    kind: str
    text: str
    table: str
    small_sample: bool = False


def generate(result: AnalysisResult, top: int = 3) -> list[Insight]:
    """Top issues, groups with significantly more low ratings, praise, outcome shares, and advice for issues of high priority."""
    out: list[Insight] = []
    guess = "an estimated " if result.method == "ai" else ""
    rows = lambda name, f: f(result.table(name)).limit(top).collect() if name in result.tables and result.tables[name].available else []  # noqa: E731 - top rows
    issues = rows("issue_priority", lambda d: d.filter("priority <> 'Insufficient data'"))
    for r in issues:
        out.append(Insight("issue", f"{r['group']}: {guess}{r['frequency_pct']}% of reviews mention it (priority {r['priority'].lower()}).", "issue_priority", (r["reviews"] or 0) < MIN_GROUP))
    for r in rows("low_rating_drivers", lambda d: d.filter("significant and lift > 1")):
        out.append(Insight("segment", f"{result.roles.label_for(r['dimension'])} {r['group']} gets {r['lift']} times the average share of low ratings ({r['pct_low_rating']}%).", "low_rating_drivers", r["reviews"] < MIN_GROUP))
    for r in rows("praise", lambda d: d.filter(F.col("topic") != "Other")):
        out.append(Insight("praise", f"{r['topic']}: {guess}{r['est_pct_of_reviews']}% of reviews praise it.", "praise", r["reviews"] < MIN_GROUP))
    for o in result.roles.outcomes:
        share = F.count_if(F.col(o.column) == 1.0) / F.count(o.column)
        r = result.data.agg(F.count(o.column).alias("n"), half_even(100 * share, 1).alias("pct")).first()  # one row
        if r["n"]:
            out.append(Insight("outcome", f"{o.label}: {r['pct']}% of the {r['n']} reviews that say so.", f"outcome_agreement:{o.column}", r["n"] < MIN_GROUP))
    for r in issues:
        if r["priority"] == "High":
            out.append(Insight("recommendation", f"Look into {r['group'].lower()} first.", "issue_priority", r["reviews"] < MIN_GROUP))
    return out
