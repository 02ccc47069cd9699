"""Synthetic feedback with planted faults, by hashes of the row number: any size, any partitioning, the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUES = ("It was broken on arrival.", "Very expensive for what it is.", "The support was no help.", "It arrived late again.", "The app is confusing and full of bugs.")
PRAISE = ("Excellent, I love it.", "Friendly staff and great service.", "Easy to use and simple.", "Arrived quickly, good value.", "Great product, works well.")
PLACES = ("North Store", "South Store", "Harbour Branch", "Old Town", "Station")


def unit(seed: int, *salt: int) -> Column:
    """A number in [0, 1) that depends on the row's id only."""
    return F.pmod(F.xxhash64("id", F.lit(seed), *map(F.lit, salt)), F.lit(1_000_003)) / 1_000_003


def weighted_choice(u: Column, values: tuple[str, ...], weights: tuple[float, ...]) -> Column:
    """The value in whose share of the weights ``u`` falls."""
    whole, reached, chosen = sum(weights), 0.0, F.lit(values[-1])
    edges = []
    for v, w in zip(values, weights):
        reached += w / whole
        edges.append((v, reached))
    for v, edge in reversed(edges[:-1]):
        chosen = F.when(u < edge, v).otherwise(chosen)
    return chosen


def feedback(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Reviews over 18 months whose complaints depend on place and time."""
    u = lambda k: unit(seed, k)
    place = weighted_choice(u(1), PLACES, (5, 4, 3, 2, 1))
    day = F.date_add(F.lit("2025-01-01").cast("date"), (u(2) * 540).cast("int"))
    bad = u(3) < F.when(place == "Station", 0.5).otherwise(0.2) + F.when(day >= "2026-03-01", 0.1).otherwise(0.0)
    text = F.when(bad, weighted_choice(u(4), ISSUES, (4, 3, 3, 5, 2))).otherwise(weighted_choice(u(5), PRAISE, (3, 2, 2, 3, 4)))
    more = F.concat(text, F.lit(" Order "), F.col("id").cast("string"), F.lit(" at "), place, F.lit("."))
    rating = F.when(bad, 1 + F.floor(u(6) * 3)).otherwise(3 + F.floor(u(6) * 3)).cast("string")
    return spark.range(rows).select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"), more.alias("review_text"), rating.alias("rating"), day.cast("string").alias("date"), place.alias("store"), F.round(u(7) * 120 + 1, 1).cast("string").alias("delivery_time"))


def dirty_feedback(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """``feedback`` with missing, misspelt and mis-formatted values, exact copies and re-submissions."""
    base = feedback(spark, rows, seed)
    u = lambda k: unit(seed, 100 + k)
    dirty = base.withColumns(
        {
            "review_id": F.when(u(1) >= 0.005, F.col("review_id")),
            "review_text": F.when(u(2) < 0.015, "N/A").when(u(2) < 0.025, F.concat(F.lit("  "), F.replace(F.col("review_text"), F.lit(". "), F.lit(".<br> &amp; ")))).otherwise(F.col("review_text")),
            "rating": F.when(u(3) < 0.013, F.concat(F.col("rating"), F.lit(" stars"))).when(u(3) < 0.023, "abc").otherwise(F.col("rating")),
            "date": F.when(u(4) < 0.1, F.date_format(F.col("date").cast("date"), "MMMM d, yyyy")).when(u(4) < 0.2, F.date_format(F.col("date").cast("date"), "dd MMM yyyy")).when(u(4) < 0.203, "soon").when(u(4) < 0.205, "2090-01-01").otherwise(F.col("date")),
            "store": F.when(u(5) < 0.02, F.concat(F.upper("store"), F.lit(" "))).otherwise(F.col("store")),
            "delivery_time": F.when(u(6) < 0.1, F.concat(F.col("delivery_time"), F.lit(" min"))).when(u(6) < 0.11, "-5").otherwise(F.col("delivery_time")),
        }
    )
    copies = dirty.filter(u(7) < 0.02)
    again = dirty.filter(u(8) < 0.01).withColumn("review_id", F.concat(F.col("review_id"), F.lit("b"))).withColumn("review_text", F.upper("review_text"))
    return dirty.unionByName(copies).unionByName(again).drop("id")
