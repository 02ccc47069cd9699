"""Text polarity between -1 and 1, in Spark expressions: a small lexicon with negation and emphasis.

The labeller takes any function from a text column to a score; this one needs nothing but the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD = "good great excellent love loved loves amazing perfect perfectly nice happy comfortable beautiful best wonderful helpful friendly easy fast recommend delicious tasty fresh quick pleased fantastic awesome satisfied reliable intuitive affordable lovely".split()
BAD = "bad poor terrible awful hate hated worst broken rude slow late wrong cheap disappointed disappointing useless cold missing refund horrible annoying confusing expensive overpriced faulty defective damaged crash bug dirty sad angry problem problems unhelpful".split()
NEGATIONS = "not no never don't didn't doesn't isn't wasn't won't can't couldn't without".split()
STRONG = "very really extremely so absolutely".split()


def polarity(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}']+"), lambda w: w != "")

    def value(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            base = F.when(w.isin(*GOOD), 2.0).when(w.isin(*BAD), -2.0).otherwise(0.0)
            before = F.slice(ws, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
            turned = F.when((base != 0) & F.arrays_overlap(before, F.array(*map(F.lit, NEGATIONS))), -0.74).otherwise(1.0)
            raised = F.when((base != 0) & F.arrays_overlap(before, F.array(*map(F.lit, STRONG))), 1.3).otherwise(1.0)
            return base * turned * raised

        return F.aggregate(F.transform(ws, one), F.lit(0.0), lambda a, x: a + x)

    total = value(words)
    return F.round(total / F.sqrt(total * total + 15.0), 4)
