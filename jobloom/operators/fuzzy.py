"""Fuzzy (Levenshtein-ratio) joins between two string columns.

Both sides are reduced to distinct values.  A ratio of at least t allows at most
d = floor((1 - t) * longer length) edits; cut into d + 1 segments, one segment of the right value
then stands unchanged in the left value, at most d characters off its place.  So pairs meet by an
equi-join on (both lengths, segment number, segment text) and are verified: one plan for any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import levenshtein_ratio


def _passes(a: Column, b: Column, threshold: float, strict: bool) -> Column:
    r = levenshtein_ratio(a, b)
    return (r > threshold) if strict else (r >= threshold)


def _edits(la: Column, lb: Column, threshold: float) -> Column:
    # a hair above the exact bound: a rounding error must not cost a pair, and all pairs are verified
    return F.floor((1 - threshold) * F.greatest(la, lb) + 1e-9).cast("int")


def _other_lengths(n: Column, threshold: float) -> Column:
    low = F.greatest(F.ceil(n * threshold - 1e-9).cast("int"), F.lit(1))
    return F.explode(F.sequence(low, F.greatest(low, F.floor(n / threshold + 1e-9).cast("int"))))


def fuzzy_value_pairs(left: DataFrame, right: DataFrame, lcol: str, rcol: str,
                      threshold: float, strict: bool = False) -> DataFrame:
    """Distinct (lcol, rcol) value pairs with Levenshtein ratio >= threshold (> if strict), for a
    threshold above 0.  Empty strings never match (the ratio of two empty strings is undefined)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    a, b = F.col(lcol), F.col(rcol)
    lv = left.select(lcol).where(F.length(lcol) > 0).distinct()
    rv = right.select(rcol).where(F.length(rcol) > 0).distinct()
    segments = (rv.select(rcol, F.length(b).alias("lb"), _other_lengths(F.length(b), threshold).alias("la"))
                  .withColumn("d", _edits(F.col("la"), F.col("lb"), threshold))
                  .select(rcol, "la", "lb", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("seg")))
    start = lambda seg: F.floor(seg * F.col("lb") / (F.col("d") + 1)).cast("int")
    at, size = start(F.col("seg")), start(F.col("seg") + 1) - start(F.col("seg"))
    keyed_r = segments.select(rcol, "la", "lb", "seg", b.substr(at + 1, size).alias("part"))
    windows = (lv.select(lcol, F.length(a).alias("la"), _other_lengths(F.length(a), threshold).alias("lb"))
                 .withColumn("d", _edits(F.col("la"), F.col("lb"), threshold))
                 .select(lcol, "la", "lb", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("seg"))
                 .select(lcol, "la", "lb", "d", "seg", size.alias("size"),
                         F.explode(F.sequence(F.greatest(at - F.col("d"), F.lit(0)),
                                              F.greatest(F.greatest(at - F.col("d"), F.lit(0)),
                                                         F.least(at + F.col("d"), F.col("la") - size)))).alias("at")))
    keyed_l = windows.select(lcol, "la", "lb", "seg", a.substr(F.col("at") + 1, F.col("size")).alias("part")).distinct()
    return (keyed_l.join(keyed_r, ["la", "lb", "seg", "part"]).select(lcol, rcol).distinct()
                   .where(_passes(a, b, threshold, strict)))
