"""Mergeable quantile sketches: percentiles of any union of slices without reading rows again.

Each slice and feature keeps one KLL sketch of bounded size. Sketches of slices are merged
for every question; their normalised rank error is about ``ERROR`` with 99% confidence whatever
the number of rows or merges. The exact percentiles of ``ranks`` stay beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1000
# Rank error of one quantile of a sketch of this size, both sides.
ERROR = 0.004


def per_slice(long: DataFrame, *slices: str, size: int = SIZE) -> DataFrame:
    """(slices, feature, n, sketch) of (slices, feature, value) rows: what is stored per delivery or source."""
    return long.where(F.col("value").isNotNull()).groupBy(*slices, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(size)).alias("sketch")
    )


def merged(sketches: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """(by, feature, n, sketch): sketches of slices as one."""
    return sketches.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def quantiles(sketches: DataFrame, fractions: list[float], *by: str) -> DataFrame:
    """(by, feature, n, p, value)."""
    asked = [
        F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in fractions
    ]
    return sketches.select(*by, "feature", "n", F.inline(F.array(*asked)))


def rank_errors(found: DataFrame, long: DataFrame) -> DataFrame:
    """(feature, n, p, value, error): how far the asked share lies outside the ranks that the value holds."""
    rows = long.select("feature", F.col("value").cast("double").alias("x")).join(F.broadcast(found), "feature")  # features x fractions rows
    shares = rows.groupBy("feature", "n", "p", "value").agg(
        F.avg((F.col("x") < F.col("value")).cast("double")).alias("below"), F.avg((F.col("x") <= F.col("value")).cast("double")).alias("upto")
    )
    error = F.greatest(F.lit(0.0), F.col("below") - F.col("p"), F.col("p") - F.col("upto"))
    return shares.select("feature", "n", "p", "value", error.alias("error"))
