"""Ranks and quantiles that never gather one feature or one class in one task.

A global order is computed in two levels: values are dealt out by range and stored, the
totals of the ranges are accumulated (a table of at most ``groups + ranges`` rows), and
the running sum inside a range is added to the total of the ranges before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspect.session import staged

# Distinct values of a range.
RANGE_ROWS = 500_000


def unpivot(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """(keys, feature, value), nulls left out."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    )
    return df.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull())


def value_counts(long: DataFrame) -> DataFrame:
    """(feature, value, n0, n1) for classes 0 and 1, combined before the shuffle."""
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
    )


def _ranged(vc: DataFrame, ranges: int | None) -> DataFrame:
    """The rows dealt out by (feature, value) and stored with the number of their range as ``bucket``."""
    stored = staged(vc, "value-counts")
    ranges = ranges or max(1, math.ceil(stored.count() / RANGE_ROWS))
    dealt = stored.repartitionByRange(ranges, "feature", "value").withColumn("bucket", F.spark_partition_id())
    return staged(dealt, "value-ranges")


def cumulative(vc: DataFrame, ranges: int | None = None) -> DataFrame:
    """Value counts plus ``b0``/``b1``: rows of each class with a smaller value.

    The number of ranges follows the rows unless it is given.
    """
    parts = _ranged(vc, ranges)
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        parts.groupBy("feature", "bucket")
        .agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
        .select(
            "feature", "bucket",
            F.coalesce(F.sum("t0").over(before), F.lit(0)).alias("o0"),
            F.coalesce(F.sum("t1").over(before), F.lit(0)).alias("o1"),
        )
    )
    inside = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        parts.withColumn("i0", F.coalesce(F.sum("n0").over(inside), F.lit(0)))
        .withColumn("i1", F.coalesce(F.sum("n1").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["feature", "bucket"])  # features + ranges rows
        .select(
            "feature", "value", "n0", "n1",
            (F.col("i0") + F.col("o0")).alias("b0"),
            (F.col("i1") + F.col("o1")).alias("b1"),
        )
    )


def rank_sums(cum: DataFrame) -> DataFrame:
    """Per feature: class sizes, U of class 0, tie-corrected z with continuity.

    A pair counts 1 when the class-0 value is larger and 1/2 on a tie, so U is
    the sum over values of n0 * (b1 + n1 / 2); kept doubled to stay an integer.
    """
    # Products of two row counts pass 64 bits on large tables; decimals hold them.
    wide = "decimal(18,0)"
    n0, n1, b1 = (F.col(c).cast(wide) for c in ("n0", "n1", "b1"))
    t = (F.col("n0") + F.col("n1")).cast("double")
    per = cum.groupBy("feature").agg(
        F.sum("n0").alias("n_0"),
        F.sum("n1").alias("n_1"),
        F.sum(n0 * (b1 + b1 + n1)).cast("double").alias("u2"),
        F.sum(t * t * t - t).alias("ties"),
    )
    a, b = F.col("n_0").cast("double"), F.col("n_1").cast("double")
    n = a + b
    u = F.col("u2") / 2.0
    ties = F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))
    sigma = F.sqrt(a * b / 12.0 * F.greatest(n + 1 - ties, F.lit(0.0)))
    shift = F.greatest(F.abs(u - a * b / 2.0) - 0.5, F.lit(0.0))
    return per.select(
        "feature", "n_0", "n_1", u.alias("u_statistic"),
        F.coalesce(F.try_divide(shift, sigma), F.lit(0.0)).alias("z"),
    )


def roc_auc(scores: DataFrame, score: str = "score", label: str = "label", by: str = "model") -> DataFrame:
    """Tie-aware area under the ROC curve per model: U of class 1 over n0 * n1."""
    long = scores.select(
        F.col(by).cast("string").alias("feature"),
        F.col(score).cast("double").alias("value"),
        F.col(label).alias("label"),
    )
    per = rank_sums(cumulative(value_counts(long)))
    pairs = F.col("n_0").cast("double") * F.col("n_1")
    return per.select(
        F.col("feature").alias(by),
        F.when(pairs > 0, (pairs - F.col("u_statistic")) / pairs).alias("roc_auc"),
    )


def percentiles(cum: DataFrame, fractions: list[float], pooled: bool = True) -> DataFrame:
    """Exact percentiles with linear interpolation, per feature (and class).

    The two order statistics around a fraction are the value rows whose
    cumulative counts straddle their positions, so nothing is sorted again.
    """
    if pooled:
        sides = [("all", F.col("n0") + F.col("n1"), F.col("b0") + F.col("b1"))]
    else:
        sides = [("0", F.col("n0"), F.col("b0")), ("1", F.col("n1"), F.col("b1"))]
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("side"), n.alias("n"), before.alias("before"))
            for s, n, before in sides
        ]
    )
    per_side = cum.select("feature", "value", F.inline(rows)).where("n > 0")
    sizes = per_side.groupBy("feature", "side").agg(F.sum("n").alias("total"))
    wanted = sizes.select(
        "feature", "side", F.explode(F.array(*[F.lit(float(p)) for p in fractions])).alias("p"), "total"
    ).select(
        "feature", "side", "p",
        (F.col("p") * (F.col("total") - 1)).alias("at"),
    )
    lo, hi = F.floor("at"), F.ceil("at")
    after = F.col("before") + F.col("n")
    hits = per_side.join(F.broadcast(wanted), ["feature", "side"]).where(  # features x sides x fractions rows
        ((F.col("before") <= lo) & (lo < after)) | ((F.col("before") <= hi) & (hi < after))
    )
    # After grouping both positions lie in at most two value rows.
    return hits.groupBy("feature", "side", "p", "at").agg(
        F.min("value").alias("v_lo"), F.max("value").alias("v_hi")
    ).select(
        "feature", "side", "p",
        (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("at") - lo)).alias("value"),
    )


def hash_order(seed: int, id_col: str) -> Column:
    """Reproducible shuffle key: md5 of the seed and the id."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def shuffled_rank(df: DataFrame, group: str, id_col: str, seed: int, out: str = "rank") -> DataFrame:
    """0-based rank of every row in its group's seeded shuffle, plus ``group_size``.

    A class may hold most of the table, so its rows are spread over the 4096
    three-digit prefixes of the hash; prefixes keep the hash order, and the
    offset table has at most 4096 rows per class.
    """
    keyed = df.withColumn("_h", hash_order(seed, id_col)).withColumn("_b", F.substring("_h", 1, 3))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(group, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            group, "_b",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
            F.sum("_n").over(Window.partitionBy(group)).alias("group_size"),
        )
    )
    inside = Window.partitionBy(group, "_b").orderBy("_h", id_col)
    return (
        keyed.withColumn("_r", F.row_number().over(inside) - 1)
        .join(offsets, [group, "_b"])
        .withColumn(out, (F.col("_r") + F.col("_o")).cast("long"))
        .drop("_h", "_b", "_r", "_o")
    )
