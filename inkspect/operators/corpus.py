"""Corpus tables by class: overview, moments, tests, histograms, words, correlations."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspect.functions import lexicons as lx
from inkspect.functions import stats
from inkspect.functions import text as tx
from inkspect.operators import ranks
from inkspect.operators.profile import CORRELATED_FEATURES, TESTED_FEATURES
from inkspect.session import staged


def overview(df: DataFrame) -> DataFrame:
    """Per class: texts, share of all texts, mean characters, words and sentences."""
    sized = df.select(
        "label",
        F.greatest(F.length("text"), F.lit(1)).alias("c"),
        F.greatest(tx.n_tokens(F.col("text")), F.lit(1)).alias("w"),
        F.greatest(F.size(tx.sentence_lengths(F.col("text"))), F.lit(1)).alias("s"),
    )
    n = F.count(F.lit(1))
    per = sized.groupBy("label").agg(
        n.alias("n_texts"),
        (F.sum("c") / n).alias("avg_chars"),
        (F.sum("w") / n).alias("avg_words"),
        (F.sum("s") / n).alias("avg_sents"),
    )
    share = F.col("n_texts") * 100.0 / F.sum("n_texts").over(Window.partitionBy())
    return per.withColumn("pct_of_total", share)


def moments(long: DataFrame) -> DataFrame:
    """(feature, label, n, mean, population deviation) from a long feature table."""
    return long.groupBy("feature", "label").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    )


def significance(profile: DataFrame, features: list[str] = TESTED_FEATURES) -> DataFrame:
    """Per feature: class means and deviations, U, p and stars, most significant first."""
    long = ranks.unpivot(profile, features, "label")
    by_class = moments(long).groupBy("feature").agg(
        *[
            F.max(F.when(F.col("label") == k, F.col(m))).alias(f"{m}_{k}")
            for m in ("mean", "std")
            for k in (0, 1)
        ]
    )
    tests = ranks.rank_sums(ranks.cumulative(ranks.value_counts(long)))
    return (
        by_class.join(tests.select("feature", "u_statistic", "z"), "feature")
        .withColumn("p_value", stats.normal_two_sided_p(F.col("z")))
        .withColumn("significance", stats.stars(F.col("p_value")))
        .orderBy("p_value", "feature")
    )


def significant_count(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if(F.col("p_value") < 0.05).alias("n_significant"),
        F.count(F.lit(1)).alias("n_features"),
    )


def clip(long: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Values clipped to [0, limit]; ``limits`` has one row per feature (and class)."""
    return long.join(F.broadcast(limits), keys).withColumn(
        "clipped", F.least(F.greatest("value", F.lit(0.0)), "limit")
    )


def histogram(
    profile: DataFrame, features: list[str], bins: int = 50, fraction: float = 0.99, per_class: bool = False
) -> DataFrame:
    """(feature, label, bin, lo, width, n, density) after clipping at a percentile.

    ``per_class=False`` clips at the pooled percentile, ``True`` at each class's
    own. Bins are equal slices of the class's clipped range; a constant range
    becomes [v - 0.5, v + 0.5]. Everything after the value counts runs on one
    row per distinct value.
    """
    long = ranks.unpivot(profile, features, "label")
    cum = staged_cumulative(long)
    limits = ranks.percentiles(cum, [fraction], pooled=not per_class)
    by_side = F.inline(
        F.array(
            F.struct(F.lit(0).alias("label"), F.col("n0").alias("n")),
            F.struct(F.lit(1).alias("label"), F.col("n1").alias("n")),
        )
    )
    values = cum.select("feature", "value", by_side).where("n > 0")
    if per_class:
        limits = limits.select("feature", F.col("side").cast("int").alias("label"), F.col("value").alias("limit"))
        clipped = clip(values, limits, ["feature", "label"])
    else:
        limits = limits.select("feature", F.col("value").alias("limit"))
        clipped = clip(values, limits, ["feature"])
    ranges = clipped.groupBy("feature", "label").agg(
        F.min("clipped").alias("_min"), F.max("clipped").alias("_max"), F.sum("n").alias("_total")
    )
    flat = F.col("_min") == F.col("_max")
    lo = F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min"))
    hi = F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max"))
    placed = clipped.join(F.broadcast(ranges), ["feature", "label"]).select(
        "feature", "label", "n", "_total",
        lo.alias("lo"),
        ((hi - lo) / bins).alias("width"),
        F.least(F.floor((F.col("clipped") - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int").alias("bin"),
    )
    return placed.groupBy("feature", "label", "bin").agg(
        F.first("lo").alias("lo"),
        F.first("width").alias("width"),
        F.sum("n").alias("n"),
        (F.sum("n") / (F.first("_total") * F.first("width"))).alias("density"),
    )


def staged_cumulative(long: DataFrame) -> DataFrame:
    """Cumulative value counts kept once for the several tables read from them."""
    return staged(ranks.cumulative(ranks.value_counts(long)), "cumulative")


def box_stats(profile: DataFrame, features: list[str], fraction: float = 0.99) -> DataFrame:
    """Quartiles, whiskers and outliers per feature and class, clipped to [0, p99].

    Clipping is monotone, so quartiles of the clipped values are interpolated
    between clipped order statistics.
    """
    long = ranks.unpivot(profile, features, "label")
    cum = staged_cumulative(long)
    limits = ranks.percentiles(cum, [fraction]).select("feature", F.col("value").alias("limit"))
    clipped = (
        clip(cum, limits, ["feature"])
        .groupBy("feature", "clipped")
        .agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
            F.min("b0").alias("b0"), F.min("b1").alias("b1"),
        )
        .withColumnRenamed("clipped", "value")
    )
    q = ranks.percentiles(clipped, [0.25, 0.5, 0.75], pooled=False)
    wide = q.groupBy("feature", "side").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    ).select("feature", F.col("side").cast("int").alias("label"), "q1", "median", "q3")
    by_side = F.inline(
        F.array(
            F.struct(F.lit(0).alias("label"), F.col("n0").alias("n")),
            F.struct(F.lit(1).alias("label"), F.col("n1").alias("n")),
        )
    )
    rows = clipped.select("feature", "value", by_side).where("n > 0")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return (
        rows.join(F.broadcast(wide), ["feature", "label"])  # features x classes rows
        .groupBy("feature", "label")
        .agg(
            F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
        )
    )


def top_words(df: DataFrame, k: int = 30) -> DataFrame:
    """The k most frequent words of 3+ letters a-z per class, stop words left out.

    Counts are combined map-side per (label, word). The ranking first keeps the
    top k of each of 64 word-hash slices, so a class's vocabulary is never
    sorted in one task, and then ranks at most 64 x k rows per class.
    """
    # Word edges are "no word character next to it", letters and marks included.
    word = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"
    counts = (
        df.select("label", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0))).alias("word"))
        .where(~F.col("word").isin(lx.PROFILE_STOP_WORDS))
        .groupBy("label", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = [F.desc("n"), F.asc("word")]
    sliced = counts.withColumn("_s", F.pmod(F.xxhash64("word"), F.lit(64)))
    local = sliced.withColumn(
        "_r", F.row_number().over(Window.partitionBy("label", "_s").orderBy(*best))
    ).where(F.col("_r") <= k)
    return (
        local.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*best)))
        .where(F.col("rank") <= k)
        .select("label", "rank", "word", "n")
    )


def keyword_shares(df: DataFrame, by: str = "label", literal_case: bool = False) -> DataFrame:
    """Share of texts per class containing each keyword, all keywords in one pass.

    Keywords are lowered like the text. ``literal_case=True`` matches them as
    written, which leaves the one upper-case keyword at zero.
    """
    lowered = F.lower("text")
    per = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.count_if(F.contains(lowered, F.lit(kw if literal_case else kw.lower()))).alias(f"k{i}")
            for i, kw in enumerate(lx.UNSAFE_KEYWORDS)
        ],
    )
    rows = F.array(
        *[
            F.struct(F.lit(kw).alias("keyword"), F.col(f"k{i}").alias("n_texts"))
            for i, kw in enumerate(lx.UNSAFE_KEYWORDS)
        ]
    )
    return per.select(by, "_n", F.inline(rows)).select(
        by, "keyword", "n_texts", (F.col("n_texts") / F.col("_n")).alias("share")
    )


def correlations(profile: DataFrame, features: list[str] = CORRELATED_FEATURES) -> DataFrame:
    """(feature_a, feature_b, r): Pearson correlation of every pair of features.

    The matrix is features x features whatever the number of texts; a constant
    feature has no correlation and gets null.
    """
    vectors = VectorAssembler(inputCols=features, outputCol="_f").transform(profile).select("_f")
    matrix = Correlation.corr(vectors, "_f").first()[0].toArray()
    rows = [
        (a, b, None if math.isnan(matrix[i][j]) else float(matrix[i][j]))
        for i, a in enumerate(features)
        for j, b in enumerate(features)
        if i < j
    ]
    return profile.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def vector_summary(df: DataFrame, vector: str, id_col: str) -> DataFrame:
    """Dimensions, smallest, largest and mean entry of an array column."""
    v = F.col(vector)
    return df.select(
        id_col,
        F.size(v).cast("long").alias("dims"),
        F.array_min(v).cast("double").alias("min_value"),
        F.array_max(v).cast("double").alias("max_value"),
        (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))).alias("mean_value"),
    )
