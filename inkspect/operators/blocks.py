"""Feature blocks for the model matrix.

A hashed vector (384), B stylometric (10), C statistical (7), D surface
linguistic (2), E perplexity (1), F structural (8). Blocks A, B, C, D and F are
row-local apart from the document frequencies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspect.functions import counts
from inkspect.functions import lexicons as lx
from inkspect.functions import text as tx
from inkspect.operators.profile import add_char_entropy
from inkspect.session import staged

HASH_DIMS = 384
BLOCK_B = [
    "sty_avg_word_len", "sty_avg_sent_len", "sty_sent_std", "sty_unique_ratio", "sty_hapax",
    "sty_stop_ratio", "sty_punct_density", "sty_capital_ratio", "sty_digit_ratio", "sty_special_ratio",
]
BLOCK_C = [
    "stat_char_entropy", "stat_word_entropy", "stat_token_div", "stat_repetition",
    "stat_burstiness", "stat_yule_k", "stat_simpson",
]
BLOCK_D = ["ling_ent_density", "ling_readability"]
BLOCK_F = [
    "str_q_density", "str_exc_density", "str_imp_ratio", "str_you_ratio",
    "str_modal_ratio", "str_quote_density", "str_allcaps_ratio", "str_sent_var",
]


def _over(count: Column, whole: Column) -> Column:
    return count.cast("double") / whole


def row_blocks(df: DataFrame) -> DataFrame:
    """Blocks B, C (but for the character entropy), D and F from one tokenisation.

    A text without words gets zeros in every block.
    """
    keep = df.columns
    text = F.col("text")
    base = df.select(
        *keep, tx.tokens(text).alias("_w"), F.lower(text).alias("_lt"), tx.pieces(text).alias("_p")
    )
    base = base.select(
        *keep, "_w", "_lt",
        counts.word_frequencies(text.cast("binary")).alias("_freq"),
        F.transform("_w", F.lower).alias("_lw"),
        F.filter(F.transform("_p", tx.n_tokens), lambda n: n > 0).alias("_sl"),
        tx.sentence_openers(F.col("_lt")).alias("_so"),
    )
    base = base.select(
        *keep, "_w", "_lt", "_lw", "_so", "_freq",
        F.greatest(F.size("_w"), F.lit(1)).alias("_nw"),
        F.greatest(F.size("_sl"), F.lit(1)).alias("_ns"),
        F.greatest(F.length("text"), F.lit(1)).alias("_nc"),
        F.greatest(F.size("_freq"), F.lit(1)).alias("_types"),
        F.size(F.filter("_freq", lambda n: n == 1)).alias("_once"),
        tx.total_squares(F.col("_freq")).alias("_m2"),
        tx.population_variance(
            F.size("_sl").cast("long"), tx.total(F.col("_sl")), tx.total_squares(F.col("_sl"))
        ).alias("_var"),
        (F.size("_w") > 0).alias("_some"),
    )
    nw, ns, nc, types = F.col("_nw"), F.col("_ns"), F.col("_nc"), F.col("_types")
    m1, m2 = nw.cast("long"), F.col("_m2")
    unique = _over(F.size("_freq"), nw)
    flesch = 206.835 - 1.015 * _over(nw, ns) - 84.6 * _over(
        tx.syllables(F.col("_lt"), F.col("_lw")), nw
    )
    features = {
        "sty_avg_word_len": _over(tx.total(F.transform("_w", F.length)), nw),
        "sty_avg_sent_len": _over(nw, ns),
        "sty_sent_std": F.sqrt("_var"),
        "sty_unique_ratio": unique,
        "sty_hapax": _over(F.col("_once"), nw),
        "sty_stop_ratio": _over(tx.members("_lw", lx.ENGLISH_STOP_WORDS), nw),
        "sty_punct_density": _over(tx.in_class(text, r"!-/:-@\[-`{-~"), nc),
        "sty_capital_ratio": _over(tx.outside_class(text, r"\P{Lu}"), nc),
        "sty_digit_ratio": _over(tx.in_class(text, r"\p{Nd}"), nc),
        "sty_special_ratio": _over(tx.outside_class(text, r"\p{L}\p{N}\s"), nc),
        "stat_word_entropy": F.log2(nw.cast("double")) - tx.plogp(F.col("_freq")) / nw,
        "stat_token_div": unique,
        "stat_repetition": _over(F.size("_freq") - F.col("_once"), types),
        # variance over mean of the frequencies, with mean = words / types
        "stat_burstiness": _over(types * m2 - m1 * m1, types * m1),
        "stat_yule_k": F.when(m1 > 1, _over(10000 * (m2 - m1), m1 * m1)).otherwise(0.0),
        "stat_simpson": 1.0 - _over(m2, m1 * m1),
        "ling_ent_density": _over(F.size(F.filter("_w", lambda w: w.rlike(r"^\p{Lu}"))), nw),
        "ling_readability": F.greatest(F.lit(0.0), F.least(F.lit(100.0), flesch)) / 100.0,
        "str_q_density": _over(tx.occurrences(text, "?"), nc),
        "str_exc_density": _over(tx.occurrences(text, "!"), nc),
        "str_imp_ratio": _over(tx.members("_so", lx.STRUCTURAL_IMPERATIVES), ns),
        "str_you_ratio": _over(tx.occurrences(F.col("_lt"), "you"), nw),
        "str_modal_ratio": _over(tx.occurrences(F.col("_lt"), "can"), nw),
        "str_quote_density": _over(tx.occurrences(text, '"'), nc),
        "str_allcaps_ratio": _over(tx.shouted(F.col("_w")), nw),
        "str_sent_var": F.col("_var"),
    }
    return base.select(
        *keep,
        *[F.when(F.col("_some"), e).otherwise(0.0).alias(name) for name, e in features.items()],
    )


def numeric_blocks(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks B, C, D and F keyed by id; the text itself stays behind."""
    rows = row_blocks(add_char_entropy(df, "_entropy")).drop("text")
    # Only a text with words has a positive word length; blank texts stay at zero.
    value = F.when(F.col("sty_avg_word_len") > 0, F.col("_entropy")).otherwise(0.0)
    return rows.withColumn("stat_char_entropy", value).select(
        *[c for c in df.columns if c != "text"], *BLOCK_B, *BLOCK_C, *BLOCK_D, *BLOCK_F
    )


def term_frequencies(df: DataFrame, id_col: str = "doc_id", dims: int = HASH_DIMS) -> DataFrame:
    """(id, tf): words of the lower-cased text per bucket, the first 32 bits of their md5 modulo ``dims``, as a dense array."""
    return df.select(id_col, counts.bucket_counts(dims)(F.lower("text").cast("binary")).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(bucket, df): texts using each bucket; one row per bucket after map-side combine.

    The outer form of explode is used wherever an array is expensive: the inner
    form adds a "not empty" filter that would compute the array a second time.
    """
    return (
        tf.select(F.posexplode_outer("tf").alias("bucket", "n"))
        .where("n > 0")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def fit_idf(tf: DataFrame, dims: int = HASH_DIMS) -> list[float]:
    """Smoothed inverse document frequencies ln((N + 1) / (df + 1)) + 1, one per bucket.

    The fitted state is ``dims`` numbers, the same that an IDF model would hold.
    """
    n = tf.count()
    found = {r["bucket"]: r["df"] for r in document_frequencies(tf).collect()}
    return [math.log((n + 1) / (found.get(i, 0) + 1)) + 1 for i in range(dims)]


def hashed_vectors(
    df: DataFrame, idf: list[float] | None = None, id_col: str = "doc_id", dims: int = HASH_DIMS
) -> DataFrame:
    """(id, hashed): tf-idf over hash buckets, scaled to unit length; zeros if empty."""
    tf = term_frequencies(df, id_col, dims)
    if idf is None:
        # Two passes need the frequencies; stored, they are hashed once.
        tf = staged(tf, "term-frequencies")
        idf = fit_idf(tf, dims)
    weights = F.array(*[F.lit(float(v)) for v in idf])
    weighted = tf.select(id_col, F.zip_with("tf", weights, lambda n, w: n * w).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v))
    return weighted.select(id_col, "_v", norm.alias("_n")).select(
        id_col,
        F.transform("_v", lambda v: F.when(F.col("_n") > 0, v / F.col("_n")).otherwise(0.0)).alias("hashed"),
    )
