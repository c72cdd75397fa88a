"""Corpus profile: 25 named measurements per text (``prof_*`` namespace).

All are computed inside the row. Counts stay integers
until one final division, so results do not depend on evaluation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspect.functions import counts
from inkspect.functions import lexicons as lx
from inkspect.functions import text as tx

PROFILE_FEATURES = [
    "char_len", "word_count", "sent_count", "avg_word_len",
    "unique_ratio", "hapax_ratio", "stop_ratio",
    "punct_density", "question_density", "exclaim_density", "comma_density",
    "cap_ratio", "allcaps_ratio", "digit_ratio", "special_ratio",
    "avg_sent_len", "sent_len_std", "sent_len_var",
    "char_entropy", "word_entropy",
    "you_ratio", "modal_ratio", "imp_ratio", "quote_density", "readability",
]
# Features under the rank-sum test: all but the variance.
TESTED_FEATURES = [
    "char_len", "word_count", "sent_count", "avg_word_len", "avg_sent_len", "sent_len_std",
    "unique_ratio", "hapax_ratio", "stop_ratio",
    "punct_density", "question_density", "exclaim_density", "comma_density", "quote_density",
    "cap_ratio", "allcaps_ratio", "digit_ratio", "special_ratio",
    "char_entropy", "word_entropy",
    "you_ratio", "modal_ratio", "imp_ratio", "readability",
]
CORRELATED_FEATURES = [f for f in TESTED_FEATURES if f not in ("comma_density", "quote_density")]
DASHBOARD_FEATURES = [
    "word_count", "unique_ratio", "avg_sent_len", "punct_density", "cap_ratio",
    "char_entropy", "word_entropy", "you_ratio", "readability",
]


def _over(count: Column, whole: Column) -> Column:
    return count.cast("double") / whole


def add_char_entropy(df: DataFrame, name: str = "char_entropy", text: str = "text") -> DataFrame:
    """Bits per character, log2(N) - sum(n log2 n) / N, of a text's characters."""
    return df.withColumn(name, counts.char_entropy(F.col(text).cast("binary")))


def word_counts(df: DataFrame, id_col: str = "doc_id", lower: bool = True) -> DataFrame:
    """(doc_id, word, n) as a table, for callers that need the words themselves.

    A row's words are counted as run lengths, and counts of one id are added up after the
    shuffle: no task holds a table of the words of a whole input split.
    """
    text = F.lower("text") if lower else F.col("text")
    rows = df.select(id_col, F.sort_array(tx.tokens(text)).alias("_w"))
    rows = rows.select(id_col, "_w", tx.run_starts(F.col("_w")).alias("_s"))
    runs = F.zip_with("_s", tx.gaps(F.col("_s"), F.size("_w")), lambda s, n: F.struct(s.alias("_at"), n.alias("n")))
    rows = rows.select(id_col, "_w", F.inline_outer(runs)).where("_at IS NOT NULL")
    rows = rows.select(id_col, F.get("_w", F.col("_at")).alias("word"), "n")
    return rows.repartition(id_col, "word").groupBy(id_col, "word").agg(F.sum("n").alias("n"))


def row_profile(df: DataFrame) -> DataFrame:
    """Every profile feature except ``char_entropy``, without a shuffle."""
    keep = df.columns
    text = F.col("text")
    base = df.select(
        *keep, tx.tokens(text).alias("_w"), F.lower(text).alias("_lt"), tx.pieces(text).alias("_p")
    )
    base = base.select(
        *keep, "_w", "_lt",
        F.sort_array(F.transform("_w", F.lower)).alias("_lw"),
        F.filter(F.transform("_p", tx.n_tokens), lambda n: n > 0).alias("_sl"),
        tx.sentence_openers(F.col("_lt")).alias("_so"),
    )
    base = base.withColumn("_starts", tx.run_starts(F.col("_lw")))
    base = base.withColumn("_freq", tx.gaps(F.col("_starts"), F.size("_lw")))

    words, lowered, freq, lens = F.col("_w"), F.col("_lw"), F.col("_freq"), F.col("_sl")
    base = base.select(
        *keep, "_w", "_lt", "_lw", "_so", "_freq",
        F.greatest(F.size(words), F.lit(1)).alias("nw"),
        F.greatest(F.length("text"), F.lit(1)).alias("nc"),
        F.greatest(F.size(lens), F.lit(1)).alias("ns"),
        F.size(lens).cast("long").alias("_n"),
        tx.total(lens).alias("_s"),
        tx.total_squares(lens).alias("_s2"),
        F.size(freq).alias("_types"),
        F.size(words).alias("_words"),
    )
    nw, nc, ns = F.col("nw"), F.col("nc"), F.col("ns")
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    upper = F.length(F.regexp_replace("text", r"\P{Lu}+", ""))
    flesch = 206.835 - 1.015 * _over(nw, ns) - 84.6 * _over(
        tx.syllables(F.col("_lt"), lowered, closing=".,;:!?"), nw
    )
    base = base.withColumn(
        "_var", tx.population_variance(F.col("_n"), F.col("_s"), F.col("_s2"))
    )
    has_words = F.col("_words") > 0
    return base.select(
        *keep,
        nc.cast("double").alias("char_len"),
        nw.cast("double").alias("word_count"),
        ns.cast("double").alias("sent_count"),
        _over(tx.total(F.transform(words, F.length)), nw).alias("avg_word_len"),
        _over(F.col("_types"), nw).alias("unique_ratio"),
        F.when(has_words, _over(F.size(F.filter(freq, lambda n: n == 1)), F.col("_types")))
        .otherwise(0.0)
        .alias("hapax_ratio"),
        _over(tx.members("_lw", lx.PROFILE_STOP_WORDS), nw).alias("stop_ratio"),
        _over(tx.in_class(F.col("text"), r".,;:!?()\[\]{}\"'\-"), nc).alias("punct_density"),
        _over(tx.occurrences(F.col("text"), "?"), ns).alias("question_density"),
        _over(tx.occurrences(F.col("text"), "!"), ns).alias("exclaim_density"),
        _over(tx.occurrences(F.col("text"), ","), nc).alias("comma_density"),
        F.when(letters > 0, _over(upper, letters)).otherwise(0.0).alias("cap_ratio"),
        _over(tx.shouted(words), nw).alias("allcaps_ratio"),
        _over(tx.in_class(F.col("text"), r"\p{Nd}"), nc).alias("digit_ratio"),
        _over(tx.outside_class(F.col("text"), r"\p{L}\p{N}\s\x1c-\x1f\x85\p{Z}"), nc).alias("special_ratio"),
        F.when(F.col("_n") > 0, _over(F.col("_s"), F.col("_n"))).otherwise(0.0).alias("avg_sent_len"),
        F.sqrt("_var").alias("sent_len_std"),
        F.col("_var").alias("sent_len_var"),
        F.when(
            has_words, F.log2(nw.cast("double")) - tx.plogp(freq) / nw
        ).otherwise(0.0).alias("word_entropy"),
        _over(tx.members("_lw", lx.SECOND_PERSON), nw).alias("you_ratio"),
        _over(tx.members("_lw", lx.MODAL_VERBS), nw).alias("modal_ratio"),
        _over(tx.members("_so", lx.PROFILE_IMPERATIVES), ns).alias("imp_ratio"),
        _over(tx.in_class(F.col("text"), "\"'"), nc).alias("quote_density"),
        F.when(has_words & (F.col("_n") > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), flesch)))
        .otherwise(0.0)
        .alias("readability"),
    )


def profile(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All 25 features next to the columns of ``df``, each computed inside its row."""
    wide = row_profile(add_char_entropy(df)).drop("text")
    return wide.select(*[c for c in df.columns if c != "text"], *PROFILE_FEATURES)


def text_stats(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: characters, words, sentences, distinct words, mean lengths."""
    text = F.col("text")
    base = df.select(
        id_col, "text", tx.tokens(text).alias("_w"), tx.sentence_lengths(text).alias("_sl")
    )
    n_words = F.greatest(F.size("_w"), F.lit(1))
    return base.select(
        id_col,
        F.length("text").cast("long").alias("n_chars"),
        F.size("_w").cast("long").alias("n_words"),
        F.size("_sl").cast("long").alias("n_sents"),
        F.size(F.array_distinct(F.transform("_w", F.lower))).cast("long").alias("n_unique"),
        _over(tx.total(F.transform("_w", F.length)), n_words).alias("avg_word_len"),
        _over(F.size("_w"), F.greatest(F.size("_sl"), F.lit(1))).alias("avg_sent_len"),
    )
