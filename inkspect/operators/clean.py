"""Cleaning: text repair, exact dedup, length filter, label encoding, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspect.functions import text as tx
from inkspect.functions import unicode as uc
from inkspect.session import staged

# Code points that carry no visible content.
INVISIBLE = r"[\u200b\u200c\u200d\ufeff\u00ad\u2060\u180e]"
INVISIBLE_WIDE = (
    r"[\u200b\u200c\u200d\u2060\ufeff\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e"
    r"\u2000-\u200f\u202a-\u202e\u2061-\u2064\u2066-\u2069\u206a-\u206f\ufff9-\ufffb]"
)
# Typographic marks and their ASCII forms.
ASCII_MARKS = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2013": "-",
    "\u2014": "--",
    "\u2026": "...",
}
MIN_WORDS = 10
# So many label names are broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_LABELS = 10_000
GUARD_WORDS = 5


def repair(text: Column) -> Column:
    """Undo encoding damage and leave style alone; inner newlines survive."""
    text = F.regexp_replace(uc.unescape_nfc(text), INVISIBLE, "")
    text = F.regexp_replace(text, r"[\t\r ]{2,}|[\t\r]", " ")
    return tx.strip(text)


def normalize(text: Column) -> Column:
    """Canonical form for analysis: NFC, visible characters, ASCII marks, tidy space."""
    text = F.regexp_replace(uc.nfc(text), INVISIBLE_WIDE, "")
    for mark, plain in ASCII_MARKS.items():
        text = F.replace(text, F.lit(mark), F.lit(plain))
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return tx.strip(text)


def prepare(df: DataFrame, text_col: str, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """Select, rename, drop nulls and repair the text.

    Nulls go before any cast, so a missing text never turns into a word.
    """
    return (
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(text_col).cast("string").alias("text"),
            F.col(label_col).alias("label"),
        )
        .dropna(subset=["text", "label"])
        .withColumn("text", repair(F.col("text")))
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text, the one with the smallest id.

    Only (md5, id) pairs are grouped and joined, and only for texts that repeat; the
    rows themselves meet the ids to drop on the unique id. So a text with very many
    copies makes no hot key for texts. ``df`` is read three times: store it first
    if it is costly.
    """
    # Never null, so the joins add no "is not null" filter that would repeat the
    # cleaning below the shuffle of the input.
    digests = df.select(F.coalesce(F.md5(F.col(text_col)), F.lit("")).alias("_md5"), F.col(id_col).alias("_id"))
    repeated = digests.groupBy("_md5").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = digests.join(repeated, "_md5").where("_id > _first").select(F.col("_id").alias(id_col))
    return df.join(later, id_col, "left_anti")


def long_enough(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return df.where(tx.n_tokens(F.col("text")) >= min_words)


def guard_reason(text: Column) -> Column:
    """Why a text cannot be scored, or null."""
    words = tx.n_tokens(text)
    return (
        F.when(text.isNull() | (words == 0), "empty")
        .when(words < GUARD_WORDS, "too short")
    )


def encode_labels(df: DataFrame) -> DataFrame:
    """Numeric labels become integers, strings their rank in sorted order."""
    if df.schema["label"].dataType.typeName() != "string":
        return df.withColumn("label", F.col("label").cast("int"))
    names = staged(label_map(df), "labels")
    few = names.count() <= BROADCAST_LABELS
    named = df.join(F.broadcast(names) if few else names, "label")
    return named.drop("label").withColumnRenamed("label_id", "label")


def label_map(df: DataFrame) -> DataFrame:
    """(label, label_id); the ranking window sees one row per distinct label."""
    return (
        df.select("label")
        .where(F.col("label").isNotNull())
        .distinct()
        .withColumn("label_id", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))
    )


def clean(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
) -> DataFrame:
    """The whole chain: repair, dedup, length filter, labels. Repaired texts are stored, so repaired once."""
    repaired = staged(prepare(df, text_col, label_col, id_col), "repaired")
    return encode_labels(long_enough(keep_first(repaired), min_words)).select("doc_id", "text", "label")


def funnel(
    df: DataFrame, text_col: str = "text", label_col: str = "label", min_words: int = MIN_WORDS
) -> DataFrame:
    """Rows before and after each cleaning step, from one aggregation.

    Copies of a text share its word count, so one row per distinct text with
    its number of copies carries every count the steps need.
    """
    valid = F.col(text_col).isNotNull() & F.col(label_col).isNotNull()
    fixed = F.when(valid, repair(F.col(text_col)))
    per_text = (
        df.select(fixed.alias("t"))
        .select(F.md5("t").alias("h"), (tx.n_tokens(F.col("t")) >= min_words).alias("ok"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("ok").alias("ok"))
    )
    present = F.col("h").isNotNull()
    counts = per_text.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum(F.when(present, F.col("copies"))), F.lit(0)).alias("valid"),
        F.count_if(present).alias("unique"),
        F.count_if(present & F.col("ok")).alias("kept"),
    )
    steps = [
        (1, "drop_nulls", "raw", "valid"),
        (2, "exact_dedup", "valid", "unique"),
        (3, "min_words", "unique", "kept"),
        (4, "total", "raw", "kept"),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_no"),
                F.lit(name).alias("step"),
                F.col(a).alias("rows_before"),
                F.col(b).alias("rows_after"),
            )
            for i, name, a, b in steps
        ]
    )
    removed = F.col("rows_before") - F.col("rows_after")
    return counts.select(F.inline(rows)).select(
        "step_no",
        "step",
        "rows_before",
        "rows_after",
        removed.alias("removed"),
        F.coalesce(F.try_divide(removed * 100.0, F.col("rows_before")), F.lit(0.0)).alias(
            "removed_pct"
        ),
    )


def class_balance(df: DataFrame) -> DataFrame:
    """Rows per class and the largest class over the smallest."""
    return (
        df.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "imbalance",
            F.max("n").over(Window.partitionBy()) / F.min("n").over(Window.partitionBy()),
        )
    )


def sample_deviation(n: Column, s: Column, s2: Column) -> Column:
    """From exact integer moments. n * s2 passes 64 bits at some ten million texts, hence decimals."""
    n, s, s2 = (c.cast("decimal(19,0)") for c in (n, s, s2))
    n1 = n.cast("double")
    return F.sqrt((n * s2 - s * s).cast("double") / F.nullif(n1 * (n1 - 1), F.lit(0.0)))


def word_count_stats(df: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, extremes of words per text."""
    words = df.select(tx.n_tokens(F.col("text")).alias("w"))
    s2 = F.sum(F.col("w").cast("long") * F.col("w"))
    return words.agg(
        F.count("w").alias("n_texts"),
        (F.sum("w") / F.count("w")).alias("mean_words"),
        F.percentile("w", F.lit(0.5)).alias("median_words"),
        sample_deviation(F.count("w"), F.sum("w"), s2).alias("std_words"),
        F.min("w").alias("min_words"),
        F.max("w").alias("max_words"),
    )


def contamination(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct texts of both tables and how many they share, on digests only."""
    left = a.select(F.md5("text").alias("h")).where("h IS NOT NULL")
    right = b.select(F.md5("text").alias("h")).where("h IS NOT NULL")
    sides = (
        left.select("h", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(right.select("h", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("h")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    return sides.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("unique_a"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("unique_b"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("overlap"),
    )


def contaminated_rows(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``a`` whose text also occurs in ``b``, met on digests and then on the unique id.

    Texts are not keyed by digest, so copies of one text make no hot key for them.
    """
    digests = b.select(F.md5("text").alias("_h")).distinct()
    found = a.select(id_col, F.md5("text").alias("_h")).join(digests, "_h", "left_semi").select(id_col)
    return a.join(found, id_col, "left_semi")


def before_after(raw: DataFrame, cleaned: DataFrame, top: int = 1000, bins: int = 60) -> DataFrame:
    """Word-count histogram (clipped) and median, before and after cleaning.

    Bins are equal slices of [min, max] of the clipped counts of each phase.
    Ranges, medians and bins all come from one table of exact word counts, which
    has at most one row per phase and count, however many texts there are.
    """
    words = (
        raw.where(F.col("text").isNotNull())
        .select(F.lit("before").alias("phase"), tx.n_tokens(F.col("text")).alias("w"))
        .unionByName(
            cleaned.select(F.lit("after").alias("phase"), tx.n_tokens(F.col("text")).alias("w"))
        )
    )
    exact = words.groupBy("phase", "w").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("phase")
    ordered = w.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    clipped = F.least("w", F.lit(top))
    upto, all_n = F.sum("n").over(ordered), F.sum("n").over(w)
    lo_hit = F.floor((all_n - 1) / 2)
    hi_hit = F.ceil((all_n - 1) / 2)
    enriched = exact.select(
        "phase", "w", "n",
        clipped.alias("c"),
        F.min(clipped).over(w).alias("lo"),
        F.max(clipped).over(w).alias("hi"),
        ((upto > lo_hit) & (upto - F.col("n") <= lo_hit)).alias("is_lo"),
        ((upto > hi_hit) & (upto - F.col("n") <= hi_hit)).alias("is_hi"),
    )
    position = F.floor((F.col("c") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))
    binned = enriched.withColumn(
        "median",
        (
            F.max(F.when(F.col("is_lo"), F.col("w"))).over(w)
            + F.max(F.when(F.col("is_hi"), F.col("w"))).over(w)
        )
        / 2.0,
    ).withColumn("bin", F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int"))
    return (
        binned.groupBy("phase", "bin")
        .agg(F.sum("n").alias("n"), F.first("median").alias("median_words"))
    )
