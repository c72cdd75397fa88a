"""Preparation of one labelled stage with its audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspect.operators import clean
from inkspect.sources.tables import read_clean, write_audit, write_clean


def prepare_stage(
    raw: DataFrame, stage: str, clean_path: str, audit_path: str,
    text_col: str = "text", label_col: str = "label", min_words: int = clean.MIN_WORDS,
) -> DataFrame:
    """Clean ``raw``, store the table and append its audit; returns the stored table."""
    write_clean(clean.clean(raw, text_col, label_col, min_words), clean_path)
    stored = read_clean(raw.sparkSession, clean_path)
    write_audit(audit(raw, stored, stage, text_col, label_col, min_words), audit_path)
    return stored


def audit(
    raw: DataFrame, cleaned: DataFrame, stage: str,
    text_col: str = "text", label_col: str = "label", min_words: int = clean.MIN_WORDS,
) -> DataFrame:
    """(stage, step, metric, value): funnel, class counts and word statistics."""
    funnel = _long(
        clean.funnel(raw, text_col, label_col, min_words), F.col("step"),
        ["rows_before", "rows_after", "removed", "removed_pct"],
    )
    words = _long(
        clean.word_count_stats(cleaned), F.lit("word_counts"),
        ["n_texts", "mean_words", "median_words", "std_words", "min_words", "max_words"],
    )
    renamed = raw.withColumnRenamed(label_col, "label") if label_col != "label" else raw
    classes = [
        _long(
            clean.class_balance(df), F.concat(F.lit(f"{phase}_class_"), F.col("label").cast("string")),
            ["n", "imbalance"],
        )
        for phase, df in (("raw", renamed), ("clean", cleaned))
    ]
    out = funnel.unionByName(words).unionByName(classes[0]).unionByName(classes[1])
    return out.select(F.lit(stage).alias("stage"), "step", "metric", "value")


def _long(df: DataFrame, step, columns: list[str]) -> DataFrame:
    rows = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(step.alias("step"), F.inline(rows))
