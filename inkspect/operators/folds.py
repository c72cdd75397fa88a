"""Stratified, seeded folds and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspect.operators.ranks import shuffled_rank


def kfold(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "doc_id", label: str = "label") -> DataFrame:
    """``fold`` 0..k-1; every class is dealt out evenly in its shuffled order."""
    ranked = shuffled_rank(df, label, id_col, seed, "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "group_size")


def split(
    df: DataFrame, fraction: float, seed: int, id_col: str = "doc_id", label: str = "label",
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """``split``: the given share of every class goes to the second name."""
    ranked = shuffled_rank(df, label, id_col, seed, "_rank")
    held_out = F.col("_rank") < F.floor(F.col("group_size") * fraction + 0.5)
    return ranked.withColumn("split", F.when(held_out, names[1]).otherwise(names[0])).drop(
        "_rank", "group_size"
    )


def holdout(df: DataFrame, seed: int = 42, **columns) -> DataFrame:
    """90/10 split made before any model is compared, so no choice sees the 10%."""
    return split(df, 0.10, seed, names=("train", "holdout"), **columns)
