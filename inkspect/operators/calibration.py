"""Probabilities from margins: out-of-fold margins and a sigmoid fitted by Newton steps.

The sigmoid 1 / (1 + exp(a m + b)) is fitted to smoothed targets, (n1 + 1) / (n1 + 2) and
1 / (n0 + 2), so that separable margins keep finite parameters. Every step is one
aggregation of five sums; the driver holds two parameters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspect.operators.folds import kfold
from inkspect.session import staged

STEPS = 30
SMALL = 1e-10


def cross_margins(
    train: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], k: int = 5, seed: int = 42, id_col: str = "doc_id"
) -> DataFrame:
    """(id, label, margin): every row's margin under a model that never saw it.

    ``fit`` takes training rows and returns a function that adds ``margin`` to rows.
    """
    rows = staged(kfold(train, k, seed, id_col), "margin-folds")
    out = None
    for fold in range(k):
        scored = fit(rows.where(F.col("fold") != fold))(rows.where(F.col("fold") == fold)).select(id_col, "label", "margin")
        out = scored if out is None else out.unionByName(scored)
    return staged(out, "margins")


def sigmoid(margin: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(margin * a + b))


def fit_sigmoid(margins: DataFrame, steps: int = STEPS) -> tuple[float, float]:
    """(a, b) of (label, margin) rows by Newton steps with halving; one class alone gives its smoothed share."""
    sizes = margins.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).first()
    n0, n1 = sizes["n0"], sizes["n1"]
    a, b = 0.0, math.log((n0 + 1) / (n1 + 1))
    if not n0 or not n1:
        return a, b
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    target = F.when(F.col("label") == 1, high).otherwise(low)
    m = F.col("margin")

    def loss(x: float, y: float) -> Column:
        f = m * x + y
        # log(1 + exp(f)) without overflow
        return F.sum(target * f - f + F.greatest(f, F.lit(0.0)) + F.log1p(F.exp(-F.abs(f))))

    for _ in range(steps):
        p = sigmoid(m, a, b)
        d, w = target - p, p * (1 - p)
        s = margins.agg(
            F.sum(m * d).alias("ga"), F.sum(d).alias("gb"), F.sum(m * m * w).alias("aa"), F.sum(m * w).alias("ab"),
            F.sum(w).alias("bb"), loss(a, b).alias("loss"),
        ).first()
        if abs(s["ga"]) < SMALL * (n0 + n1) and abs(s["gb"]) < SMALL * (n0 + n1):
            break
        aa, bb = s["aa"] + 1e-12, s["bb"] + 1e-12
        det = aa * bb - s["ab"] ** 2
        da, db = -(bb * s["ga"] - s["ab"] * s["gb"]) / det, -(aa * s["gb"] - s["ab"] * s["ga"]) / det
        # All halvings are judged in one pass; the longest that lowers the loss is taken.
        scales = [0.5**i for i in range(12)]
        tried = margins.agg(*[loss(a + r * da, b + r * db).alias(f"l{i}") for i, r in enumerate(scales)]).first()
        better = next((r for i, r in enumerate(scales) if tried[f"l{i}"] < s["loss"]), None)
        if better is None:
            break
        a, b = a + better * da, b + better * db
    return a, b


def brier(scores: DataFrame, *by: str, p: str = "p1", label: str = "label") -> DataFrame:
    """(by, brier): mean squared difference between probability and label."""
    gap = F.col(p) - F.col(label)
    return scores.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))
