"""Quality scores learnt from preference pairs: a Bradley-Terry model over text features.

The model prefers one document to another with probability sigmoid(w.(x - y)).
Pairs hold a document labelled 1 against one labelled 0, so logistic loss on the
feature differences fits w. The decision threshold is a quantile of the scores of
the labelled rows, and the published score is sigmoid(w.x - threshold).

Only the fit uses a sample: at most ``SAMPLE_ROWS`` labelled rows of the learning
folds, those with the smallest hash of their id. Every document is scored whole.

Defined cases: a null text counts as empty and an empty text gets a score like any
other; rows are judged one by one, so repeated rows and null ids give a row each;
several labels of an id are averaged (1 from a half up), labels with a null id or
value are ignored; without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspect.llm.common import crc_mod, id_text, map_chunks
from inkspect.session import staged

SAMPLE_ROWS = 20_000
PAIRS_PER_ROW = 8
PAIR_BLOCK = 4_096
RIDGE = 1e-3
FOLDS = 3
HELD_OUT = 1
CLIP = 4.0

_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?-()|")
_DROP_SYMBOLS = bytes.maketrans(b"", b"")


def _without(data: bytes, gone: bytes) -> int:
    """How many bytes of ``data`` are in ``gone``."""
    return len(data) - len(data.translate(_DROP_SYMBOLS, gone))


_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:'\"?-()"


def features(text: str | None) -> list[float]:
    """Shape of a whole text: sizes, character classes, repetition of words and lines."""
    data = (text or "").encode("utf-8", "replace")
    words = data.lower().split()
    lines = data.split(b"\n")
    n, w = max(len(data), 1), max(len(words), 1)
    counts = Counter(words)
    top = counts.most_common(3)
    once = sum(1 for c in counts.values() if c == 1)
    follow = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    long_words = sum(map((14).__lt__, map(len, words)))
    same_lines = len(lines) - len(set(lines))
    shares = [
        _without(data, _UPPER) / n,
        _without(data, _DIGITS) / n,
        _without(data, _SYMBOLS) / n,
        _without(data, _STOPS) / n,
        data.count(b"!") / n,
        data.count(b"|") / n,
        (len(data) - len(text or "")) / n,
        follow / w,
        1 - pairs / max(len(words) - 1, 1),
        1 - len(counts) / w,
        once / w,
        sum(c for _, c in top) / w,
        (top[0][1] if top else 0) / w,
        long_words / w,
        same_lines / len(lines),
    ]
    sizes = [math.log1p(len(data)), math.log1p(len(words)), math.log1p(len(lines)), len(data) / w, len(words) / len(lines)]
    sizes[-1] = math.log1p(sizes[-1])
    # Square roots spread the shares near 0, where clean texts lie.
    return sizes + shares + [math.sqrt(max(s, 0.0)) for s in shares]


N_FEATURES = 35


def _design(raw: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((raw - mean) / scale, -CLIP, CLIP)
    return np.concatenate([z, z * z], axis=1)


def fit(raw: np.ndarray, label: np.ndarray, seed: int = 7) -> dict:
    """Weights and threshold from the sampled rows; all zero unless both labels occur."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        zero = np.zeros(2 * N_FEATURES)
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "w": zero, "threshold": 0.0}
    mean, scale = raw.mean(axis=0), raw.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = _design(raw, mean, scale)
    rng = np.random.default_rng(seed)
    n = PAIRS_PER_ROW * max(len(good), len(bad))
    better, worse = rng.choice(good, n), rng.choice(bad, n)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
        # The differences of all pairs would be many times the sample, so a block of them is held at a time.
        for at in range(0, n, PAIR_BLOCK):
            d = x[better[at:at + PAIR_BLOCK]] - x[worse[at:at + PAIR_BLOCK]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient -= d.T @ p
            hessian += (d * (p * (1 - p))[:, None]).T @ d
        gradient = gradient / n + RIDGE * w
        hessian = hessian / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = x @ w
    best, threshold = -1.0, 0.0
    for q in np.linspace(0.002, 0.998, 499):
        t = np.quantile(scores, q)
        balanced = (scores[good] >= t).mean() + (scores[bad] < t).mean()
        if balanced > best + 1e-12:
            best, threshold = balanced, float(t)
    return {"mean": mean, "scale": scale, "w": w, "threshold": threshold}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fit on a bounded, documented sample of the labelled rows of the learning folds."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    known = known.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & (crc_mod(F.col("id"), FOLDS) != HELD_OUT))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = staged(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS), "quality-sample")
    # At most SAMPLE_ROWS narrow rows are broadcast.
    rows = id_text(docs, id_col, text_col).join(F.broadcast(sample), "id")

    def measured(part: pa.RecordBatch) -> dict:
        texts = part.column("text").to_pylist()
        return {"id": part.column("id"), "y": part.column("y"), "x": [features(t) for t in texts]}

    table = map_chunks(rows.select("id", "text", "y"), measured, {"id": "bigint", "y": "int", "x": "array<double>"})
    found = table.orderBy("id", F.hash("x")).limit(2 * SAMPLE_ROWS).toPandas()
    raw = np.array(found["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return fit(raw, found["y"].to_numpy())


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: id, score and what ``keep`` names of the input."""
    kept = keep or []
    weights, threshold = model["w"], model["threshold"]

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            x = _design(np.array([features(t)]), model["mean"], model["scale"])
            out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x[0] @ weights) - threshold))))
        return pd.Series(out)

    return docs.select(F.col(id_col), *kept, scored(F.col(text_col)).alias("quality_score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    rows = score(id_text(docs), train(docs, labels), "id")
    return rows.select(
        F.col("id").alias("doc_id"),
        (crc_mod(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model accepts, with their own columns."""
    model = train(docs, labels)
    judged = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("body"))
    return score(judged, model, "doc", "body").filter("quality_score >= 0.5").select("doc.*")
