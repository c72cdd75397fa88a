"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

Tokens are words (A-Z lower-cased). The log-odds of a word between toxic and clean labelled
texts come from counts of texts with a Dirichlet prior whose mean is the posterior of the
word's next shorter prefix (``CUTS`` bytes, then the whole word), so a rare word inherits from
its stem. A text that occurs in many near copies (equal smallest hash of its word triples)
counts once, and a word once per text.

Every token scores its log-odds less ``DRIFT``; a word right after itself adds nothing. One
linear scan finds all maximal scoring segments (each has the highest score around, none
overlap). The best segment of a clean text of m tokens follows an extreme-value law,
P(S < x) = exp(-K m exp(-lambda x)); lambda and K are fitted to the clean labelled texts, each
scored without its own counts. A segment is significant at ``LEVEL``. A text's evidence is its
best segment and the sum of its significant ones, both as lambda S - ln(K m); a logistic fit on
the labelled texts turns the two into the score.

Learning uses at most ``SAMPLE_ROWS`` labelled rows of the learning folds (those with the
smallest hash of their id) and keeps at most ``MODEL_ENTRIES`` words and prefixes, those of most
texts. Every document is scored whole.

Defined cases: null and empty texts have no tokens and get the score of a text without
evidence; rows are judged one by one, so repeated rows and null ids give a row each; several
labels of an id are averaged (1 from a half up), labels with a null id or value are ignored;
without labels of both kinds every score is 0.5; a score of exactly 0.5 predicts 1; extra
columns are ignored.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspect.llm.common import crc_mod, id_text, map_chunks
from inkspect.session import staged

SAMPLE_ROWS = 20_000
MODEL_ENTRIES = 400_000
FOLDS = 5
HELD_OUT = 0
CUTS = (3, 4, 5, 6, 7, 8, 10)
PRIOR = 3.0  # texts
DRIFT = 1.0
LEAST_TEXTS = 2
# Entries that move the log-odds of their prefix by less are left out.
LEAST_STEP = 0.25
LEVEL = 0.05
MEMO_WORDS = 300_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def chain(word: bytes) -> list[bytes]:
    """The prefixes of a word and the word itself (with a closing blank), shortest first."""
    return [*(word[:k] for k in CUTS if len(word) > k), word + b" "]


def copy_key(ws: list[bytes]) -> int:
    """Smallest hash of three words in a row; near copies mostly share it."""
    triples = zip(ws, ws[1:], ws[2:], strict=False) if len(ws) > 2 else [ws]
    return min(zlib.crc32(b" ".join(t)) for t in triples)


def segments(x: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, begin, end), by one scan over the positive values.

    left and right hold the running sums before and after each candidate; a candidate is
    joined with the nearest earlier one that starts lower, as long as it ends higher.
    """
    total = np.cumsum(x)
    at = np.flatnonzero(x > 0)
    left: list[float] = []
    right: list[float] = []
    begin: list[int] = []
    end: list[int] = []
    before: list[int] = []  # nearest earlier candidate with a lower left sum
    for i, r, v in zip(at.tolist(), total[at].tolist(), x[at].tolist(), strict=True):
        low, first = r - v, i
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = before[j]
            if j < 0 or right[j] >= r:
                break
            low, first = left[j], begin[j]
            del left[j:], right[j:], begin[j:], end[j:], before[j:]
            j = len(left) - 1
        left.append(low)
        right.append(r)
        begin.append(first)
        end.append(i + 1)
        before.append(j)
    return [(r - a, b, e) for a, r, b, e in zip(left, right, begin, end, strict=True)]


def token_scores(ws: list[bytes], score: Callable[[bytes], float]) -> np.ndarray:
    x = np.fromiter(map(score, ws), np.float64, len(ws))
    if len(ws) > 1:
        x[1:][np.fromiter(map(operator.eq, ws, ws[1:]), bool, len(ws) - 1)] = 0.0
    return x - DRIFT


def posterior(counts: Callable[[bytes], tuple | None], entries: list[bytes], prior: float) -> tuple[float, float]:
    """Shares of toxic and of clean texts for a chain of entries; each one's prior mean is the one before it.

    Both shares are kept: after some entries that clean texts never have, 1 less the toxic share would be 0.
    """
    q, r = prior, 1 - prior
    for e in entries:
        n = counts(e)
        if n is not None:
            q, r = updated(n, q, r)
    return q, r


def updated(n: tuple[float, float], q: float, r: float) -> tuple[float, float]:
    total = n[0] + n[1] + PRIOR
    return (n[0] + PRIOR * q) / total, (n[1] + PRIOR * r) / total


def log_odds(q: float, r: float) -> float:
    return math.log(q) - math.log(r)


def logit(q: float) -> float:
    return log_odds(q, 1 - q)


def pruned(found: dict[bytes, tuple[float, float]], prior: float) -> tuple[dict, dict]:
    """Counts of the entries that matter, and the log-odds of each against the prior."""
    kept, odds = {}, {}
    for e in sorted(found, key=lambda e: (e[-1:] == b" ", len(e))):
        line = chain(e[:-1]) if e[-1:] == b" " else [*(e[:k] for k in CUTS if k < len(e)), e]
        above = posterior(kept.get, line[:-1], prior)
        own = log_odds(*updated(found[e], *above))
        if abs(own - log_odds(*above)) >= LEAST_STEP:
            kept[e], odds[e] = found[e], own - logit(prior)
    return kept, odds


class Lookup(dict):
    """Score per word, found once: that of its longest known entry."""

    def __init__(self, odds: dict[bytes, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> float:
        get = self.odds.get
        value = next((v for v in map(get, reversed(chain(word))) if v is not None), 0.0)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value


def fit_extremes(best: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """lambda and K by maximum likelihood; texts without a segment are censored, the top percent is left out."""
    some = size > 0
    best, size = best[some], size[some]
    if not len(best) or not (best > 0).any():
        return 1.0, 1.0 / max(float(size.sum()), 1.0)
    near = best <= np.quantile(best, 0.99)
    best, size = best[near], size[near].astype(float)
    n, total = max(int((best > 0).sum()), 1), float(best.sum())

    def likelihood(rate: float) -> float:
        return n * math.log(rate) - rate * total - n * math.log(float((size * np.exp(-rate * best)).sum()))

    low, high = math.log(0.02), math.log(20.0)
    for _ in range(60):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if likelihood(math.exp(a)) < likelihood(math.exp(b)) else (low, b)
    rate = math.exp((low + high) / 2)
    return rate, n / float((size * np.exp(-rate * best)).sum())


def evidence(best: float, every: list[float], size: int, rate: float, k: float) -> tuple[float, float]:
    """Best segment and sum of the significant ones, as standardised extreme values."""
    offset = math.log(k * max(size, 1))
    least = -math.log(-math.log(1 - LEVEL))
    held = [rate * s - offset for s in every]
    return rate * best - offset, sum(h for h in held if h > least)


def _inputs(best, total) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.arcsinh(np.asarray(best) / 4), np.log1p(np.asarray(total) / 4)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = 1e-3 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge
        step = np.linalg.solve(hessian, x.T @ (y - p) / len(y) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """(id, y, text, copy): the bounded, documented sample of labelled rows, stored."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    known = known.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & (crc_mod(F.col("id"), FOLDS) != HELD_OUT))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = staged(known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS), "toxic-labels")
    # At most SAMPLE_ROWS narrow rows are broadcast.
    rows = id_text(docs).join(F.broadcast(known), "id").select("id", "y", "text")

    def keyed(part: pa.RecordBatch) -> dict:
        found = [words(t) for t in part.column("text").to_pylist()]
        return {"id": part.column("id"), "y": part.column("y"), "text": part.column("text"), "copy": [copy_key(w) for w in found]}

    return staged(map_chunks(rows, keyed, {"id": "bigint", "y": "int", "text": "string", "copy": "bigint"}), "toxic-sample")


def entry_counts(rows: DataFrame) -> tuple[dict[bytes, tuple[float, float]], float]:
    """Toxic and clean texts per word and prefix, one text per group of copies; and the share of toxic texts."""
    once = rows.groupBy("y", "copy").agg(F.min("id").alias("id"))
    texts = rows.join(F.broadcast(once.select("id").distinct()), "id").select("y", "text")
    share = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def counted(part: pa.RecordBatch) -> dict:
        n = [Counter(), Counter()]
        for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
            n[y].update(set(words(text)))
        seen = list(n[0].keys() | n[1].keys())
        return {"word": seen, "toxic": [n[1][w] for w in seen], "clean": [n[0][w] for w in seen]}

    shape = {"word": "binary", "toxic": "bigint", "clean": "bigint"}
    both = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    per_word = map_chunks(texts, counted, shape).groupBy("word").agg(*both)

    def spelled(part: pa.RecordBatch) -> dict:
        n = [Counter(), Counter()]
        for w, a, b in zip(*(part.column(c).to_pylist() for c in shape), strict=True):
            for e in chain(w):
                n[1][e] += a
                n[0][e] += b
        seen = list(n[1])
        return {"word": seen, "toxic": [n[1][w] for w in seen], "clean": [n[0][w] for w in seen]}

    entries = map_chunks(per_word, spelled, shape, "word").groupBy("word").agg(*both).withColumn("n", F.col("toxic") + F.col("clean"))
    entries = staged(entries.where(F.col("n") >= LEAST_TEXTS), "toxic-entries")
    # Entries per count of texts: at most one row per sampled text and word length.
    least, held = LEAST_TEXTS, 0
    for r in entries.groupBy("n").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("n")).collect():
        held += r["many"]
        if held > MODEL_ENTRIES:
            least = r["n"] + 1
            break
    found = entries.where(F.col("n") >= least).select("word", "toxic", "clean").collect()
    total = max(sum(share.values()), 1)
    return {bytes(r["word"]): (float(r["toxic"]), float(r["clean"])) for r in found}, share.get(1, 0) / total


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Log-odds, extreme-value law and logistic weights; None unless both labels occur."""
    rows = sample(docs, labels)
    found, prior = entry_counts(rows)
    if not 0 < prior < 1:
        return None
    kept, odds = pruned(found, prior)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((kept, prior))

    def left_out(part: pa.RecordBatch) -> dict:
        """Segments of each labelled text by the counts of the other texts."""
        counts, prior = shared.value
        out = {"y": [], "size": [], "best": [], "every": []}
        for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
            ws = words(text)
            mine = Counter(e for w in set(ws) for e in chain(w) if e in counts)

            def without(e, y=y, mine=mine):
                n = counts.get(e)
                return n and ((max(n[0] - mine[e], 0.0), n[1]) if y else (n[0], max(n[1] - mine[e], 0.0)))

            by_word = {w: log_odds(*posterior(without, chain(w), prior)) - logit(prior) for w in set(ws)}
            held = [s for s, _, _ in segments(token_scores(ws, by_word.__getitem__))]
            out["y"].append(y)
            out["size"].append(len(ws))
            out["best"].append(max(held, default=0.0))
            out["every"].append(held)
        return out

    shape = {"y": "int", "size": "bigint", "best": "double", "every": "array<double>"}
    scored = staged(map_chunks(rows.select("y", "text"), left_out, shape), "toxic-segments")
    clean = scored.where("y = 0").select("best", "size").toPandas()  # at most SAMPLE_ROWS pairs of numbers
    rate, k = fit_extremes(clean["best"].to_numpy(), clean["size"].to_numpy())
    offset = F.log(F.lit(k) * F.greatest(F.col("size"), F.lit(1)))
    least = -math.log(-math.log(1 - LEVEL))
    held = F.filter(F.transform("every", lambda s: s * rate - offset), lambda h: h > least)
    total = F.aggregate(held, F.lit(0.0), lambda a, h: a + h)
    pairs = scored.select("y", (F.col("best") * rate - offset).alias("best"), total.alias("total")).toPandas()
    weights = fit_logistic(_inputs(pairs["best"], pairs["total"]), pairs["y"].to_numpy(dtype=float))
    return {"odds": odds, "rate": rate, "k": k, "weights": weights}


def judged(rows: DataFrame, model: dict | None) -> DataFrame:
    """(id, toxic_score, begins, ends, p_values): the score of (id, text) rows and their significant passages, in words."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    memo: list[Lookup] = []  # one per Python worker

    def run(part: pa.RecordBatch) -> dict:
        known = shared.value
        texts = part.column("text").to_pylist()
        if known is None:
            blank = [[] for _ in texts]
            return {"id": part.column("id"), "toxic_score": [0.5] * len(texts), "begins": blank, "ends": blank, "p_values": blank}
        if not memo:
            memo.append(Lookup(known["odds"]))
        rate, k = known["rate"], known["k"]
        best, total, begins, ends, p_values = [], [], [], [], []
        for text in texts:
            ws = words(text)
            held = segments(token_scores(ws, memo[0].__getitem__)) if ws else []
            top, added = evidence(max((s for s, _, _ in held), default=0.0), [s for s, _, _ in held], len(ws), rate, k)
            chance = [-math.expm1(-k * len(ws) * math.exp(-rate * s)) for s, _, _ in held]
            strong = [(b, e, p) for (_, b, e), p in zip(held, chance, strict=True) if p < LEVEL]
            best.append(top)
            total.append(added)
            begins.append([b for b, _, _ in strong])
            ends.append([e for _, e, _ in strong])
            p_values.append([p for _, _, p in strong])
        score = 1 / (1 + np.exp(-np.clip(_inputs(best, total) @ known["weights"], -30, 30)))
        return {"id": part.column("id"), "toxic_score": score, "begins": begins, "ends": ends, "p_values": p_values}

    shape = {"id": "bigint", "toxic_score": "double", "begins": "array<int>", "ends": "array<int>", "p_values": "array<double>"}
    return map_chunks(rows.select("id", "text"), run, shape)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, held_out, score, predicted."""
    rows = judged(id_text(docs), train(docs, labels))
    return rows.select(
        F.col("id").alias("doc_id"),
        (crc_mod(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
