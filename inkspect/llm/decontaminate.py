"""Benchmark decontamination with suffix arrays of the training texts.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII.
Every task cuts its documents into shards of bounded size. A shard's words become
numbers of the test vocabulary; words outside it can't be part of a match and end a
run. Runs too short for any test window are left out, the others get a suffix array by
prefix doubling. All test suffixes are binary-searched in it together, which gives the
longest verbatim match of each and, as a range of the array, all places of a window of
``WINDOW`` words (a shorter item is one window). Nothing is shuffled.

The test set is read in blocks of at most ``BLOCK_WORDS`` words; each block is
broadcast, so the broadcast is bounded whatever the size of the test set.

Defined cases: a null or empty text has no words and is never contaminated; items that
are null, without words or without an id are ignored; repeated rows and null document
ids give a row each; rows of one item_id count as one item.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspect.llm.common import CHUNK_CHARS, id_text

WINDOW = 10
BLOCK_WORDS = 2_000_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
FOUND = "n_words long, spans array<int>, items array<string>, longest int"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``; zeros are separators and all different."""
    n = len(s)
    zero = s == 0
    rank = np.where(zero, np.cumsum(zero) - 1, s.astype(np.int64) + int(zero.sum()))
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1 or 2 * step >= n:
            return order
        step *= 2


class Tests:
    """A block of test items: word numbers, suffixes, window lengths."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.names = [name for name, _ in items]
        sizes = np.array([len(ws) for _, ws in items], dtype=np.int64)
        self.text = np.array([self.vocabulary[w] for _, ws in items for w in ws] + [0], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.left = np.repeat(starts + sizes, sizes) - np.arange(int(sizes.sum()))
        wide = np.minimum(sizes, window)
        self.window = np.repeat(wide, sizes)
        self.shortest = int(wide.min())


def _compare(tests: Tests, t: np.ndarray, train: np.ndarray, s: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common words of test suffixes t and training suffixes s, up to ``most``; whether the test is greater."""
    common, greater = np.zeros(len(t), np.int64), np.zeros(len(t), bool)
    at = np.arange(len(t))
    depth = 0
    while len(at):
        at = at[most[at] > depth]
        a, b = tests.text[t[at] + depth], train[np.minimum(s[at] + depth, len(train) - 1)]
        greater[at] = a > b
        at = at[a == b]
        depth += 1
        common[at] = depth
    greater[common == most] = False
    return common, greater


def _bound(tests: Tests, t: np.ndarray, train: np.ndarray, order: np.ndarray, most: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: the first training suffix not below (or above) each."""
    lo, hi = np.zeros(len(t), np.int64), np.full(len(t), len(order), np.int64)
    at = np.arange(len(t))
    while len(at):
        mid = (lo[at] + hi[at]) // 2
        common, right = _compare(tests, t[at], train, order[mid], most[at])
        if upper:
            right |= common == most[at]
        lo[at[right]], hi[at[~right]] = mid[right] + 1, mid[~right]
        at = at[lo[at] < hi[at]]
    return lo


def search(texts: list[str | None], tests: Tests) -> list[tuple[int, list[int], list[str], int]]:
    """For each text of a shard: words, merged hit spans [from, to, ...], items, longest match."""
    get = tests.vocabulary.get
    docs = []
    for text in texts:
        ws = words(text)
        docs.append(np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)))
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    # A zero after each document keeps matches inside it.
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    whole = np.zeros(int((sizes + 1).sum()), np.int64)
    for b, d in zip(begin, docs, strict=True):
        whole[b : b + len(d)] = d
    inside = np.diff(np.concatenate(([0], (whole != 0).astype(np.int8), [0])))
    run_from, run_to = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    long = run_to - run_from >= tests.shortest
    run_from, run_to = run_from[long], run_to[long]
    blank = [(int(n), [], [], 0) for n in sizes]
    if not len(run_from):
        return blank
    # The runs, each with the zero that ends it.
    lengths = run_to - run_from + 1
    place = np.repeat(run_from - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    train = whole[place]
    order = suffix_array(train)
    every = np.arange(len(tests.left))
    at = _bound(tests, every, train, order, tests.left, False)
    longest = np.zeros(len(every), np.int64)
    for near in (at - 1, at):
        ok = (near >= 0) & (near < len(order))
        common, _ = _compare(tests, every[ok], train, order[near[ok]], tests.left[ok])
        longest[ok] = np.maximum(longest[ok], common)
    t = np.flatnonzero((longest >= tests.window) & (tests.left >= tests.window))
    if not len(t):
        return blank
    first = _bound(tests, t, train, order, tests.window[t], False)
    last = _bound(tests, t, train, order, tests.window[t], True)
    n = last - first
    rows = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    t, s = np.repeat(t, n), order[rows]
    common, _ = _compare(tests, t, train, s, tests.left[t])
    spot = place[s]
    doc = np.searchsorted(begin, spot, side="right") - 1
    most = np.zeros(len(docs), np.int64)
    np.maximum.at(most, doc, common)
    edge = np.zeros(len(whole) + 1, np.int64)
    np.add.at(edge, spot, 1)
    np.add.at(edge, spot + tests.window[t], -1)
    hit = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0])))
    hit_from, hit_to = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    owner = np.searchsorted(begin, hit_from, side="right") - 1
    pairs = np.unique(doc * len(tests.names) + tests.item[t])
    out = [list(b) for b in blank]
    for i, a, b in zip(owner.tolist(), (hit_from - begin[owner]).tolist(), (hit_to - begin[owner]).tolist(), strict=True):
        out[i][1] += [a, b]
    for p in pairs.tolist():
        out[p // len(tests.names)][2].append(tests.names[p % len(tests.names)])
    return [(n, spans, sorted(set(items)), int(m)) for (n, spans, items, _), m in zip(out, most, strict=True)]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[Tests]:
    """The test set in blocks of bounded size; the driver holds one at a time."""
    items, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), text_col).filter(F.col(id_col).isNotNull())
    for name, text in rows.toLocalIterator():
        ws = words(text)
        if not ws:
            continue
        if items and size + len(ws) > most:
            yield Tests(items, window)
            items, size = [], 0
        items.append((name, ws))
        size += len(ws)
    if items:
        yield Tests(items, window)


def _merged(found: list) -> tuple:
    """Results of several blocks for one text as one."""
    spans, out = sorted((f["spans"][i], f["spans"][i + 1]) for f in found for i in range(0, len(f["spans"]), 2)), []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return found[0]["n_words"], out, sorted({i for f in found for i in f["items"]}), max(f["longest"] for f in found)


def marked(docs: DataFrame, text: Column, benchmark: DataFrame, name: str = "found", window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct column: words, hit spans, items and the longest match in words."""
    context = docs.sparkSession.sparkContext

    def one(tests: Tests | None):
        shared = context.broadcast(tests)

        @F.pandas_udf(FOUND)
        def found(column: pd.Series) -> pd.DataFrame:
            rows, shard, size = [], [], 0
            for value in [*column, None]:
                shard.append(value)
                size += len(value or "")
                if size > CHUNK_CHARS:
                    rows += search(shard, shared.value) if shared.value else [(len(words(v)), [], [], 0) for v in shard]
                    shard, size = [], 0
            rows += (search(shard, shared.value) if shared.value else [(len(words(v)), [], [], 0) for v in shard]) if shard else []
            return pd.DataFrame(rows[: len(column)], columns=["n_words", "spans", "items", "longest"])

        return found(text)

    results = [one(tests) for tests in blocks(benchmark, window=window, most=most)] or [one(None)]
    if len(results) == 1:
        return docs.withColumn(name, results[0])

    @F.pandas_udf(FOUND)
    def together(several: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_merged(list(s)) for s in several], columns=["n_words", "spans", "items", "longest"])

    return docs.withColumn(name, together(F.array(*results)))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest; ``marked`` gives the spans and longest matches themselves."""
    rows = marked(id_text(docs), F.col("text"), benchmark).select(F.col("id").alias("doc_id"), "found.*")
    hit = F.aggregate(
        F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("long"),
        lambda a, i: a + F.when(i % 2 == 0, -F.get("spans", i)).otherwise(F.get("spans", i)),
    )
    n_hit = F.when(F.size("spans") > 0, hit).otherwise(F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a test window, with their own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("body"))
    return marked(rows, F.col("body"), benchmark).filter("size(found.spans) = 0").select("doc.*")


SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM iw, UNNEST(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM dw, (SELECT DISTINCT n FROM win), UNNEST(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (n, g)),
spots AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
per AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS items FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN per USING (doc_id)
"""
