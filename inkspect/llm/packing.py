"""Packing token sequences: window plans by non-negative least squares, the rest greedily.

Each document's ids (and a closing id 0) are cut into full windows and one remainder.
The histogram of remainder lengths has at most 1023 entries whatever the corpus.
Combinations of two or three lengths that fill a window exactly are columns of a
matrix A; repeat counts x >= 0 minimise |A x - histogram|, are rounded and never use
more pieces than there are. Pieces get their place in the plan by their rank among
pieces of equal length, counted in two levels (part, then parts), so no length is one
task's work. Pieces beyond the plan are packed in even shards: largest first, best fit,
and a gap that nothing fits is closed by cutting the smallest piece. At most one
sequence per shard of ``SHARD_ROWS`` pieces is not full.

Defined cases: a null or empty text is the closing id alone; null ids and repeated rows
are packed like any other row; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspect.llm.common import id_text, joined_small, text_chunks
from inkspect.llm.subwords import marking_encoder as encoder
from inkspect.session import staged

WINDOW = 1024
END_ID = 0
TRIPLES_PER_LENGTH = 6
SWEEPS = 60
SHARD_ROWS = 20_000
# Chunks of text whose pieces are ranked together.
CHUNKS_PER_PART = 16

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """A row per document: size, checksums of its full windows, its remainder with rank in its part."""
    schema = pa.schema([
        ("id", pa.int64()), ("total", pa.int64()), ("crcs", pa.list_(pa.int64())), ("part", pa.int64()),
        ("full_before", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("rest_crc", pa.int64()), ("rest_ids", pa.binary()),
    ])

    def run(batches):
        encode, task = encoder(path), TaskContext.get().partitionId()
        for number, chunk in enumerate(text_chunks(batches)):
            if number % CHUNKS_PER_PART == 0:
                ranks, full = defaultdict(int), 0
            rows = []
            for doc, text in zip(chunk.column("id").to_pylist(), chunk.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype=np.uint32)
                n = len(ids) // window
                crcs = [_crc(ids[i * window : (i + 1) * window]) for i in range(n)]
                rest = ids[n * window :]
                rows.append((doc, len(ids), crcs, (task << 24) + number // CHUNKS_PER_PART, full, len(rest), ranks[len(rest)], _crc(rest), rest.astype("<u4").tobytes()))
                full += n
                ranks[len(rest)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    ddl = "id bigint, total bigint, crcs array<bigint>, part bigint, full_before bigint, rest int, rank bigint, rest_crc bigint, rest_ids binary"
    return docs.mapInArrow(run, ddl)


def combinations(window: int, lengths: set[int]) -> list[tuple[int, ...]]:
    """Two or three of the lengths that fill the window; of threes an even choice per smallest length."""
    out = [(a, window - a) for a in sorted(lengths) if a <= window - a and window - a in lengths]
    for a in sorted(x for x in lengths if 3 * x <= window):
        seconds = [b for b in range(a, (window - a) // 2 + 1) if b in lengths and window - a - b in lengths]
        step = max(1, len(seconds) // TRIPLES_PER_LENGTH)
        out += [(a, b, window - a - b) for b in seconds[:: step][:TRIPLES_PER_LENGTH]]
    return out


def solve(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with whole repeat counts, from least squares over x >= 0 by coordinate descent."""
    columns = combinations(window, {k for k, v in histogram.items() if v > 0})
    left = [0.0] * (window + 1)
    for k, v in histogram.items():
        left[k] = float(v)
    weights = [{k: c.count(k) for k in set(c)} for c in columns]
    norms = [sum(m * m for m in w.values()) for w in weights]
    x = [0.0] * len(columns)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, w in enumerate(weights):
            gain = sum(m * left[k] for k, m in w.items()) / norms[j]
            step = max(gain, -x[j])
            if step:
                x[j] += step
                moved += abs(step)
                for k, m in w.items():
                    left[k] -= m * step
        if moved < 1e-3 * (1 + sum(x)):
            break
    stock, plan = dict(histogram), []
    for j in sorted(range(len(columns)), key=lambda j: (-x[j], columns[j])):
        n = min([round(x[j]), *(stock[k] // m for k, m in weights[j].items())])
        if n > 0:
            plan.append((columns[j], n))
            for k, m in weights[j].items():
                stock[k] -= m * n
    return plan


def greedy(pieces: list[tuple[int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, to, sequence, offset) of pieces (number, length): best fit, gaps closed by a cut."""
    stacks: dict[int, list] = defaultdict(list)
    for number, length in pieces:
        stacks[length].append((number, 0, length))
    sizes = sorted(stacks)
    out, sequence, filled = [], 0, 0

    def take(at: int):
        length = sizes[at]
        piece = stacks[length].pop()
        if not stacks[length]:
            del stacks[length], sizes[at]
        return piece

    while sizes:
        at = bisect_right(sizes, window - filled) - 1
        if at >= 0:
            number, a, b = take(at)
        else:
            number, a, b = take(0)
            cut = a + window - filled
            rest = b - cut
            if rest not in stacks:
                insort(sizes, rest)
            stacks[rest].append((number, cut, b))
            b = cut
        out.append((number, a, b, sequence, filled))
        filled += b - a
        if filled == window:
            sequence, filled = sequence + 1, 0
    return out


def _packed_shard(shards: int, base: int, window: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        out = []
        rows = rows.sort_values(["rest", "g"], kind="stable").reset_index(drop=True)
        ids = [None if pd.isna(v) else int(v) for v in rows["id"]]
        for number, a, b, sequence, offset in greedy(list(zip(rows.index, rows["rest"].tolist(), strict=True)), window):
            total = int(rows["total"][number])
            part = np.frombuffer(rows["rest_ids"][number], dtype="<u4")[a:b]
            start = total - int(rows["rest"][number]) + a
            out.append((ids[number], start, b - a, _crc(part), total, base + sequence * shards + shard, offset))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces of sequences of ``window`` tokens."""
    spark = docs.sparkSession
    # Ids travel as text, since data frames of pandas hold null longs as doubles.
    rows = staged(tokenised(id_text(docs, id_col, text_col), window, path), "tokens")
    histogram = {r[0]: r[1] for r in rows.filter("rest > 0").groupBy("rest").count().collect()}
    plan = solve(histogram, window)

    # Full windows: numbered by part.
    parts = staged(rows.groupBy("part").agg(F.max(F.col("full_before") + F.size("crcs")).alias("n")), "parts")
    n_full = parts.agg(F.sum("n")).first()[0] or 0
    n_parts = parts.count()
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    full = joined_small(rows.filter(F.size("crcs") > 0).drop("rest_ids"), parts, "part", "inner", n_parts)
    full = full.select("id", "total", (F.col("base") + F.col("full_before")).alias("first"), F.posexplode("crcs").alias("i", "crc")).select(
        F.col("id").alias("doc_id"), (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), (F.col("first") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    # Remainders: rank among all of their length, then the place that the plan gives to that rank.
    counts = rows.filter("rest > 0").groupBy("part", "rest").agg((F.max("rank") + 1).alias("n"))
    order = Window.partitionBy("rest").orderBy("part")
    before = staged(counts.select("part", "rest", (F.sum("n").over(order) - F.col("n")).alias("before")), "before")
    ranked = joined_small(rows.filter("rest > 0").drop("crcs", "full_before"), before, ["part", "rest"], "inner", before.count())
    ranked = ranked.withColumn("g", F.col("rank") + F.col("before"))
    slots, used, base = [], defaultdict(int), n_full
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            slots.append((length, used[length], used[length] + n, base, offset))
            used[length] += n
            offset += length
        base += n
    # A few thousand slots at most: three for each combination.
    table = spark.createDataFrame(slots, "rest int, lo long, hi long, seq long, offset long")
    planned = ranked.drop("rest_ids").join(F.broadcast(table), "rest").filter("g >= lo and g < hi").select(
        F.col("id").alias("doc_id"), (F.col("total") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"),
        F.col("rest_crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), (F.col("seq") + F.col("g") - F.col("lo")).alias("sequence_id"),
        "offset",
    )
    n_left = sum(n - used[k] for k, n in histogram.items())
    shards = max(1, -(-n_left // SHARD_ROWS))
    beyond = spark.createDataFrame([(k, used[k]) for k in histogram], "rest int, used long")
    left = ranked.join(F.broadcast(beyond), "rest").filter("g >= used").select(
        F.col("id").cast("string").alias("id"), "total", "rest", "g", "rest_ids", F.pmod(F.xxhash64("rest", "g"), F.lit(shards)).alias("shard")
    )
    greedily = left.groupBy("shard").applyInPandas(_packed_shard(shards, base, window), PIECE)
    return full.unionByName(planned).unionByName(greedily)
