"""Importance resampling towards a target distribution over hashed word n-grams.

A text is lower-cased (A-Z) and its words joined by one space. It is scanned once: per
word the running CRC-32 of everything up to the word's end is stored. The CRC of any
n-gram then follows from two prefixes alone: with CRC(AB) = shift(CRC(A), |B|) xor CRC(B),
where shift multiplies by x^(8 |B|) modulo the CRC polynomial over GF(2), the part before
the n-gram is shifted by the n-gram's length and cancelled. Shifts are table look-ups: one
set of tables per length up to ``NEAR`` bytes, and per power of two beyond it.

The running CRCs and word lengths of all documents are kept in the shared folder (8 bytes a
word), so neither bucket counts nor weights read the texts again. The driver holds one
number per bucket. Ranks come from a range sort over all rows with a bounded table of
counts per partition; no row, score or tie is one task's work.

Defined cases: null and empty texts have no words, no features and weight 0; repeated rows and
rows without an id (their draw key is the empty text) are judged one by one and rank next to
each other by their id (nulls first), feature count and weight; an empty target or an empty
corpus has only the smoothed counts; extra columns are ignored by ``resample`` and
returned by ``drawn``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspect.llm.common import id_text, text_chunks
from inkspect.session import staged

BUCKETS = 10_000
LONGEST = 3  # words of an n-gram
LEAST_WORDS = 20
SHARE = 5  # percent of the documents that are long enough
SEED = 42
NEAR = 64
WORDS_AT_A_TIME = 400_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


BYTE = _byte_table()


def _look_up(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as one table per byte."""
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    return BYTE[crc & 255] ^ (crc >> 8)


def _near_tables() -> np.ndarray:
    """[length, byte, value]: shift by 0 .. NEAR bytes, flattened per byte."""
    crc = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [crc]
    for _ in range(NEAR):
        out.append(_zero_byte(out[-1]))
    return np.stack(out)


TABLES = _near_tables()
_FLAT = [np.ascontiguousarray(TABLES[:, k, :]).reshape(-1) for k in range(4)]


def shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs multiplied by x^(8 size): as if that many zero bytes followed."""
    near = np.minimum(size, NEAR).astype(np.int64) << 8
    out = _FLAT[0][near + (crc & 255)] ^ _FLAT[1][near + ((crc >> 8) & 255)]
    out ^= _FLAT[2][near + ((crc >> 16) & 255)] ^ _FLAT[3][near + (crc >> 24)]
    far = np.flatnonzero(size > NEAR)
    if len(far):
        rest, step = size[far] - NEAR, TABLES[1]
        while rest.any():
            odd = (rest & 1).astype(bool)
            out[far[odd]] = _look_up(step, out[far[odd]])
            rest = rest >> 1
            step = _look_up(step, step)  # the map applied twice
    return out


def running(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Running CRC at the end of every word of the normalised text, and the words' byte lengths."""
    words = (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    crc, ends = 0, []
    for piece in b" ".join(words).replace(b" ", b"\n ").split(b"\n"):
        crc = zlib.crc32(piece, crc)
        ends.append(crc)
    return np.array(ends, np.uint32), np.fromiter(map(len, words), np.uint32, len(words))


def buckets_of(ends: np.ndarray, sizes: np.ndarray, longest: int = LONGEST, buckets: int = BUCKETS) -> list[np.ndarray]:
    """Per n-gram length the bucket of the n-gram that ends at each word (the first n - 1 words end none)."""
    # CRC before each word: the running CRC of the word before it, and a space.
    raw = ends[:-1] ^ np.uint32(0xFFFFFFFF)
    after = BYTE[(raw ^ 32) & 255] ^ (raw >> 8) ^ np.uint32(0xFFFFFFFF)
    before = np.concatenate((np.zeros(min(1, len(ends)), np.uint32), after))
    total = np.concatenate(([0], np.cumsum(sizes.astype(np.int64) + 1)))
    out = []
    for n in range(1, min(longest, len(ends)) + 1):
        length = total[n:] - total[:-n] - 1
        out.append((ends[n - 1 :] ^ shift(before[: len(before) - n + 1], length)) % np.uint32(buckets))
    return out


def scanned(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns, ends, sizes): the running CRCs and word lengths of column ``text`` as little-endian numbers."""
    names = [*columns, "ends", "sizes"]
    types = dict(docs.dtypes)
    ddl = ", ".join([*(f"{c} {types[c]}" for c in columns), "ends binary", "sizes binary"])

    def run(batches: Iterator[pa.RecordBatch]):
        for part in text_chunks(batches):
            found = [running(t) for t in part.column("text").to_pylist()]
            crcs = pa.array([e.astype("<u4").tobytes() for e, _ in found], pa.binary())
            sizes = pa.array([s.astype("<u4").tobytes() for _, s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), crcs, sizes], names=names)

    return docs.select(*columns, "text").mapInArrow(run, ddl)


def _stored(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ends, sizes in zip(part.column("ends"), part.column("sizes"), strict=True):
        yield np.frombuffer(ends.as_buffer(), "<u4"), np.frombuffer(sizes.as_buffer(), "<u4")


def bucket_counts(stored: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; added up in each task first."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for part in text_chunks(batches, "ends"):
            for ends, sizes in _stored(part):
                for found in buckets_of(ends, sizes, buckets=buckets):
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64())})

    rows = stored.select("ends", "sizes").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and source shares, per bucket, rounded down."""
    n, s, t = float(len(source)), float(source.sum()), float(target.sum())
    ratios = [((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)) for a, b in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighted(stored: DataFrame, gain: np.ndarray, *columns: str) -> DataFrame:
    """(columns, n_words, n_features, weight) of every stored text."""
    types = dict(stored.dtypes)
    ddl = ", ".join([*(f"{c} {types[c]}" for c in columns), "n_words bigint", "n_features bigint", "weight bigint"])
    names = [*columns, "n_words", "n_features", "weight"]

    def run(batches):
        for part in text_chunks(batches, "ends"):
            n_words, n_features, weight = [], [], []
            for ends, sizes in _stored(part):
                found = buckets_of(ends, sizes, buckets=len(gain))
                n_words.append(len(ends))
                n_features.append(sum(map(len, found)))
                weight.append(sum(int(gain[f].sum()) for f in found))
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *numbers], names=names)

    return stored.select(*columns, "ends", "sizes").mapInArrow(run, ddl)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that depends on the id alone, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` 1, 2, 3 .. to the ``share`` percent of highest scores among texts of enough words."""
    rows = staged(rows.withColumn("short", F.col("n_words") < least_words), "resampling-scores")
    order = [F.col("short"), F.desc("score"), F.asc_nulls_first("id"), F.col("n_features"), F.col("weight")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Partition number in the upper 31 bits, row number in the lower 33.
    dealt = staged(dealt.withColumn("place", F.monotonically_increasing_id()), "resampling-order")
    parts = dealt.groupBy(F.shiftright("place", 33).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("short")).alias("eligible")
    ).collect()  # one row per partition
    parts = sorted(parts, key=lambda r: r["part"])
    drawn = share * sum(r["eligible"] for r in parts) // 100
    offsets, before = [], 0
    for r in parts:
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(dealt.sparkSession.createDataFrame(offsets, "part bigint, before bigint"))
    place = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = dealt.withColumn("part", F.shiftright("place", 33)).join(offsets, "part", "left")
    return out.withColumn("rank", F.when(place <= drawn, place)).drop("part", "before", "place", "short")


def scores(docs: DataFrame, target: DataFrame, *columns: str, target_text: str = "text") -> DataFrame:
    """Feature count, weight and score of (id, text, columns) rows, by the bucket counts of all rows and the target."""
    source = staged(scanned(docs, "id", *columns), "resampling-crcs")
    aim = staged(scanned(target.select(F.col(target_text).alias("text"))), "resampling-target")
    gain = gains(bucket_counts(source), bucket_counts(aim))
    rows = weighted(source, gain, "id", *columns)
    return rows.withColumn("score", F.col("weight") + noise(F.col("id")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE) -> DataFrame:
    """The contract's digest of every document."""
    rows = ranked(scores(id_text(docs), target), share)
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn documents with their own columns."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("doc"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "resampling-rows")
    chosen = ranked(scores(rows.select("id", "text", "row"), target, "row"), share).where("rank IS NOT NULL")
    return rows.join(chosen.select("row"), "row", "left_semi").select("doc.*")


SQL = r"""
WITH table_ AS (SELECT list(v ORDER BY b) AS crc FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM range(256) AS t(b))),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aims AS (SELECT row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT r, FALSE AS aim, array_to_string(w[i:i + n - 1], ' ') AS g FROM docs, range(1, 4) AS k(n), UNNEST(range(1, len(w) - n + 2)) AS t(i)
  UNION ALL SELECT r, TRUE, array_to_string(w[i:i + n - 1], ' ') FROM aims, range(1, 4) AS k(n), UNNEST(range(1, len(w) - n + 2)) AS t(i)),
bytes AS (SELECT g, list_transform(range(octet_length(encode(g))), lambda i: CAST(('0x' || substr(hex(encode(g)), 2 * i + 1, 2)) AS BIGINT)) AS b
  FROM (SELECT DISTINCT g FROM grams)),
hashed AS (SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, crc[CAST((xor(a, x) & 255) + 1 AS BIGINT)]))) % 10000 AS bucket
  FROM bytes, table_),
features AS (SELECT r, aim, bucket FROM grams JOIN hashed USING (g)),
counts AS (SELECT bucket, CAST(count(*) FILTER (WHERE NOT aim) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE aim) AS DOUBLE) AS t FROM features GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counts),
per AS (SELECT r, count(*) AS n_features, sum(gain) AS weight FROM features JOIN gain USING (bucket) WHERE NOT aim GROUP BY r),
scored AS (SELECT r, doc_id, len(w) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN per USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place,
  count(*) FILTER (WHERE eligible) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
