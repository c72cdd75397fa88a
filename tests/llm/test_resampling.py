import hashlib
import math
import random
import zlib

import numpy as np

from inkspect.llm import resampling as rs


def words(text):
    return (text or "").encode().translate(rs._WORD_BYTES).split()


def grams(text):
    ws = words(text)
    return [b" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute(docs, target, share=5):
    s, t = np.zeros(rs.BUCKETS), np.zeros(rs.BUCKETS)
    for text in docs:
        for g in grams(text[1]):
            s[zlib.crc32(g) % rs.BUCKETS] += 1
    for text in target:
        for g in grams(text):
            t[zlib.crc32(g) % rs.BUCKETS] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + rs.BUCKETS) / ((a + 1) * (t.sum() + rs.BUCKETS)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        g = grams(text)
        weight = sum(gain[zlib.crc32(x) % rs.BUCKETS] for x in g)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(g), weight, score, None, len(words(text)) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: share * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_crc_of_any_run_from_two_prefixes():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 40):
        ws = ["".join(rng.choices("abz019é", k=rng.choice([1, 3, 20, 63, 64, 65, 66, 500, 70_000]))) for _ in range(n)]
        text = " ,. ".join(ws)
        ends, sizes = rs.running(text)
        found = rs.buckets_of(ends, sizes, buckets=1 << 32 - 1)
        assert [b for part in found for b in part.tolist()] == [zlib.crc32(g) % (1 << 31) for g in grams(text)]


def test_shift_equals_appended_zeros():
    rng = random.Random(2)
    for size in (0, 1, 63, 64, 65, 1000, 123_457):
        crc = rng.getrandbits(32)
        want = zlib.crc32(bytes(size), crc ^ 0xFFFFFFFF) ^ 0xFFFFFFFF  # a register of crc, fed zeros
        assert rs.shift(np.array([crc], np.uint32), np.array([size]))[0] == want


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "x" * 80]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 21, 200])))) for i in range(300)]
    docs += [docs[7]] * 40 + [(7, "other text " * 30), (None, "no id " * 20), (900, None), (901, ""), (902, "w1 " * 40_000)]
    target = [" ".join(rng.choices(vocabulary[:20], k=50)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, weight int, ends string")
    aim = spark.createDataFrame([(t, 1.0) for t in target], "text string, score double")
    got = sorted((tuple(r) for r in rs.resample(df, aim).collect()), key=str)
    assert got == brute(docs, target)


def test_equal_scores_are_ranked_by_id(spark):
    docs = [(5, "same words here " * 10)] * 50 + [(4, "same words here " * 10)] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    aim = spark.createDataFrame([("other",)], "text string")
    rows = rs.resample(df, aim, share=30).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 31))
    assert sorted((tuple(r) for r in rows), key=str) == brute(docs, ["other"], 30)


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 30, i, "r") for i in range(100)], "doc_id long, text string, row int, rank string")
    aim = spark.createDataFrame([("word5 word5 word5",)], "text string")
    out = rs.drawn(docs, aim)
    assert out.columns == docs.columns and out.count() == 5
    wanted = {r["doc_id"] for r in rs.resample(docs, aim).where("rank is not null").collect()}
    assert {r["doc_id"] for r in out.collect()} == wanted


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words " * 20)], "doc_id long, text string")
    none = docs.limit(0)
    assert rs.resample(none, docs).count() == 0
    row = rs.resample(docs, none).collect()[0]
    assert (row["n_features"], row["rank"]) == (40 + 39 + 38, None)
