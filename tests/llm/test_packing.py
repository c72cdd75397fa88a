import random
import zlib

import numpy as np

from inkspect.llm import packing
from inkspect.llm.subwords import marking_encoder


def check(pieces, texts, window):
    encode = marking_encoder()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, text in texts.items():
        ids = np.array([*encode(text or ""), 0], dtype="<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    short = 0
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        short += at < window
    return short


def test_every_token_once_and_little_padding(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 1, 20, 63, 64, 200, 900]))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "x" * 20000}
    rows = [(d, t, 1) for d, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest int")
    assert check(packing.pack(df, window=64).collect(), texts, 64) <= 1


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "one two three")] * 3 + [(None, "four five")] * 2
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=8).collect()
    n = len(marking_encoder()("one two three")) + 1
    assert sum(p["length"] for p in pieces if p["doc_id"] == 1) == 3 * n
    assert sum(p["length"] for p in pieces if p["doc_id"] is None) == 2 * (len(marking_encoder()("four five")) + 1)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_uses_no_more_than_there_is():
    rng = random.Random(1)
    histogram = {k: rng.randrange(0, 400) for k in range(1, 64)}
    plan = packing.solve(histogram, 64)
    used = {}
    for lengths, n in plan:
        assert sum(lengths) == 64 and n > 0
        for k in lengths:
            used[k] = used.get(k, 0) + n
    assert all(used[k] <= histogram[k] for k in used)
    assert sum(used.values()) > 0.7 * sum(histogram.values())


def test_ids_equal_the_other_library(sf, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["a <|endoftext|> b", "  x\n\n  y", "\U0001f600\U0001f600", "it's we'll", "   "]
    encode = marking_encoder()
    assert [encode(t) for t in texts] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
