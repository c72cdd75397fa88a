import random

import numpy as np

from inkspect.llm import toxicity as tx
from inkspect.llm.common import id_text


def brute(x):
    """Best run first, then the same left and right of it."""
    best = max(((sum(x[i:j]), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, i, j = best
    return [*brute(x[:i]), best, *((s, a + j, b + j) for s, a, b in brute(x[j:]))]


def test_segments_equal_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 9, 30):
        for _ in range(60):
            x = [rng.uniform(-1, 0.9) for _ in range(n)]
            got = sorted((a, b, round(s, 9)) for s, a, b in tx.segments(np.array(x)))
            assert got == sorted((a, b, round(s, 9)) for s, a, b in brute(x))


def test_segments_take_linear_time():
    rng = np.random.default_rng(2)
    for x in (rng.normal(-0.1, 1, 400_000), np.tile([1.0, -2.0], 200_000), np.arange(400_000) % 7 - 2.9, np.ones(400_000)):
        held = tx.segments(x)
        ordered = sorted((b, e) for _, b, e in held)
        assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_extreme_value_law_is_recovered():
    rng = np.random.default_rng(3)
    size = rng.integers(20, 2000, 20_000)
    rate, k = 1.7, 0.02
    best = np.maximum((np.log(k * size) + rng.gumbel(size=len(size))) / rate, 0)
    found = tx.fit_extremes(best, size)
    assert abs(found[0] - rate) < 0.12 and abs(np.log(found[1] / k)) < 0.4
    assert tx.fit_extremes(np.zeros(5), np.full(5, 10)) == (1.0, 1 / 50)


def test_rare_words_inherit_from_their_prefix():
    found = {b"abc": (40.0, 2.0), b"abcd": (20.0, 1.0), b"abcde ": (0.0, 2.0), b"zzz": (1.0, 9.0)}
    kept, odds = tx.pruned(found, 0.1)
    look = tx.Lookup(odds)
    assert look[b"abcx"] == odds[b"abc"] > 2 and look[b"abcde"] < look[b"abcx"]
    assert look[b"unknown"] == 0.0 and b"zzz" not in kept
    q = (40 + tx.PRIOR * 0.1) / (42 + tx.PRIOR)
    assert abs(odds[b"abc"] - (tx.logit(q) - tx.logit(0.1))) < 1e-12


def test_words_that_only_one_kind_of_text_has(spark):
    """A long word of many toxic texts and no clean one: 1 less its toxic share is 0 in floating point."""
    word = b"scumbagginess"
    for counts, sign in (((2000.0, 0.0), 1), ((0.0, 2000.0), -1)):
        kept, odds = tx.pruned(dict.fromkeys(tx.chain(word), counts), 0.1)
        want = sign * sum(np.log(2003 / 3) for _ in tx.chain(word))
        assert len(kept) == 8 and abs(odds[word + b" "] - want) < 4 and np.isfinite(list(odds.values())).all()
    docs, labels = corpus(spark, 1800)
    loud = docs.join(labels, "doc_id").selectExpr("doc_id", "if(toxic = 1, concat(text, ' disgustingly ', doc_id), text) text", "score")
    shown = tx.classify(loud, labels).join(labels, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] for r in shown if r["held_out"])


def corpus(spark, n=400):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        ws = rng.choices(vocabulary, k=rng.choice([15, 60, 200]))
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(ws))
            ws[at:at] = rng.sample(["vile", "scumbag", "idiotic"], 3)
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_passages_are_found(spark):
    docs, labels = corpus(spark)
    rows = tx.classify(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 400 and all(r["predicted"] == r["toxic"] for r in rows if r["held_out"])
    assert all(0 < r["score"] < 1 for r in rows)
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    spans = tx.judged(id_text(docs), tx.train(docs, labels)).collect()
    hits = strays = 0
    for r in spans:
        bad = {i for i, w in enumerate(texts[r["id"]]) if w in ("vile", "scumbag", "idiotic")}
        inside = {i for b, e in zip(r["begins"], r["ends"]) for i in range(b, e)}
        hits += bool(bad) and bad <= inside
        strays += len(inside - bad)
        assert all(p < tx.LEVEL for p in r["p_values"])
    assert hits >= 76 and strays < 40


def test_held_out_accuracy_on_the_given_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.classify(docs, labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.98 * len(rows)


def test_odd_rows(spark):
    docs, labels = corpus(spark, 100)
    odd = spark.createDataFrame(
        [(1000, None, ""), (1000, None, ""), (1001, "", ""), (None, "vile scumbag idiotic", ""), (1002, "word1 word2 " * 100_000, "")],
        "doc_id long, text string, score string",
    )
    many = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (5, 0), (1000, None)], labels.schema))
    rows = tx.classify(docs.unionByName(odd), many).collect()
    assert len(rows) == 105
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1000]["predicted"] == by_id[1001]["predicted"] == by_id[1002]["predicted"] == 0
    assert by_id[None]["predicted"] == 1 and by_id[None]["held_out"] is None
    assert tx.classify(docs.limit(0), labels).count() == 0


def test_one_label_only(spark):
    docs, labels = corpus(spark, 20)
    for only in (labels.limit(0), labels.where("toxic = 0")):
        assert {(r["score"], r["predicted"]) for r in tx.classify(docs, only).collect()} == {(0.5, 1)}
