import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from inkspect.llm import lm, quality, tokencount


def test_token_counts_equal_plain_dynamic_programming(spark):
    scores, byte = tokencount.pieces()
    width = max(map(len, scores))

    def best(word):
        word = tokencount.MARK + word
        at = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            options = [(at[d - k][0] + scores[word[d - k : d]], at[d - k][1] - 1) for k in range(1, min(d, width) + 1) if word[d - k : d] in scores]
            if word[d - 1] not in scores:
                n = len(word[d - 1].encode())
                options.append((at[d - 1][0] + n * byte, at[d - 1][1] - n))
            at.append(max(options))
        return -at[-1][1]

    texts = ["the quick brown fox", "thequick thequirk the", "ünïcödé 漢字 \U0001f600", "a" * 500, "", None, " \n ", "the the"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, "x", 0)], "doc_id long, text string, n_words int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in tokencount.count(df).collect())
    want = [(False, i, len((t or "").split()), sum(map(best, (t or "").split()))) for i, t in enumerate(texts)]
    want += [want[0], (True, 0, 1, best("x"))]
    assert got == sorted(want)
    assert tokencount.count(df.limit(0)).count() == 0


def _vocabulary(seen=300, seed=0):
    n = np.zeros(lm.IDS)
    n[np.random.default_rng(seed).choice(lm.IDS, seen, replace=False)] = np.arange(1, seen + 1)
    return lm.vocabulary(n)


def _network(v, seed=0):
    """Weights in double precision, none of them zero."""
    rng = np.random.default_rng(seed)
    return {k: w + rng.normal(0, 0.1, w.shape) for k, w in lm.fresh(v).items()}


def _plain_log_p(net, v, window, rank):
    """Log p(rank | window), by loops over positions, classes and places."""
    softmax = lambda z: [math.exp(i - max(z)) / sum(math.exp(j - max(z)) for j in z) for i in z]
    x = [net["embed"][r] + net["place"][i] for i, r in enumerate(window)]
    q = x[-1] @ net["query"]
    weight = softmax([float(q @ (y @ net["key"])) / math.sqrt(lm.DIM) for y in x])
    m = sum(w * (y @ net["value"]) for w, y in zip(weight, x, strict=True))
    y = x[-1] + m @ net["mix"]
    h = y + sum(max(float(y @ net["up"][j]), 0.0) * net["down"][j] for j in range(lm.HIDDEN))
    top = softmax([float(h @ w) + float(p) for w, p in zip(net["top"], v.class_prior, strict=True)])
    if rank < v.alone:
        return math.log(top[rank])
    if rank == v.seen:
        return math.log(top[-1]) - math.log(lm.IDS - v.seen)
    g, place = divmod(rank - v.alone, v.size)
    inside = softmax([float(h @ net["leaf"][g * v.size + i]) + float(v.leaf_prior[g, i]) for i in range(v.size)])
    return math.log(top[v.alone + g]) + math.log(inside[place])


def test_text_scores_equal_plain_loops():
    v = _vocabulary()
    net = _network(v)
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, v.seen + 1, n) for n in (1, 5, 32, 33, 75)]
    got = lm.text_scores(net, v, texts)
    for s, have in zip(texts, got, strict=True):
        path, want = [v.seen + 1, *s.tolist()], 0.0
        for i, rank in enumerate(s.tolist()):
            # The window that scores position i starts at a multiple of STRIDE.
            start = 0 if i < lm.WINDOW else -(-(i + 1 - lm.WINDOW) // lm.STRIDE) * lm.STRIDE
            want += _plain_log_p(net, v, path[start : i + 1], rank)
        assert abs(have - want) < 1e-3


def test_vocabularies_of_every_size():
    for seen in (0, 1, lm.ALONE, lm.ALONE + 1, 5000, lm.IDS):
        v = _vocabulary(seen)
        net = lm.fresh(v)
        ranks = np.unique(v.rank)
        assert abs(np.exp(v.class_prior).sum() - 1) < 1e-4 and v.groups * v.size >= seen - v.alone
        # Before training the probabilities are the priors, and they add up to one over all ids.
        p = np.exp(lm.text_scores(net, v, [np.array([r]) for r in ranks]))
        many = np.array([(lm.IDS - seen) if r == v.seen else 1 for r in ranks])
        assert abs((p * many).sum() - 1) < (1e-3 if seen < lm.IDS else 0.01)


def test_attention_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    v = _vocabulary()
    net = _network(v, 3)
    c = rng.integers(0, v.seen + 2, (2, lm.WINDOW))
    target = rng.integers(0, v.seen + 1, (2, lm.WINDOW))
    known = rng.random((2, lm.WINDOW)) < 0.8
    _, whole, tables = lm.gradients(net, v, c, target, known)
    for name, (rows, d) in tables.items():
        whole[name] = np.zeros_like(net[name])
        whole[name][rows] = d
    for name in (*lm.DENSE, *lm.TABLES):
        for row in rng.choice(np.flatnonzero(np.abs(whole[name]).sum(axis=1)), 5):
            at, values = (row, rng.integers(0, lm.DIM)), []
            for sign in (1, -1):
                moved = {k: w.copy() for k, w in net.items()}
                moved[name][at] += sign * 1e-5
                values.append(lm.gradients(moved, v, c, target, known)[0])
            assert abs((values[0] - values[1]) / 2e-5 - whole[name][at]) < 1e-5


def test_each_token_is_scored_once_and_never_sees_its_future():
    v = _vocabulary()
    net = _network(v, 5)
    rng = np.random.default_rng(1)
    for n in (1, 8, 31, 32, 33, 57, 200):
        s = rng.integers(0, v.seen + 1, n)
        windows, begin = lm._cut(np.append(v.seen + 1, s))
        scored = [t for w, b in zip(windows, begin) for t in w[1 + b :] if t >= 0]
        assert scored == s.tolist()
    s = rng.integers(0, v.seen + 1, 40)
    other = np.append(s[:30], rng.integers(0, v.seen + 1, 10))
    total = [lm.text_scores(net, v, [x[:k] for k in (25, 30)]) for x in (s, other)]
    assert np.allclose(total[0], total[1])
    # Probabilities of all continuations add up to one.
    ways = lm.text_scores(net, v, [np.append(s[:5], k) for k in range(v.seen + 1)])
    many = np.append(np.ones(v.seen), lm.IDS - v.seen)
    assert abs((np.exp(ways - lm.text_scores(net, v, [s[:5]])[0]) * many).sum() - 1) < 1e-4


def test_network_learns_from_the_last_row_and_every_id(spark):
    """One partition with far more ids than a worker holds at a time: its last row changes the network."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=30_000))) for i in range(30)]
    n = np.zeros(lm.IDS)
    for c in "abcdefghxy":
        n[lm.encoder()(" " + c)] = 5
    n[lm.END] = 5
    v = lm.vocabulary(n)
    last = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % lm.FOLDS != lm.HELD_OUT)
    nets = []
    for word in "xy":
        docs = spark.createDataFrame([*rows, (last, f"{word} " * 500)], "id long, text string").coalesce(1)
        nets.append(lm.fit(lm.prepared(docs), v))
    assert any(not np.array_equal(nets[0][k], nets[1][k]) for k in nets[0])
    assert all(np.isfinite(w).all() for w in nets[0].values())
    for n in (1, 31, 32, 33, 200):
        s = rng.choices(range(v.seen), k=n)
        windows = lm._targets(np.array([v.seen + 1, *s]))
        assert [t for w in windows for t in w[1:] if t >= 0] == s


def test_held_out_texts_are_predicted_from_their_context(spark):
    """Words follow each other by a rule, which no count of single words knows."""
    rng = random.Random(2)
    names = [a + b for a in "bdfgklmnprst" for b in ("ra", "lo", "mi", "du", "ne")]
    rule = {w: rng.sample(names, 3) for w in names}

    def text():
        words = [rng.choice(names)]
        while len(words) < 300:
            words.append(rng.choice(rule[words[-1]]))
        return " ".join(words)

    rows = lm.score(spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string").coalesce(1)).collect()
    held = [r for r in rows if r["held_out"]]
    per = [sum(r[k] for r in held) / sum(r["n_tokens"] for r in held) for k in ("score", "base_score")]
    # The rule leaves log10(3) = 0.48 of what a word has by itself, which is up to log10(60) = 1.78.
    print(per)
    assert per[0] > per[1] + 0.5


def test_base_scores_equal_counting(spark):
    rng = random.Random(0)
    texts = {i: " ".join(rng.choice("Aa b c d e f".split()) for _ in range(rng.choice([1, 5, 60]))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "never seen"}
    df = spark.createDataFrame([(d, t, 1.0) for d, t in texts.items()], "doc_id long, text string, score double")
    words = {d: (t or "").lower().split() + [None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = lm.score(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-9
        assert r["score"] < 0
    assert lm.score(df.limit(0)).count() == 0


def test_rare_words_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a a b c{i}") for i in range(30)], "doc_id long, text string")
    want = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 9)) for r in lm.score(df).collect())
    monkeypatch.setattr(lm, "COMMON", 1)
    assert sorted((r["doc_id"], r["n_known"], round(r["base_score"], 9)) for r in lm.score(df).collect()) == want


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "good words here", "x"), (2, "a" * 300_000, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.classify(docs, none).collect()
    assert [(r["score"], r["predicted"]) for r in rows] == [(0.5, 1)] * 4
    assert quality.accepted(docs, none).columns == ["doc_id", "text", "score"]
    assert quality.classify(docs.limit(0), none).count() == 0


def test_quality_fit_holds_few_pairs_at_a_time():
    rng = np.random.default_rng(3)
    raw, label = rng.random((4_000, quality.N_FEATURES)), np.arange(4_000) % 4 > 0
    raw[label] += 0.2
    tracemalloc.start()
    model = quality.fit(raw, label.astype(int))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = quality._design(raw, model["mean"], model["scale"])
    assert np.mean((x @ model["w"] >= model["threshold"]) == label) > 0.9
    assert peak < 20e6  # the differences of all 24,000 pairs are 13 MB, held three times over
