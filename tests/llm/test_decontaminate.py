import random

from inkspect.llm import decontaminate as dc


def test_suffix_array_is_sorted():
    import numpy as np

    rng = random.Random(3)
    s = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(200)] + [0])
    order = dc.suffix_array(s)
    assert sorted(order.tolist()) == list(range(len(s)))

    def run(i):  # up to the separator
        out = []
        while s[i]:
            out.append(int(s[i]))
            i += 1
        return out

    runs = [run(i) for i in order]
    assert runs == sorted(runs)


def brute(text, items, window=10):
    words = dc.words(text)
    hit, names, longest = set(), set(), 0
    for name, item in items:
        ws = dc.words(item)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == ws[i : i + n]:
                    hit |= set(range(p, p + n))
                    names.add(str(name))
                    m = n
                    while p + m < len(words) and i + m < len(ws) and words[p + m] == ws[i + m]:
                        m += 1
                    longest = max(longest, m)
    return len(words), len(hit), sorted(names), longest


def case():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([12, 25, 40]))) for i in range(8)] + [(20, "Short item here"), (21, None), (22, ""), (None, "w1 w2"), (3, text(15))]
    docs = []
    for d in range(25):
        parts = [text(rng.choice([3, 30, 80]))]
        if d % 2:
            parts.append(" ".join(items[d % 8][1].split()[: rng.choice([9, 10, 12])]))
        if d % 5 == 0:
            parts.append("SHORT, item-here")
        parts.append(text(5))
        docs.append((d, " ".join(parts)))
    return docs + [(30, None), (31, ""), (None, "short item here"), (0, docs[0][1])], items


def test_report_equals_brute_force(spark):
    docs, items = case()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    named = [(n, t) for n, t in items if n is not None]
    want = [brute(t, named) for _, t in docs]
    for most in (10**6, 30):  # one block, several blocks
        rows = dc.marked(frame, frame["text"], bench, most=most).select("doc_id", "found.*").collect()
        got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), r["items"], r["longest"]) for r in rows)
        assert got == sorted((d is None, d, *w) for (d, _), w in zip(docs, want, strict=True))
    flags = dc.report(frame, bench).collect()
    assert sum(r["contaminated"] for r in flags) == sum(w[1] > 0 for w in want)
    clean = dc.clean(frame.selectExpr("*", "1 as found", "2 as doc"), bench)
    assert clean.columns == ["doc_id", "text", "found", "doc"]
    assert clean.count() == sum(w[1] == 0 for w in want)


def test_without_items_and_without_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["contaminated"]) for r in dc.report(docs, none).orderBy("doc_id").collect()] == [(2, False), (0, False)]
    assert dc.report(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
