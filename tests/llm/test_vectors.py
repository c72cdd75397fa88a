import numpy as np

from inkspect.llm import vectors


def make(n_base=40, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n_base, dim))
    rows = [b for b in base]
    for i in range(120):
        rows.append(base[i % 7] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.3]))
    rows += [base[0], base[0], 2 * base[1]]
    return [list(map(float, r)) for r in rows]


def brute(rows):
    ok = [r is not None and len(r) > 0 and all(x is not None and np.isfinite(x) for x in r) and any(r) for r in rows]
    unit = [np.array(r) / np.linalg.norm(r) if o else None for r, o in zip(rows, ok, strict=True)]
    n = len(rows)
    link = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95 for j in range(n)] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        new = [min([group[i], *(group[j] for j in range(n) if link[i][j])]) for i in range(n)]
        if new == group:
            break
        group = new
    return [(i, sum(link[i]), group[i], group[i] == i) for i in range(n)]


def test_links_equal_brute_force(spark, monkeypatch):
    rows = make() + [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [1.0, 2.0], [1.0, 2.0]]
    df = spark.createDataFrame([(i, r, 5) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, n_links int")
    want = brute(rows)
    assert sorted(map(tuple, vectors.report(df).collect())) == want
    monkeypatch.setattr(vectors, "TILE", 16)  # lists of several tiles
    assert sorted(map(tuple, vectors.report(df).collect())) == want


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in vectors.report(df).collect()), key=str)
    assert got == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)], key=str)
    assert vectors.report(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    assert sorted(map(tuple, vectors.report(df).collect())) == [(rows[i]["vec_id"], n, rows[c]["vec_id"], k) for i, n, c, k in brute([r["embedding"] for r in rows])]


def test_links_of_correlated_vectors_count_on_both_sides(spark):
    """Variances 1/i in 64 dimensions: every link counts at both ends, and few are lost."""
    rng = np.random.default_rng(9)
    scale = 1 / np.sqrt(np.arange(1, 65))
    base = rng.normal(size=(1500, 64)) * scale
    near = base + 0.29 * rng.normal(size=base.shape) * scale
    rows = [list(map(float, r)) for r in np.concatenate([base, near])]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.report(df).collect()}
    want = link.sum(axis=1)
    counts = np.array([got[i] for i in range(len(rows))])
    assert (counts <= want).all() and counts.sum() % 2 == 0
    assert counts.sum() >= 0.99 * want.sum() > 0
