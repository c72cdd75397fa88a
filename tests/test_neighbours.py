import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspect.operators import neighbours, smote


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)) + 4 * (rng.random((300, 1)) > 0.7)
    v[10] = v[11]  # an exact tie
    rows = [(i, [float(x) for x in v[i]], int(i % 6 == 0)) for i in range(300)]
    return v, spark.createDataFrame(rows, "doc_id long, v array<double>, label int")


def brute(v, k):
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return {i: list(np.lexsort((np.arange(len(v)), d[i]))[:k]) for i in range(len(v))}


@pytest.mark.parametrize("limit,block", [(1 << 30, 4096), (0, 16), (0, 4096)])
def test_both_ways_are_exact(points, limit, block):
    v, df = points
    got = neighbours.nearest(df, df, 5, "doc_id", "v", True, limit, block).collect()
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault(r.qid, []).append(r.pid)
    assert have == brute(v, 5)


@pytest.mark.parametrize("block", [8, 4096])
def test_probes_find_most_neighbours(points, block):
    v, df = points
    got = neighbours.nearest(df, df, 5, "doc_id", "v", True, block_rows=block, method="probes", probes=8).collect()
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault(r.qid, []).append(r.pid)
        assert r.d2 == pytest.approx(((v[r.qid] - v[r.pid]) ** 2).sum()) and r.qid != r.pid
    want = brute(v, 5)
    assert sum(len(set(have.get(i, [])) & set(want[i])) for i in want) >= 0.9 * 5 * len(want)
    all_cells = neighbours.nearest(df, df, 5, "doc_id", "v", True, block_rows=block, method="probes", probes=17).collect()
    every = {}
    for r in sorted(all_cells, key=lambda r: r["rank"]):
        every.setdefault(r.qid, []).append(r.pid)
    assert every == want


def test_probes_of_no_points_and_unknown_method(points):
    _, df = points
    assert neighbours.nearest(df, df.limit(0), 5, "doc_id", "v", method="probes").count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(df, df, 5, "doc_id", "v", method="fast")


def test_vote(points, spark):
    v, df = points
    near = brute(v, 5)
    found = neighbours.nearest(df, df, 5, "doc_id", "v", True)
    for r in neighbours.classify(found, df, "doc_id").collect():
        ones = sum(i % 6 == 0 for i in near[r.qid])
        assert r.p1 == pytest.approx(ones / 5) and r.prediction == int(ones > 2)


def test_smote_lies_between_minority_rows_and_balances(points):
    v, df = points
    rows = smote.synthesize(df, seed=1).collect()
    assert len(rows) == 250 - 50 and {r.label for r in rows} == {1}
    own = brute(v[::6], 5)
    for r in rows:
        a, b, x = v[r.doc_id], v[r.nn_id], np.array(r.v)
        assert r.doc_id % 6 == 0 and r.nn_id // 6 in own[r.doc_id // 6]
        u = np.dot(x - a, b - a) / np.dot(b - a, b - a)
        assert 0 <= u <= 1 and np.allclose(x, a + u * (b - a))
    per = smote.balance(df).groupBy("label").count().collect()
    assert {r["count"] for r in per} == {250}
    again = smote.synthesize(df, seed=1).agg(F.sum(F.get("v", F.lit(0)))).first()[0]
    assert again == pytest.approx(sum(r.v[0] for r in rows))


@pytest.mark.parametrize("copies", [1, 40])
def test_memory_of_a_search_does_not_follow_the_points(copies, monkeypatch):
    """Peak of the search over four times the points stays; the rows are those of brute force, copies included."""
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 32)
    monkeypatch.setattr(neighbours, "TILE_POINTS", 256)
    rng = np.random.default_rng(5)
    peaks = []
    for n in (4000, 16000):
        p = np.repeat(rng.normal(size=(n // copies, 8)), copies, axis=0)
        pid = rng.permutation(n)
        tracemalloc.start()
        got = neighbours._nearest(p[:100], pid[:100], p, pid, 5, True)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        d2 = ((p[:100, None, :] - p[None, :, :]) ** 2).sum(axis=2)
        d2[np.arange(100), np.arange(100)] = np.inf
        want = {int(pid[i]): [int(x) for x in pid[np.lexsort((pid, d2[i]))[:5]]] for i in range(100)}
        assert {int(i): list(rows.pid) for i, rows in got.groupby("qid")} == want
    assert peaks[1] < 1.5 * peaks[0] + 500_000


def test_rows_that_repeat_an_id_are_no_neighbours_of_it():
    p = np.array([[0.0], [0.0], [1.0], [2.0], [2.0], [5.0]])
    pid = np.array([7, 7, 1, 2, 3, 4])
    got = neighbours._nearest(p[:1], pid[:1], p, pid, 3, True)
    assert list(got.pid) == [1, 2, 3]  # 2 and 3 tie for the last place among the four nearest


@pytest.mark.parametrize("groups", [1, 3])
def test_groups_of_cells_are_exact(points, monkeypatch, groups):
    v, df = points
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 300 // groups * 7 * 8)
    got = neighbours.nearest(df, df, 5, "doc_id", "v", True, 0, 1).collect()
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault(r.qid, []).append(r.pid)
    assert have == brute(v, 5)


def test_rows_move_by_groups_of_cells_not_by_cells(spark):
    """Small blocks are moved together: a query goes once to a group, not to each of 64 cells of it."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(2000, 16)))]
    df = spark.createDataFrame(rows, "pid long, v array<double>")
    q = df.withColumnRenamed("pid", "qid")
    for most, groups in ((2000, 1), (1000, 4)):
        points, queries = neighbours._in_groups(q, df, 5, True, most)
        assert queries.groupBy("qid").count().agg(F.max("count")).first()[0] <= groups
        parts = points.select("part").distinct().count()
        assert points.count() == 2000 * parts and parts <= max(8, 2000 // most)
        assert points.groupBy("group", "part").count().agg(F.max("count")).first()[0] <= most


def test_cells_are_packed_and_large_ones_spread():
    assert neighbours._packed([4, 5, 2, 25, 1, 9], 10) == ([(0, 1), (0, 1), (1, 1), (2, 3), (5, 1), (5, 1)], 6)
