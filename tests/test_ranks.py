import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspect.operators import corpus, folds, ranks


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    rows = [(i, i % 3 == 0, float(rng.randint(0, 12)), rng.random() + 0.3 * (i % 3 == 0)) for i in range(400)]
    return rows, spark.createDataFrame(
        [(i, int(c), a, b) for i, c, a, b in rows], "doc_id long, label int, tied double, smooth double"
    )


def brute_u(rows, index):
    zero = [r[index] for r in rows if not r[1]]
    one = [r[index] for r in rows if r[1]]
    return sum((a > b) + 0.5 * (a == b) for a in zero for b in one), len(zero) * len(one)


def test_u_and_auc_match_pair_counting(sample):
    rows, df = sample
    long = ranks.unpivot(df, ["tied", "smooth"], "label")
    got = {r.feature: r for r in ranks.rank_sums(ranks.cumulative(ranks.value_counts(long), ranges=7)).collect()}
    scores = long.select(F.col("feature").alias("model"), F.col("value").alias("score"), "label")
    auc = {r.model: r.roc_auc for r in ranks.roc_auc(scores).collect()}
    for i, name in ((2, "tied"), (3, "smooth")):
        u, pairs = brute_u(rows, i)
        assert got[name].u_statistic == u
        assert auc[name] == pytest.approx(1 - u / pairs)
        assert got[name].z >= 0


def test_the_number_of_ranges_follows_the_rows(sample, monkeypatch):
    rows, df = sample
    vc = ranks.value_counts(ranks.unpivot(df, ["tied", "smooth"], "label"))
    found = lambda cum: sorted(map(tuple, cum.select("feature", "value", "n0", "n1", "b0", "b1").collect()))
    one = found(ranks.cumulative(vc))
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    assert ranks._ranged(vc, None).select("bucket").distinct().count() == math.ceil(vc.count() / 50)
    assert found(ranks.cumulative(vc)) == one


def test_percentiles_are_exact(sample):
    rows, df = sample
    cum = ranks.cumulative(ranks.value_counts(ranks.unpivot(df, ["tied", "smooth"], "label")), ranges=5)
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    pooled = {(r.feature, r.p): r.value for r in ranks.percentiles(cum, qs).collect()}
    split = {(r.feature, r.side, r.p): r.value for r in ranks.percentiles(cum, qs, pooled=False).collect()}
    for i, name in ((2, "tied"), (3, "smooth")):
        for q in qs:
            assert pooled[name, q] == pytest.approx(np.quantile([r[i] for r in rows], q))
            assert split[name, "1", q] == pytest.approx(np.quantile([r[i] for r in rows if r[1]], q))


def test_histogram_matches_numpy(sample):
    rows, df = sample
    got = corpus.histogram(df, ["tied", "smooth"], bins=10, per_class=True).collect()
    for i, name in ((2, "tied"), (3, "smooth")):
        for label in (0, 1):
            v = np.array([r[i] for r in rows if int(r[1]) == label])
            want, _ = np.histogram(np.clip(v, 0, np.quantile(v, 0.99)), bins=10)
            have = {r.bin: r.n for r in got if r.feature == name and r.label == label}
            assert [have.get(b, 0) for b in range(10)] == list(want)


def test_significance_p_and_stars(sample):
    _, df = sample
    got = {r.feature: r for r in corpus.significance(df, ["tied", "smooth"]).collect()}
    for r in got.values():
        assert r.p_value == pytest.approx(math.erfc(r.z / math.sqrt(2)))
    assert got["smooth"].significance in ("*", "**", "***")


def test_identical_values_are_not_significant(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (0, 1.0)], "label int, f double")
    row = corpus.significance(df, ["f"]).first()
    assert (row.z, row.p_value, row.significance) == (0.0, 1.0, "ns")


def test_folds_are_disjoint_and_balanced(sample):
    _, df = sample
    rows = folds.kfold(df, 5).collect()
    assert len({r.doc_id for r in rows}) == 400
    for label in (0, 1):
        sizes = [sum(r.fold == f and r.label == label for r in rows) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    parts = folds.holdout(df).collect()
    held = [r for r in parts if r.split == "holdout"]
    assert len(held) == sum(math.floor(0.1 * sum(r.label == c for r in parts) + 0.5) for c in (0, 1))


def test_shuffled_rank_is_a_permutation_per_group(sample):
    _, df = sample
    got = ranks.shuffled_rank(df, "label", "doc_id", 7).collect()
    for label in (0, 1):
        mine = sorted(r["rank"] for r in got if r.label == label)
        assert mine == list(range(len(mine)))
