import random

import pytest

from inkspect.operators import clean, sketches
from inkspect.operators.deliveries import Digests


@pytest.fixture
def store(spark, tmp_path):
    name = f"digests_{random.getrandbits(40)}"
    yield Digests(spark, name, str(tmp_path / "digests"), buckets=4)
    spark.sql(f"DROP TABLE {name}")


def parts(spark):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(60)}" if i % 17 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, [df.where("doc_id < 90"), df.where("doc_id >= 90 AND doc_id < 150"), df.where("doc_id >= 150")]


def test_deliveries_equal_one_clean_over_all(spark, store):
    df, deliveries = parts(spark)
    kept = [r.doc_id for i, d in enumerate(deliveries) for r in store.admit(d, f"d{i}").collect()]
    assert sorted(kept) == sorted(r.doc_id for r in clean.keep_first(df).collect())
    assert store.rows().count() == len(kept)


def test_a_delivery_decided_again_gives_the_same_rows(spark, store):
    _, deliveries = parts(spark)
    store.admit(deliveries[0], "d0")
    once = sorted(tuple(r) for r in store.admit(deliveries[1], "d1").collect())
    size = store.rows().count()
    assert sorted(tuple(r) for r in store.admit(deliveries[1], "d1").collect()) == once
    assert store.rows().count() == size


def test_contamination_against_all_deliveries(spark, store):
    df, deliveries = parts(spark)
    store.admit(deliveries[0], "d0")
    have = {r.text for r in deliveries[0].collect() if r.text}
    assert {r.doc_id for r in store.met(df.where("text IS NOT NULL")).collect()} == {r.doc_id for r in df.collect() if r.text in have}


def test_the_stored_side_is_not_shuffled(spark, store):
    _, deliveries = parts(spark)
    store.admit(deliveries[0], "d0")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        digests = deliveries[1].selectExpr("md5(text) AS md5", "doc_id AS id")
        plan = store.unseen(digests, "d1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan.index("SortMergeJoin")
    stored = plan.index("FileScan parquet", plan.index("Bucketed: true") - 400)
    exchanges = [i for i in range(len(plan)) if plan.startswith("Exchange hashpartitioning", i)]
    assert len(exchanges) == 1 and join < exchanges[0] < stored
    assert "Exchange" not in plan[stored:]


def test_merged_sketches_keep_their_rank_error(spark):
    rng = random.Random(2)
    rows = [(i % 7, "f", rng.gauss(0, 1)) for i in range(30_000)] + [(i % 3, "g", float(i % 10)) for i in range(900)] + [(1, "g", None)]
    long = spark.createDataFrame(rows, "part int, feature string, value double")
    stored = sketches.per_slice(long, "part")
    assert stored.count() == 10
    whole = sketches.merged(stored)
    found = sketches.quantiles(whole, [0.01, 0.25, 0.5, 0.75, 0.99])
    errors = sketches.rank_errors(found, long.where("value IS NOT NULL")).collect()
    assert len(errors) == 10 and all(r.error <= sketches.ERROR for r in errors)
    assert {(r.feature, r.n) for r in whole.collect()} == {("f", 30_000), ("g", 900)}
