import datetime as dt

import pytest

from inkspect.plans import scoring
from inkspect.streaming import keyed

START = dt.datetime(2024, 1, 1)
SHAPE = "doc_id long, text string, at timestamp"
BATCHES = [
    [(1, "one b", 0), (1, "one a", 0), (2, "two", 1), (None, "no id", 1)],
    [(1, "one again", 5), (3, "three", 40), (2, "two later", 3)],
    [(4, "late", 2), (5, "five", 41), (3, "three later", 45), (3, "three earlier", 39)],
]


@pytest.mark.parametrize("keep", ["first", "last"])
def test_batches_with_a_restart_equal_the_batch_result(spark, tmp_path, keep):
    """A repeated id, one row behind the watermark, and a restart before the third batch."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source)
        rows = keyed.one_per_id(stream, "at", "10 minutes", keep)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, batch in enumerate(BATCHES):
            rows = [(d, t, START + dt.timedelta(minutes=m)) for d, t, m in batch]
            spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(source)
            if i:
                run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    minutes = lambda r: round((r["at"] - START).total_seconds() / 60)
    sent = sorted((r["doc_id"], r["text"], minutes(r)) for r in spark.read.parquet(out).collect())
    ids = {1, 2, 3, 5}
    every = [(d, t, m) for b in BATCHES for d, t, m in b if d in ids]
    if keep == "first":
        # The order of arrival counts; in a batch time and then digest.
        assert len(sent) == len(ids) and {d for d, _, _ in sent} == ids
        assert {(d, m) for d, _, m in sent} == {(1, 0), (2, 1), (3, 40), (5, 41)}
    else:
        latest = {d: max((r for r in sent if r[0] == d), key=lambda r: r[2]) for d in ids}
        assert {d: r[2] for d, r in latest.items()} == {d: max(m for e, _, m in every if e == d) for d in ids}
    assert all(d != 4 for d, _, _ in sent)


def test_unknown_way_to_keep(spark):
    with pytest.raises(ValueError):
        keyed.one_per_id(spark.createDataFrame([], SHAPE), "at", "1 minute", keep="any")


def test_one_text_per_id_in_a_stated_order(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, None), (2, "x"), (None, "y")]
    for order in (rows, rows[::-1]):
        got = scoring.one_per_id(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert {r["doc_id"]: r["text"] for r in got} == {1: "a", 2: None, None: "y"}
