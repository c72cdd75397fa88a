from pyspark.sql import functions as F

from inkspect.plans import features as ft
from inkspect.sources.tables import versioned_block


def lengths(seen):
    def build(rows):
        seen.append({r.doc_id for r in rows.collect()})
        return rows.select("doc_id", F.length("text").alias("n"))

    return build


def test_only_changed_ids_are_rebuilt(spark, tmp_path):
    path, seen = str(tmp_path / "block"), []
    rows = [(i, "x" * i) for i in range(6)] + [(6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    view = lambda b: {r.doc_id: r.n for r in b.collect()}
    assert view(versioned_block(df, path, lengths(seen), "1"))[5] == 5
    assert seen == [set(range(7))]
    versioned_block(df, path, lengths(seen), "1")
    assert len(seen) == 1  # nothing changed, nothing built
    other = spark.createDataFrame([(i, "changed" if i == 3 else t) for i, t in rows if i != 2] + [(9, "new row")], df.schema)
    got = view(versioned_block(other, path, lengths(seen), "1"))
    assert seen[1:] == [{3, 9}] and set(got) == {0, 1, 3, 4, 5, 6, 9} and got[3] == got[9] == 7 and got[6] is None
    versioned_block(other, path, lengths(seen), "2")
    assert seen[2:] == [{0, 1, 3, 4, 5, 6, 9}]  # other code, all rows


def test_a_removed_row_leaves_the_block(spark, tmp_path):
    path, seen = str(tmp_path / "block"), []
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    versioned_block(df, path, lengths(seen), "1")
    assert [r.doc_id for r in versioned_block(df.where("doc_id = 1"), path, lengths(seen), "1").collect()] == [1]


def test_stored_training_blocks_equal_those_of_scoring(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 2000")
    state = ft.fit_state(docs)
    stored = ft.stored_blocks(docs, state, str(tmp_path))
    a = ft.matrix(docs, stored).select("doc_id", F.expr("aggregate(v, 0D, (a, x) -> a + x)").alias("s"))
    b = ft.matrix(docs, ft.block_frames(docs, state)).select("doc_id", F.expr("aggregate(v, 0D, (a, x) -> a + x)").alias("s"))
    left, right = ({r.doc_id: r.s for r in x.collect()} for x in (a, b))
    assert len(left) == docs.count() and all(abs(left[i] - right[i]) < 1e-6 * max(1, abs(right[i])) for i in left)


def test_parity_compares_every_feature_of_the_matrix(texts, tmp_path):
    docs = texts("One two, three. Four five six!", "two two THREE", "", None)
    state = ft.fit_state(docs)
    stored = ft.stored_blocks(docs, state, str(tmp_path))
    serving = ft.block_frames(docs, state)
    rows = ft.parity(stored, serving).collect()
    assert len({r.feature for r in rows}) == len(rows) == ft.DIMS and all(r.n >= 3 and r.n_off == 0 for r in rows)
    moved = F.transform("hashed", lambda v: v + 1)
    rows = ft.parity(stored, serving | {"hashed": serving["hashed"].withColumn("hashed", moved)}).collect()
    assert sum(r.n_off > 0 for r in rows) == 384 and all(r.n_off == r.n for r in rows if r.feature.startswith("hashed_"))
