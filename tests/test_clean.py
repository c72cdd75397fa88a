from pyspark.sql import functions as F

from inkspect.operators import clean
from inkspect.plans import prepare
from inkspect.sources import tables

C = chr
LONG = "one two three four five six seven eight nine ten"


def column(df, expr):
    return [r[0] for r in df.orderBy("doc_id").select(expr).collect()]


def test_repair_decodes_once_and_tidies(texts):
    df = texts(
        "&amp;lt; &quot;x&quot; &#233;",
        "e" + C(0x301),
        "a" + C(0x200B) + "b" + C(0xFEFF) + C(0xAD) + "c",
        "\ta\t\tb\r\nc   d\n\n\ne " + C(0x1C),
        C(0xA0) + " x " + C(0x2003),
        "plain",
    )
    assert column(df, clean.repair(F.col("text"))) == [
        '&lt; "x" ' + C(233), C(233), "abc", "a b \nc d\n\n\ne", "x", "plain",
    ]


def test_normalize(texts):
    df = texts(
        C(0x201C) + "x" + C(0x201D) + " " + C(0x2014) + " y" + C(0x2026),
        "a" + C(0x2003) + "b" + C(0x202E) + "c",
        "p\n\n\n\nq \t r" + C(0xA0),
        "it" + C(0x2019) + "s 1" + C(0x2013) + "2",
    )
    assert column(df, clean.normalize(F.col("text"))) == ['"x" -- y...', "abc", "p\n\nq r", "it's 1-2"]


def test_dedup_keeps_smallest_id_after_repair(texts):
    df = texts("b", LONG, LONG + " ", LONG, "b").withColumn("text", clean.repair(F.col("text")))
    assert sorted(r.doc_id for r in clean.keep_first(df).collect()) == [0, 1]


def test_clean_chain_and_funnel(spark):
    rows = [
        (1, LONG, "human"), (2, LONG + " ", "human"), (3, "too short", "ai"), (4, None, "ai"),
        (5, LONG + " eleven", "ai"), (6, LONG + " z", None), (7, "one two three four five six seven eight nine", "ai"),
    ]
    raw = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {(r.doc_id, r.label) for r in clean.clean(raw).collect()}
    assert got == {(1, 1), (5, 0)}
    funnel = {r.step: (r.rows_before, r.rows_after) for r in clean.funnel(raw).collect()}
    assert funnel == {"drop_nulls": (7, 5), "exact_dedup": (5, 4), "min_words": (4, 2), "total": (7, 2)}


def test_contamination_finds_injected_row(texts):
    a, b = texts("x", "y", "y"), texts("y", "z")
    row = clean.contamination(a, b).first()
    assert (row.unique_a, row.unique_b, row.overlap) == (2, 2, 1)
    assert [r.doc_id for r in clean.contaminated_rows(a, b).orderBy("doc_id").collect()] == [1, 2]


def test_guard(texts):
    df = texts(None, " \n", "one two three four", "one two three four five")
    assert column(df, clean.guard_reason(F.col("text"))) == ["empty", "empty", "too short", None]


def test_raw_csv_and_audited_stage(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('text,label\n"He said ""hi"",\nthen ' + LONG + '",human\n' + LONG + ",ai\nshort,ai\n")
    raw = tables.read_raw_csv(spark, str(path)).withColumn("doc_id", F.monotonically_increasing_id())
    assert raw.where(F.contains("text", F.lit('"hi",\nthen'))).count() == 1
    tables.convert_raw(spark, str(path), "text", str(tmp_path / "raw.parquet"))
    assert spark.read.parquet(str(tmp_path / "raw.parquet")).count() == 5
    stored = prepare.prepare_stage(raw, "authorship", str(tmp_path / "clean"), str(tmp_path / "audit"))
    assert stored.count() == 2
    audit = {(r.step, r.metric): r.value for r in spark.read.json(str(tmp_path / "audit")).collect()}
    assert audit["total", "rows_before"] == 3 and audit["total", "removed"] == 1
    assert audit["clean_class_0", "n"] == 1 and audit["raw_class_ai", "imbalance"] == 2
    tables.write_report(clean.funnel(raw), str(tmp_path / "funnel"))
    back = tables.read_report(
        spark, str(tmp_path / "funnel"),
        "step_no int, step string, rows_before long, rows_after long, removed long, removed_pct double",
    )
    assert back.where("step = 'total'").first().rows_after == 2


def test_block_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.block_table(spark, str(tmp_path / "b"), build).count() == 3
    assert len(calls) == 1


def test_split_table_reads_one_side(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "holdout").otherwise("train"))
    tables.write_split(df, str(tmp_path / "s"))
    assert tables.read_split(spark, str(tmp_path / "s"), "holdout").count() == 3


def test_word_moments_beyond_64_bits(spark):
    """n * sum of squares of thirty million texts of 2,000 words passes 2^63."""
    from pyspark.sql import functions as F

    from inkspect.operators import clean

    one = F.array_join(F.array_repeat(F.lit("w"), 2000), " ")
    two = F.array_join(F.array_repeat(F.lit("w"), 2002), " ")
    # Few long rows of equal counts would not overflow: check the expression on its sums.
    df = spark.range(2).select(F.when(F.col("id") == 0, one).otherwise(two).alias("text"))
    row = clean.word_count_stats(df).first()
    assert (row["mean_words"], round(row["std_words"], 6)) == (2001.0, 1.414214)
    big = 30_000_000
    sums = spark.createDataFrame([(big, 2001 * big, (2000**2 + 2002**2) // 2 * big)], "n long, s long, s2 long")
    assert big * (2000**2 + 2002**2) // 2 * big > 2**63
    std = sums.select(clean.sample_deviation(F.col("n"), F.col("s"), F.col("s2")).alias("v")).first()["v"]
    assert abs(std - (big / (big - 1)) ** 0.5) < 1e-9


def test_copies_keep_the_smallest_id(spark):
    from inkspect.operators import clean

    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in clean.keep_first(df).collect()) == [1, 2, 4]
