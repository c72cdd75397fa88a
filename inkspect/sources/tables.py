"""Schemas, readers and writers for the tables the stages exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspect.session import spread

RAW = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

# Label ids and their names in one place. Strings sort alphabetically, so the
# authorship stage has 0 = ai, 1 = human and the intent stage 0 = safe, 1 = unsafe.
LABEL_NAMES = {
    "authorship": {0: "ai", 1: "human"},
    "intent": {0: "safe", 1: "unsafe"},
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """Raw labelled table; quoted fields may span lines and double their quotes."""
    return spark.read.csv(
        path, schema=schema, header=True, multiLine=True, quote='"', escape='"'
    )


def convert_raw(
    spark: SparkSession, source: str, fmt: str, target: str, split: str | None = None
) -> None:
    """Store one split of a raw dataset as parquet.

    ``split`` filters on a ``split`` column, which prunes folders when the
    dataset is partitioned by it.
    """
    df = spark.read.format(fmt).load(source)
    if split is not None:
        df = df.where(F.col("split") == split).drop("split")
    df.write.mode("overwrite").parquet(target)


def write_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "text", "label")


def write_split(df: DataFrame, path: str) -> None:
    """Feature matrix partitioned by its ``split`` column, so each side reads alone."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_report(df: DataFrame, path: str) -> None:
    """Result table as CSV with a header; result tables are a few rows."""
    df.write.mode("overwrite").csv(path, header=True)


def append_metrics(df: DataFrame, path: str) -> None:
    """Add one model's metric rows, so a failed run keeps the finished models."""
    df.write.mode("append").parquet(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_audit(df: DataFrame, path: str) -> None:
    """Audit rows (stage, step, metric, value) as JSON lines."""
    df.write.mode("append").json(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a stored table finished writing."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def block_table(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a stored block, or build and store it first when it is not complete."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def versioned_block(
    df: DataFrame, path: str, build, version: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A stored block that follows its input: only ids whose text or version changed are built anew.

    Every row keeps the digest of the text and the version it was built from. ``version`` names
    the code and whatever else decides the values, such as a fitted state. A change is written
    beside the old table and then entered in the manifest, so readers see one or the other.
    Ids are unique; ids that are gone from ``df`` leave the block.
    """
    spark, manifest = df.sparkSession, f"{path}/manifest"
    marks = df.select(F.col(id_col), F.coalesce(F.md5(text_col), F.lit("")).alias("_digest"))
    kept, stale, held = None, df, 0
    if is_complete(spark, manifest):
        folder = spark.read.parquet(manifest).orderBy(F.desc("number")).first()
        stored, held = spark.read.parquet(folder["path"]), folder["number"]
        kept = stored.where(F.col("_version") == version).join(marks, [id_col, "_digest"], "left_semi")
        stale = df.join(kept.select(id_col), id_col, "left_anti")
        if stale.isEmpty() and kept.count() == stored.count():
            return stored.drop("_digest", "_version")
    fresh = build(stale).join(marks, id_col).withColumn("_version", F.lit(version))
    whole = fresh if kept is None else kept.select(*fresh.columns).unionByName(fresh)
    target = f"{path}/{uuid.uuid4().hex}"
    whole.write.parquet(target)
    entry = [(held + 1, target, version)]
    spark.createDataFrame(entry, "number long, path string, version string").write.mode("append").parquet(manifest)
    return spark.read.parquet(target).drop("_digest", "_version")


def labelled(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """Documents with one of the label columns as ``label``.

    The label side holds three numbers per row; Spark broadcasts it when its
    measured size allows and sorts both sides on the unique ``doc_id`` otherwise.
    """
    marks = table(spark, folder, "labels").select("doc_id", F.col(label).alias("label"))
    texts = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return texts.join(marks, "doc_id")
