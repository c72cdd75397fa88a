"""Incremental dedup: a new delivery of texts meets the digests of all earlier ones.

The digests are a table in buckets of their md5. A delivery is shuffled into the same buckets
and joined there, so what is stored is read in place and never shuffled again, however
large it has grown. Texts themselves are not stored; rows meet the decision on their unique id.

A delivery has a name. Its digests are added once its rows are decided; decided again (after a
lost run, say) it ignores its own digests and gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspect.operators import clean
from inkspect.session import staged

BUCKETS = 64


class Digests:
    """The stored digests: (md5, id, delivery), bucketed by md5. ``path`` lies in shared storage."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name = spark, name
        # The definition only: a table that is already there is taken up again with its rows.
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (md5 STRING, id BIGINT, delivery STRING) USING parquet "
            f"CLUSTERED BY (md5) SORTED BY (md5) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame, delivery: str) -> DataFrame:
        """The (md5, id) rows of a delivery whose text no other delivery has brought."""
        earlier = self.rows().where(F.col("delivery") != delivery)
        return digests.join(earlier.select("md5"), "md5", "left_anti")

    def admit(self, df: DataFrame, delivery: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The delivery's first row of every text that is new; their digests are stored."""
        first = clean.keep_first(df, id_col, text_col)
        digests = first.select(F.coalesce(F.md5(text_col), F.lit("")).alias("md5"), F.col(id_col).cast("long").alias("id"))
        new = staged(self.unseen(digests, delivery), "delivery")
        known = self.rows().where(F.col("delivery") == delivery).select("md5")
        fresh = new.join(known, "md5", "left_anti").select("md5", "id", F.lit(delivery).alias("delivery"))
        # Read before it is written to.
        staged(fresh, "delivery-digests").write.insertInto(self.name)
        return first.join(new.select(F.col("id").alias(id_col)), id_col, "left_semi")

    def met(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of any table whose text some delivery has brought (contamination)."""
        digests = df.select(F.coalesce(F.md5(text_col), F.lit("")).alias("md5"), F.col(id_col).alias(id_col))
        found = digests.join(self.rows().select("md5"), "md5", "left_semi").select(id_col)
        return df.join(found, id_col, "left_semi")
