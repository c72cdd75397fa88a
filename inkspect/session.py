"""Session settings and shared-storage staging."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "inkspect") -> SparkSession:
    """Session for tests and the benchmark; a cluster supplies its own."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_fallback_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local master may go without the setting and gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder would
    lose data together with its executor.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="inkspect-")
    return _fallback_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what ``staged`` writes inside the scope when it ends; results must be written by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(conf).delete(found, True)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to shared storage once and continue from the stored table.

    Cuts the lineage, so branches that read the result see identical rows even
    if an executor is lost, and keeps column pruning, which ``checkpoint`` drops.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for paths in _scopes:
        paths.append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` wrote, once all that is derived from them is stored itself."""
    for table in tables:
        _delete(table.sparkSession, [table._scratch])


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, used before choosing a strategy."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small input as many partitions as there are cores.

    A table larger than one scan split per core already has enough partitions
    and is returned untouched, so nothing is shuffled at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB")
    if plan_bytes(df) >= cores * _to_bytes(split):
        return df
    return df.repartition(cores, key)


def _to_bytes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = text.strip().lower().rstrip("b")
    return int(digits[:-1]) * units[digits[-1]] if digits[-1] in units else int(digits)
