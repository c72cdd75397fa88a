"""Helpers shared by the corpus operators: input tables, Arrow batches, row keys, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspect.session import discard, spread, staged

# Characters of text that a Python worker unpacks at a time.
CHUNK_CHARS = 2_000_000

ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text, whatever other columns the table has."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return spread(rows, "id")


def row_key(*columns: Column) -> Column:
    """Key of a row's content. Rows that repeat an id with another text keep apart."""
    return F.xxhash64(*columns)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a column as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices with about CHUNK_CHARS bytes of a string column each, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // CHUNK_CHARS
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def map_chunks(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: dict[str, str], column: str = "text") -> DataFrame:
    """Apply ``function`` to bounded slices of the rows; it returns lists by column name."""
    arrow = pa.schema([(k, ARROW[v]) for k, v in schema.items()])

    def run(batches):
        for part in text_chunks(batches, column):
            yield pa.RecordBatch.from_pydict(function(part), schema=arrow)

    return df.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in schema.items()))


def joined_small(left: DataFrame, right: DataFrame, on, how: str, n_rows: int, most: int = 1_000_000) -> DataFrame:
    """Join that broadcasts ``right`` when its counted rows are few, else shuffles both sides.

    ``right`` holds narrow rows (keys and numbers), so ``most`` rows stay below about 50 MB.
    """
    return left.join(F.broadcast(right) if n_rows <= most else right, on, how)


def shared_keys(postings: DataFrame) -> DataFrame:
    """The postings (key, ...) whose key occurs more than once.

    Only keys and counts are shuffled; ``postings`` is read twice and should be a
    row-local projection of a stored table.
    """
    often = staged(postings.groupBy("key").count().filter("count > 1").select("key"), "shared-keys")
    return joined_small(postings, often, "key", "left_semi", often.count())


def components(edges: DataFrame) -> DataFrame:
    """Connected groups of (a, b) long pairs: rows (node, component), the smallest node of each group.

    Alternating large-star and small-star steps. Each keeps at most one edge per
    old edge, so the table never grows, and ends when nothing changes. Nodes without
    an edge are not listed. Every step's edges are written to the shared folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        # pairs are (a, b) with a > b: in a small star every node has only smaller neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        moved = both.join(least.withColumn("m", F.least("a", "m")), "a")
        if large:
            moved = moved.filter(F.col("b") > F.col("a"))
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def state(table: DataFrame) -> tuple:
        return tuple(
            table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    current = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(),
        "edges",
    )
    seen = state(current)
    while seen[0]:
        current = staged(star(star(current, True), False), "edges")
        now = state(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def linked_groups(
    postings: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    may_link: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    late: DataFrame | None = None,
    may_link_late: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    band: str | None = None,
) -> DataFrame:
    """(node, component) of nodes that share a key and are confirmed to link, through other nodes or directly.

    postings: (key, node, rank, further columns); ``may_link`` drops (a, b) pairs by the further
    columns, suffixed _a and _b. Pairs of a list are not all made: each list's node of lowest
    rank is its hub, and lists with one hub become one cluster, so nodes that share many keys
    meet once. The hub is held against the cluster, then the lowest of those outside its
    group, and only members that still lie in different groups are paired with each
    other, where ``may_link_late`` may also use the columns of ``late`` (node, ...), and ``band`` names
    one of these, an integer that differs by at most one between linked nodes. A large list
    of copies so costs rows in proportion to its length, and no link that joins two groups
    is lost.
    """
    postings = staged(postings, "postings")
    extra = [c for c in postings.columns if c not in ("key", "node", "rank")]
    hub = F.struct("rank", "node", *extra)

    def tested(pairs: DataFrame) -> DataFrame:
        near = may_link(pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        near = staged(near.filter("a != b").distinct(), "pairs")
        links = staged(confirm(near).select("a", "b"), "links")
        discard(near)
        return links

    def against(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """Pairs of a list's members (b) with its hub (a)."""
        other = hubs.select("key", F.col("hub.node").alias("a"), *(F.col(f"hub.{c}").alias(f"{c}_a") for c in extra))
        own = rows.select("key", F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in extra))
        return own.join(other, "key").filter("a != b")

    def mixed(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Members of lists that lie in several groups, with the group of the list's hub."""
        rows = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spans = rows.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("rank", "node", "component")).alias("first")
        )
        return rows.join(spans.filter("low != high").select("key", F.col("first.component").alias("own")), "key")

    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(hub).alias("hub"))
    lists = staged(lists.filter("members > 1").drop("members"), "lists")
    clusters = postings.join(lists, "key").drop("key").withColumn("key", F.col("hub.node")).distinct()
    clusters = staged(clusters, "clusters")
    discard(postings, lists)
    first = clusters.select(
        F.col("hub.node").alias("a"), *(F.col(f"hub.{c}").alias(f"{c}_a") for c in extra),
        F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in extra),
    )
    links = tested(first.filter("a != b"))
    groups = staged(components(links), "groups")
    several = clusters.groupBy("key").count().filter("count > 2").select("key")
    several = clusters.select("key", "node", "rank", *extra).join(several, "key")
    outside = staged(mixed(several, groups), "outside")
    if outside.isEmpty():
        return groups
    second = outside.filter("component != own").groupBy("key").agg(F.min(hub).alias("hub"))
    more = tested(against(outside, second))
    if not more.isEmpty():
        links = links.unionByName(more)
        groups = staged(components(links), "groups")
        outside = staged(mixed(outside.select(*several.columns), groups), "outside")
    if late is not None:
        outside, extra = outside.join(late, "node"), extra + [c for c in late.columns if c != "node"]
    left = outside.select("key", F.col("node").alias("a"), F.col("component").alias("ca"), *(F.col(c).alias(f"{c}_a") for c in extra))
    right = outside.select("key", F.col("node").alias("b"), F.col("component").alias("cb"), *(F.col(c).alias(f"{c}_b") for c in extra))
    if band is None:
        rest = left.join(right, "key").filter("a < b and ca != cb")
    else:
        # Every pair once: inside a band in the order of the nodes, else from the lower band.
        near = F.explode(F.array(*(F.col(f"{band}_a") + d for d in (0, 1))))
        rest = left.withColumn("band", near).join(right.withColumn("band", F.col(f"{band}_b")), ["key", "band"])
        rest = rest.filter(f"ca != cb and ({band}_a < {band}_b or a < b)")
    rest = tested(may_link_late(rest))
    return groups if rest.isEmpty() else staged(components(links.unionByName(rest)), "groups")
