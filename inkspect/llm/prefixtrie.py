"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

A turn is the 16-byte digest of its role and text, a conversation the digests in a row,
so two conversations share a node of depth d when their keys share 16 * d bytes. The
keys are sorted over range partitions and each task works through blocks of bounded size:
the edge between two neighbours carries the length of their longest common prefix (LCP),
and a union-find takes the edges deepest first. Every merge of two components creates a
branching node, or hangs one component below the other's; so the forest of a block grows
bottom-up in one pass.

Only nodes on the path of a block's first or last key can go on in another block. A block
hands these on, contracted to one row each with the sums of everything below; the others
are finished. Neighbouring blocks are joined on the digests of these paths, which gives the
LCP at each boundary; sums that both sides counted are corrected by it, and rows of
the same node are added up. No conversation, list of members or forest passes through the
driver, which holds one number per partition.

The hash of a node's ending conversations is a hash over an ordered list and so serial. A
block hashes the lists of its finished nodes; lists that may cross blocks travel as chunks
of ``CHUNK`` ids and one task reads the chunks of a node as a stream.

Defined cases: null roles and texts are empty; null turns come first; turns of one
conversation with equal numbers (repeated rows, too) follow in the order of their digests and all
count; rows with a null conv_id belong to no conversation and are left out; an empty table
has no node. A conversation is held as one value of 16 bytes per turn. Columns besides the
four that are read are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspect.llm.common import joined_small
from inkspect.session import spread, staged

HEADS = 100  # every conversation c takes its first turns from c - c % HEADS
HEAD_TURNS = 6  # ... fewer than this many
WIDTH = 16
BLOCK_KEYS = 100_000
BLOCK_BYTES = 16_000_000
CHUNK = 256
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = {
    "kind": "int", "block": "bigint", "depth": "int", "digest": "binary", "parent": "binary", "conv_id": "bigint",
    "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint",
    "ends": "string", "first": "boolean", "last": "boolean", "cum": "bigint",
}
CLOSED, OPEN, ENDS = 0, 1, 2
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(k, _ARROW[v]) for k, v in NODE.items()])


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv, turns): the turns of each conversation in order, as (number, digest, code points)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    rows = spread(rows.where("conv IS NOT NULL"), "conv")
    turns = rows.select(
        "conv", F.struct("turn", turn_digest(F.col("role"), F.col("text")).alias("t"), F.length("text").alias("n")).alias("turn")
    )
    # Structs are ordered field by field, nulls first.
    return turns.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, key, sizes): every conversation after its first turns are taken from its head conversation."""
    own = staged(sequences(conversations), "conversations")
    heads = own.where(F.col("conv") % HEADS == 0).select(
        F.col("conv").alias("head"), F.slice("turns", 1, HEAD_TURNS - 1).alias("first")
    )
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_TURNS).cast("int")
    rows = own.withColumn("head", F.col("conv") - F.col("conv") % HEADS).join(heads, "head", "left").withColumn("h", h)
    taken = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    kept = F.slice("turns", F.col("h") + 1, F.size("turns"))
    rows = rows.select("conv", F.concat(taken, kept).alias("turns"))
    return rows.select("conv", F.unhex(F.array_join("turns.t", "")).alias("key"), F.col("turns.n").alias("sizes"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low // WIDTH


class Forest:
    """Compressed trie of sorted keys: union-find over the LCP edges, deepest first."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.depth = [len(k) // WIDTH for k in keys]
        self.lcp = [common_turns(a, b) for a, b in zip(keys, keys[1:])]
        self.node_of = list(range(n))  # the node at which a key ends
        self.up = [-1] * n
        self.low, self.high = list(range(n)), list(range(n))
        boss, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while boss[i] != i:
                boss[i] = boss[boss[i]]
                i = boss[i]
            return i

        # Stable: among equal depths from left to right, so the right side has no node at that depth yet.
        for i in sorted(range(n - 1), key=self.lcp.__getitem__, reverse=True):
            edge, a, b = self.lcp[i], find(i), find(i + 1)
            ta, tb = top[a], top[b]
            if self.depth[ta] != edge:
                ta = self._branch(edge, ta)
            if self.depth[tb] == edge:  # an equal key, so far alone: it ends at the same node
                self.node_of[i + 1] = ta
            else:
                self.up[tb] = ta
            self.high[ta] = self.high[tb]
            boss[b], top[a] = a, ta
        last = top[find(0)]
        self.root = last if self.depth[last] == 0 else self._branch(0, last)

    def _branch(self, depth: int, child: int) -> int:
        self.depth.append(depth)
        self.low.append(self.low[child])
        self.high.append(self.high[child])
        self.up.append(-1)
        self.up[child] = len(self.up) - 1
        return len(self.up) - 1


def path_digests(key: bytes) -> list[bytes]:
    """Digest of every prefix of a key, from the root on."""
    h = hashlib.md5()
    out = [h.digest()]
    for i in range(0, len(key), WIDTH):
        h.update(key[i : i + WIDTH])
        out.append(h.digest())
    return out


def block_rows(block: int, keys: list[bytes], convs: list[int], sizes: list[list[int]]) -> list[tuple]:
    """Finished nodes, contracted boundary nodes and chunks of ends of one block of sorted keys."""
    n = len(keys)
    forest = Forest(keys)
    merged = [forest.node_of[i] != i for i in range(n)] + [False] * (len(forest.up) - n)
    cums = [np.concatenate(([0], np.cumsum(s, dtype=np.int64))) if s else np.zeros(1, np.int64) for s in sizes]
    # A key whose right neighbour does not go on from it is the last of a leaf of the trie.
    leaf = [0] * (n + 1)
    for i in range(n):
        leaf[i + 1] = leaf[i] + (i == n - 1 or forest.lcp[i] < len(keys[i]) // WIDTH)
    nodes = sorted((v for v in range(len(forest.up)) if not merged[v]), key=forest.depth.__getitem__, reverse=True)
    members = {v: forest.high[v] - forest.low[v] + 1 for v in nodes}
    below, children = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    ends: dict[int, list[int]] = {}
    for i in range(n):
        ends.setdefault(forest.node_of[i], []).append(convs[i])
    least = {v: ids[0] for v, ids in ends.items()}
    for v in nodes:  # children are deeper and come first
        u = forest.up[v]
        if u >= 0:
            cum = cums[forest.low[v]]
            chain = int(cum[forest.depth[v]] - cum[forest.depth[u]])
            below[u] += below[v] + (members[v] - 1) * chain
            children[u] += 1
            least[u] = min(least[v], least.get(u, least[v]))
    first_path, last_path = path_digests(keys[0]), path_digests(keys[-1])
    out = []
    for v in nodes:
        u, deep, low, high = forest.up[v], forest.depth[v], forest.low[v], forest.high[v]
        top = forest.depth[u] + 1 if u >= 0 else 0
        first, last = low == 0, high == n - 1
        digests = first_path if first else last_path
        over = u >= 0 and (forest.low[u] == 0 or forest.high[u] == n - 1)
        cum = cums[low]
        for d in range(top, deep + 1):
            at_end = d == deep
            saved = below[v] + (members[v] - 1) * int(cum[deep] - (cum[d - 1] if d else 0))
            shared = (d, least[v], members[v], children[v] if at_end else 1, leaf[high + 1] - leaf[low], saved)
            mine = ends.get(v, []) if at_end else []
            if first or last:
                parent = digests[d - 1] if d else None
                out.append(_row(OPEN, block, shared, digests[d], parent, None, None, first, last, int(cum[d])))
                for i in range(0, len(mine), CHUNK):
                    text = ",".join(map(str, mine[i : i + CHUNK]))
                    out.append(_row(ENDS, block, (d, mine[i], 0, 0, 0, 0), digests[d], None, None, text, first, last, i))
            else:
                text = hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest() if mine else EMPTY
                if d > top:
                    parent, known = None, least[v]
                elif over:
                    parent, known = (first_path if forest.low[u] == 0 else last_path)[d - 1], None
                else:
                    parent, known = None, least[u]
                out.append(_row(CLOSED, block, shared, None, parent, known, text, False, False, 0))
    return out


def _row(kind, block, shared, digest, parent, parent_conv, ends, first, last, cum) -> tuple:
    depth, conv, members, children, leaves, saved = shared
    return kind, block, depth, digest, parent, conv, parent_conv, members, children, leaves, saved, ends, first, last, cum


def _blocks(batches: Iterator[pa.RecordBatch], most_keys: int, most_bytes: int) -> Iterator[tuple[list, list, list]]:
    keys, convs, sizes, held = [], [], [], 0
    for batch in batches:
        for conv, key, size in zip(*(batch.column(c).to_pylist() for c in ("conv", "key", "sizes")), strict=True):
            if keys and (len(keys) >= most_keys or held > most_bytes):
                yield keys, convs, sizes
                keys, convs, sizes, held = [], [], [], 0
            keys.append(key)
            convs.append(conv)
            sizes.append(size)
            held += len(key)
    if keys:
        yield keys, convs, sizes


def forests(rows: DataFrame, most_keys: int = BLOCK_KEYS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The forest of every block of the sorted keys, as rows of ``NODE``."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, (keys, convs, sizes) in enumerate(_blocks(batches, most_keys, most_bytes)):
            found = block_rows((task << 32) + number, keys, convs, sizes)
            for i in range(0, len(found), 10_000):
                columns = zip(*found[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA)

    ordered = rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    return ordered.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in NODE.items()))


def boundaries(open_rows: DataFrame) -> DataFrame:
    """(block, before, before_cum, after): common turns with the block before and after, -1 where there is none."""
    blocks = open_rows.where("depth = 0").select("block", F.shiftright("block", 32).alias("task"))
    # One number per partition: which partition with rows comes next.
    tasks = blocks.groupBy("task").agg(F.max("block").alias("final"))
    following = F.lead("task").over(Window.orderBy("task"))
    tasks = tasks.select("task", "final", F.shiftleft(following, 32).alias("jump"))
    after = blocks.join(F.broadcast(tasks), "task").select(
        "block", F.when(F.col("block") == F.col("final"), F.col("jump")).otherwise(F.col("block") + 1).alias("next")
    )
    left = open_rows.where("last").select("block", "depth", "digest").join(after.where("next IS NOT NULL"), "block")
    right = open_rows.where("first").select(F.col("block").alias("next"), "depth", "digest", "cum")
    met = left.join(right, ["next", "depth", "digest"]).groupBy("block", "next").agg(F.max(F.struct("depth", "cum")).alias("m"))
    met = staged(met.select("block", "next", "m.depth", "m.cum"), "trie-boundaries")
    before = met.select(F.col("next").alias("block"), F.col("depth").alias("before"), F.col("cum").alias("before_cum"))
    out = blocks.select("block").join(before, "block", "left").join(met.select("block", F.col("depth").alias("after")), "block", "left")
    return out.select(
        "block", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("before_cum", F.lit(0)).alias("before_cum"),
        F.coalesce("after", F.lit(-1)).alias("after"),
    )


def hashed_ends(chunks: DataFrame) -> DataFrame:
    """(digest, ends): the hash over all chunks of a node, read as a stream in the order of the keys."""
    schema = pa.schema([("digest", pa.binary()), ("ends", pa.string())])

    def run(batches):
        current, h = None, None
        for batch in batches:
            done = []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if digest == current:
                    h.update(b"," + text.encode())
                    continue
                if current is not None:
                    done.append((current, h.hexdigest()))
                current, h = digest, hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"digest": [d for d, _ in done], "ends": [e for _, e in done]}, schema=schema)
        if current is not None:
            yield pa.RecordBatch.from_pydict({"digest": [current], "ends": [h.hexdigest()]}, schema=schema)

    ordered = chunks.select("digest", "block", "cum", "ends").repartition("digest").sortWithinPartitions("digest", "block", "cum")
    return ordered.mapInArrow(run, "digest binary, ends string")


def trie(conversations: DataFrame, most_keys: int = BLOCK_KEYS) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = staged(forests(rebuilt(conversations), most_keys), "trie-forests")
    open_rows = rows.where(F.col("kind") == OPEN)
    edges = boundaries(open_rows)
    part = joined_small(open_rows, edges, "block", "inner", edges.count())
    # What the block before has counted already: the shared part of the first path, and its children.
    twice = F.col("first") & (F.col("depth") <= F.col("before"))
    own = F.col("n_convs").cast("long")
    path = F.when(twice, F.col("before_cum") - F.col("path_above")).otherwise(0)
    child = F.when(F.col("first") & (F.col("depth") < F.col("before")), 1).otherwise(0)
    # The last key is the end of a leaf only if the next block does not go on from it.
    goes_on = F.when(F.col("last") & (F.col("after") == F.col("deepest")), 1).otherwise(0)
    deepest = open_rows.where("last").groupBy("block").agg(F.max("depth").alias("deepest"))
    above = open_rows.where("first").select("block", (F.col("depth") + 1).alias("depth"), F.col("cum").alias("path_above"))
    part = part.join(deepest, "block").join(above, ["block", "depth"], "left").fillna({"path_above": 0})
    merged = part.groupBy("digest", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.sum(own).alias("n_convs"),
        F.sum(F.col("n_children") - child).alias("n_children"), F.sum(F.col("n_leaves") - goes_on).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + path).alias("saved_tokens"),
    )
    ends = hashed_ends(rows.where(F.col("kind") == ENDS))
    spine = staged(merged.join(ends, "digest", "left").fillna({"ends": EMPTY}), "trie-spine")
    names = spine.select(F.col("digest").alias("parent"), F.col("conv_id").alias("found"))
    n = spine.count()
    columns = ["depth", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    closed = rows.where(F.col("kind") == CLOSED)
    known = closed.where("parent IS NULL").select(*columns, F.col("parent_conv_id").alias("found"))
    open_parent = closed.where("parent IS NOT NULL").select(*columns).unionByName(spine.select(*columns))
    found = joined_small(open_parent, names, "parent", "left", n)
    return known.unionByName(found).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("found").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"),
    )


SQL = r"""
WITH table_ AS (SELECT list(v ORDER BY b) AS crc FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM range(256) AS t(b))),
raw AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS n,
  md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, t, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) AS pos FROM raw),
heads AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, x: xor(a >> 8, crc[CAST((xor(a, x) & 255) + 1 AS BIGINT)]))) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns), table_),
full_ AS (
  SELECT heads.c, t, n, pos FROM heads JOIN turns ON turns.c = heads.c - heads.c % 100 WHERE pos <= h
  UNION ALL SELECT heads.c, t, n, pos + 1000000000 FROM heads JOIN turns ON turns.c = heads.c WHERE pos > h),
steps AS (SELECT c, n, t, row_number() OVER (PARTITION BY c ORDER BY pos) AS d FROM full_),
paths AS (SELECT c, d, n, md5(string_agg(t, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM steps),
member AS (SELECT c, d, n, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), 'root') AS up FROM paths
  UNION ALL SELECT c, 0, 0, 'root', NULL FROM heads),
longest AS (SELECT c, max(d) AS d FROM member GROUP BY c),
node AS (SELECT p, any_value(up) AS up, d, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM member GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
owner AS (SELECT m.p AS above, node.p AS below, (node.n_convs - 1) * node.n AS saved, kids.p IS NULL AS leaf
  FROM node JOIN member m ON m.c = node.conv_id AND m.d <= node.d LEFT JOIN kids ON kids.p = node.p),
sums AS (SELECT above AS p, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS n_leaves FROM owner GROUP BY above),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM member JOIN longest USING (c, d) GROUP BY p)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, node.n_convs,
  coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sums USING (p) LEFT JOIN kids USING (p) LEFT JOIN ends USING (p) LEFT JOIN node AS above ON above.p = node.up
"""
