"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Equal vectors are one class. Coarse centroids and the codebooks of residual subspaces are
fitted on a bounded sample (``SAMPLE_ROWS`` vectors with the smallest hash); every vector is
indexed: it stands in the list of its nearest centroid with the codes of its residual
and the error of that code.

As a query, a vector probes every list whose boundary with its own cell is near: a partner
at the linking distance r lies across a boundary at distance b only if its offset in that
one direction reaches b. The offset has a standard deviation of r / sqrt(dimensions), and
lists within ``PROBE_DEVIATIONS`` of them are probed, as many as there are. Within a list,
distances are summed from per-subspace tables; |x - code(y)| <= r + error(y) drops no
partner by the triangle inequality. What remains is decided by the exact cosine.

Lists are cut into tiles of at most ``TILE`` members by ``TILE`` queries, so a list or group
of copies of any size is spread over tasks. Links are counted in the tiles and only a
spanning forest of each tile is kept for the components; pairs are never written.

Defined cases: vectors that are null, zero or hold null or non-finite components link
with nothing; vectors of different lengths never link; null ids never represent a group;
rows that repeat a vector are linked with each other, whatever their ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspect.llm.common import components, joined_small
from inkspect.session import spread, staged

COSINE = 0.95
SAMPLE_ROWS = 40_000
SAMPLE_BYTES = 64 << 20
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 256
PROBE_DEVIATIONS = 3.0
TILE = 2048
PAIR_CHUNK = 100_000


def parsed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, node, dim, vec): the components as doubles or, if they came so, floats; node -1 links with nothing."""
    small = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if small else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'float' if small else 'double'}>").alias("v"))
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                x = None
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    d = x.astype(float)
                    if not np.isfinite(d).all() or not np.isfinite(d @ d) or not d @ d > 0:
                        x = None
                # Negative zero equals zero.
                data = (x + 0).tobytes() if x is not None else b""
                rows.append((i, xxhash.xxh3_64_intdigest(data) >> 1 if data else -1, len(data) // np.dtype(kind).itemsize, data))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return spread(source, "id").mapInArrow(run, "id bigint, node bigint, dim int, vec binary")


def _unit(data: list[bytes], kind: str, width: int) -> np.ndarray:
    """Unit vectors in double precision, filled with zeros to a common width."""
    out = np.zeros((len(data), width))
    for i, b in enumerate(data):
        x = np.frombuffer(b, dtype=kind).astype(float)
        out[i, : len(x)] = x
    return out / np.linalg.norm(out, axis=1, keepdims=True) if len(data) else out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (centres**2).sum(axis=1)
    return np.concatenate(
        [np.argmin(squares - 2 * x[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)] or [np.empty(0, int)]
    )


def fit(sample: np.ndarray, lists: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centroids, and codebooks (subspace, code, part) of the residuals."""
    rng = np.random.default_rng(seed)
    centres = _kmeans(sample, lists, rng)
    residual = sample - centres[_nearest(sample, centres)]
    part = sample.shape[1] // SUBSPACES
    books = [_kmeans(residual[:, s * part : (s + 1) * part], CODES, rng) for s in range(SUBSPACES)]
    codes = max(map(len, books))
    return centres, np.stack([np.concatenate([b, np.repeat(b[:1], codes - len(b), axis=0)]) for b in books])


def encode(x: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, residual codes and code error of unit vectors."""
    own = _nearest(x, centres)
    residual = x - centres[own]
    part = x.shape[1] // SUBSPACES
    codes = np.stack([_nearest(residual[:, s * part : (s + 1) * part], books[s]) for s in range(SUBSPACES)], axis=1)
    rebuilt = np.concatenate([books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
    return own, codes.astype(np.uint8), np.linalg.norm(residual - rebuilt, axis=1)


def probes(x: np.ndarray, own: np.ndarray, centres: np.ndarray, radius: float, dim: np.ndarray) -> list[np.ndarray]:
    """Lists whose boundary with the own cell is within reach, the own list among them."""
    squares = (centres**2).sum(axis=1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares - 2 * centres @ centres.T, 0))
    out = []
    for a in range(0, len(x), 1024):
        d = squares - 2 * x[a : a + 1024] @ centres.T
        o = own[a : a + 1024]
        gap = d - d[np.arange(len(o)), o][:, None]
        reach = radius * np.minimum(1.0, PROBE_DEVIATIONS / np.sqrt(dim[a : a + 1024]))[:, None]
        out += [np.flatnonzero(row) for row in gap <= 2 * reach * apart[o] + 1e-12]
    return out


def near_pairs(x: np.ndarray, y: np.ndarray, codes: np.ndarray, error: np.ndarray, centre: np.ndarray, books: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with an exact cosine of ``cosine`` or more, found by asymmetric distances."""
    part = x.shape[1] // SUBSPACES
    residual = x - centre
    total = np.zeros((len(x), len(y)), np.float32)
    for s in range(SUBSPACES):
        r = residual[:, s * part : (s + 1) * part]
        table = (r**2).sum(axis=1)[:, None] + (books[s] ** 2).sum(axis=1) - 2 * r @ books[s].T
        total += table.astype(np.float32)[:, codes[:, s]]
    reach = math.sqrt(2 - 2 * cosine) + error + 1e-3
    i, j = np.nonzero(total <= (reach**2).astype(np.float32))
    keep = [np.empty(0, bool)]
    for a in range(0, len(i), PAIR_CHUNK):
        b, c = i[a : a + PAIR_CHUNK], j[a : a + PAIR_CHUNK]
        keep.append((x[b] * y[c]).sum(axis=1) >= cosine)
    ok = np.concatenate(keep)
    return i[ok], j[ok]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group) that connect what the pairs connect."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        now = label.copy()
        np.minimum.at(now, u, low)
        np.minimum.at(now, v, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def links(classes: DataFrame, kind: str, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(counts (node, links), edges (a, b)) of a table of classes (node, mult, dim, vec)."""
    spark = classes.sparkSession
    n, width = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not n:
        return spark.createDataFrame([], "node bigint, links bigint"), spark.createDataFrame([], "a bigint, b bigint")
    width = -(-width // SUBSPACES) * SUBSPACES
    most = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width)))
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(most).select("vec").toPandas()["vec"]
    lists = int(max(1, min(MOST_LISTS, 2 * math.sqrt(n), len(sample))))
    shared = spark.sparkContext.broadcast(fit(_unit(list(sample), kind, width), lists))
    radius = math.sqrt(2 - 2 * cosine)
    schema = pa.schema([
        ("node", pa.int64()), ("mult", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("list", pa.int32()),
        ("codes", pa.binary()), ("error", pa.float64()), ("probes", pa.list_(pa.int32())),
    ])

    def index(batches):
        centres, books = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = _unit(part.column("vec").to_pylist(), kind, width)
                own, codes, error = encode(x, centres, books)
                reach = probes(x, own, centres, radius, part.column("dim").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("node", "mult", "dim", "vec")]
                    + [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes]), pa.array(error), pa.array(reach, pa.list_(pa.int32()))],
                    schema=schema,
                )

    ddl = "node bigint, mult bigint, dim int, vec binary, list int, codes binary, error double, probes array<int>"
    indexed = staged(classes.select("node", "mult", "dim", "vec").mapInArrow(index, ddl), "index")
    # Sizes of the lists, at most MOST_LISTS rows.
    members = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    asked = indexed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("q"))
    sizes = staged(
        members.join(asked, "list").select("list", F.ceil(F.col("m") / TILE).cast("int").alias("mb"), F.ceil(F.col("q") / TILE).cast("int").alias("qb")),
        "list-sizes",
    )
    h = F.xxhash64("node")
    own = indexed.join(F.broadcast(sizes), "list").select(
        "list", F.pmod(h, "mb").cast("int").alias("mt"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qt"),
        F.lit(True).alias("member"), "node", "mult", "dim", "vec", "codes", "error", F.col("list").alias("home"), "probes",
    )
    query = indexed.withColumn("home", F.col("list")).withColumn("list", F.explode("probes")).join(F.broadcast(sizes), "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mt"), F.pmod(h, "qb").cast("int").alias("qt"),
        F.lit(False).alias("member"), "node", "mult", "dim", "vec", F.lit(b"").alias("codes"), F.lit(0.0).alias("error"),
        "home", F.array().cast("array<int>").alias("probes"),
    )

    def tile(key, rows: pd.DataFrame) -> pd.DataFrame:
        centres, books = shared.value
        flag = rows["member"].to_numpy(dtype=bool)
        m, q = rows[flag], rows[~flag]
        if not len(m) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        y, x = _unit(list(m["vec"]), kind, width), _unit(list(q["vec"]), kind, width)
        codes = np.frombuffer(b"".join(m["codes"]), np.uint8).reshape(len(m), SUBSPACES)
        i, j = near_pairs(x, y, codes, m["error"].to_numpy(), centres[key[0]], books, cosine)
        qn, mn = q["node"].to_numpy(), m["node"].to_numpy()
        ok = (qn[i] != mn[j]) & (q["dim"].to_numpy()[i] == m["dim"].to_numpy()[j])
        i, j = i[ok], j[ok]
        n = np.bincount(i, weights=m["mult"].to_numpy()[j], minlength=len(q)).astype(np.int64)
        # A member that doesn't probe the asking vector's list won't find this link itself, so it is counted here.
        probed = np.concatenate([row * MOST_LISTS + np.asarray(lists, np.int64) for row, lists in enumerate(m["probes"])])
        alone = ~np.isin(j * MOST_LISTS + q["home"].to_numpy(dtype=np.int64)[i], probed)
        back = np.bincount(j[alone], weights=q["mult"].to_numpy()[i[alone]], minlength=len(m)).astype(np.int64)
        some, others = np.flatnonzero(n), np.flatnonzero(back)
        a, b = _forest(qn[i], mn[j])
        return pd.DataFrame({
            "a": np.concatenate([qn[some], mn[others], a]), "b": np.concatenate([np.full(len(some) + len(others), -1), b]),
            "links": np.concatenate([n[some], back[others], np.zeros(len(a), np.int64)]),
        })

    found = staged(own.unionByName(query).groupBy("list", "mt", "qt").applyInPandas(tile, "a bigint, b bigint, links bigint"), "links")
    counts = found.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return counts, found.filter("b >= 0").select("a", "b")


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per vector: its id, n_links, component_id, kept."""
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = staged(parsed(vectors, id_col, vector_col), "vectors")
    classes = staged(
        rows.filter("node >= 0").groupBy("node").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("dim").alias("dim"), F.first("vec").alias("vec")
        ),
        "vector-classes",
    )
    counts, edges = links(classes, kind, cosine)
    groups = components(edges)
    placed = classes.select("node", "least", "mult").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    per = placed.join(least, "component").join(counts, "node", "left")
    per = staged(per.select("node", "component_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-groups")
    out = joined_small(rows.select("id", "node"), per, "node", "left", per.count())
    component = F.when(F.col("node") >= 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, least(x.vec_id, coalesce(c, x.vec_id)) AS component_id,
  x.vec_id = least(x.vec_id, coalesce(c, x.vec_id)) AS kept
FROM embeddings x LEFT JOIN comp ON comp.a = x.vec_id LEFT JOIN n ON n.a = x.vec_id
"""
