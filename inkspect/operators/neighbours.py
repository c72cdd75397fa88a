"""k nearest neighbours between two tables of vectors, exact unless asked otherwise.

Points of a checked, small size are broadcast and each task compares its own
queries with them. Larger point sets are cut into Voronoi cells around a few
pivots; triangle inequalities rule out cells that cannot hold a neighbour. Cells are
packed into groups of bounded size, a query goes once to each group that has a cell it
needs and meets these cells there. Both ways are exact.

``method="probes"`` is approximate and only used when named: as many cells as the square root
of the number of points, and every query meets the points of its ``probes`` nearest cells, in
bounded blocks. Its work is queries x probes x cell size in place of queries x points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspect.session import staged

MAX_BROADCAST_BYTES = 64 << 20
PIVOTS = 64
PROBES = 16
BLOCK_ROWS = 4096
# Vectors of a group of cells, and of the queries that meet it, in one task.
GROUP_BYTES = 32 << 20
# Distances are computed for so many queries and points at a time (16 MB).
TILE_QUERIES, TILE_POINTS = 256, 8192
RESULT = "qid long, pid long, d2 double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _nearest(q: np.ndarray, qid, p: np.ndarray, pid, k: int, skip_self: bool) -> pd.DataFrame:
    """The k nearest rows of ``p`` for each row of ``q``, ties by id.

    The expanded square picks candidates with a margin for its rounding error;
    their distances are then computed by difference. Both go through tiles of fixed size, and
    a query keeps its best rows from tile to tile, so memory does not follow the number of points.
    """
    want = min(k + int(skip_self), len(p))
    norms = np.einsum("ij,ij->i", p, p)
    largest = norms.max()
    out = []
    for start in range(0, len(q), TILE_QUERIES):
        part = q[start : start + TILE_QUERIES]
        squares = (part * part).sum(axis=1)
        margin = 1e-9 * (squares + largest) + 1e-12
        edge = np.full(len(part), np.inf)  # of the best rows so far
        # Row of the tile, column and distance; of every row the nearest ``want``, its own id counted apart.
        best = (np.empty(0, int), np.empty(0, int), np.empty(0))
        for first in range(0, len(p), TILE_POINTS):
            points = p[first : first + TILE_POINTS]
            rough = squares[:, None] + norms[None, first : first + TILE_POINTS] - 2.0 * part @ points.T
            if len(points) > want:
                edge = np.minimum(edge, np.partition(rough, want - 1, axis=1)[:, want - 1])
            rows, cols = np.nonzero(rough <= (edge + margin)[:, None])
            d2 = np.empty(len(rows))
            for at in range(0, len(rows), TILE_POINTS):
                diff = part[rows[at : at + TILE_POINTS]] - points[cols[at : at + TILE_POINTS]]
                d2[at : at + TILE_POINTS] = (diff * diff).sum(axis=1)
            rows, cols, d2 = (np.concatenate(c) for c in zip(best, (rows, cols + first, d2), strict=True))
            group = 2 * rows + (skip_self & (pid[cols] == qid[start + rows]))
            order = np.lexsort((pid[cols], d2, group))
            group, rows, cols, d2 = group[order], rows[order], cols[order], d2[order]
            rank = np.arange(len(rows)) - np.searchsorted(group, group)
            full = rank == want - 1
            np.minimum.at(edge, rows[full], d2[full])
            best = tuple(c[rank < want] for c in (rows, cols, d2))
        rows, cols, d2 = best
        order = np.lexsort((d2, rows))
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = np.full(len(part), np.inf)
        last[rows[rank == want - 1]] = d2[order][rank == want - 1]
        near = d2 <= last[rows] + margin[rows]
        found = pd.DataFrame({"qid": qid[start + rows[near]], "pid": pid[cols[near]], "d2": d2[near]})
        if skip_self:
            found = found[found.qid != found.pid]
        out.append(found.sort_values(["qid", "d2", "pid"]).groupby("qid", sort=False).head(k))
    return pd.concat(out)


def _vectors(df: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"))


def nearest(
    queries: DataFrame, points: DataFrame, k: int, id_col: str, vector: str,
    skip_self: bool = False, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
    method: str = "exact", probes: int = PROBES,
) -> DataFrame:
    """(qid, pid, d2, rank): the k nearest points of every query, ranks from 1.

    ``skip_self`` leaves out the point with the query's own id.
    """
    if method not in ("exact", "probes"):
        raise ValueError(f"no method {method}")
    q = _vectors(queries, id_col, vector, "qid")
    p = _vectors(points, id_col, vector, "pid")
    size = p.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    if method == "probes":
        found = _by_probes(q, staged(p, "knn-points"), k, skip_self, block_rows, size["n"], probes)
    elif size["n"] * (size["d"] + 1) * 8 <= max_broadcast_bytes:
        found = _by_broadcast(q, p, k, skip_self)
    else:
        most = max(block_rows, GROUP_BYTES // ((size["d"] + 1) * 8))
        found = _by_cells(q, staged(p, "knn-points"), k, skip_self, most)
    order = Window.partitionBy("qid").orderBy("d2", "pid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_broadcast(q: DataFrame, p: DataFrame, k: int, skip_self: bool) -> DataFrame:
    local = p.orderBy("pid").toPandas()  # at most max_broadcast_bytes, checked by the caller
    if local.empty:
        return q.sparkSession.createDataFrame([], RESULT)
    shared = q.sparkSession.sparkContext.broadcast((local.pid.to_numpy(), _matrix(local.v)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, vectors = shared.value
        for batch in batches:
            if len(batch):
                yield _nearest(_matrix(batch.v), batch.qid.to_numpy(), vectors, pid, k, skip_self)

    return q.mapInPandas(search, RESULT)


def _by_cells(q: DataFrame, p: DataFrame, k: int, skip_self: bool, group_rows: int) -> DataFrame:
    points, queries = _in_groups(q, p, k, skip_self, group_rows)

    def meet(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"qid": [], "pid": [], "d2": []})]
        if len(points) and len(asked):
            qid, vectors = asked.qid.to_numpy(), _matrix(asked.v)
            needed = np.unpackbits(np.stack([np.frombuffer(n, np.uint8) for n in asked.needed]), axis=1).astype(bool)
            for cell, held in points.groupby("cell"):
                rows = needed[:, cell]
                if rows.any():
                    found.append(_nearest(vectors[rows], qid[rows], _matrix(held.v), held.pid.to_numpy(), k, skip_self))
        found = pd.concat(found) if len(found) == 1 else pd.concat(found[1:])
        return found.sort_values(["qid", "d2", "pid"]).groupby("qid", sort=False).head(k)

    keys = ["group", "part"]
    return points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(meet, RESULT)


def _packed(sizes: list[int], most: int) -> tuple[list[tuple[int, int]], int]:
    """Per cell its first group and the number of groups it is spread over, and the number of all groups."""
    out, groups, room = [], 0, 0
    for n in sizes:
        if n > most:
            out.append((groups, math.ceil(n / most)))
            groups, room = groups + out[-1][1], 0
            continue
        if n > room:
            groups, room = groups + 1, most
        out.append((groups - 1, 1))
        room -= n
    return out, groups


def _in_groups(q: DataFrame, p: DataFrame, k: int, skip_self: bool, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(group, part, pid, v, cell) of the points and (group, part, qid, v, needed) of the queries.

    A group holds whole cells, or a share of a large one, of ``group_rows`` rows at most. Its queries
    are dealt into parts of that size, and at least so many that all cores have work. ``needed``
    has a bit for every cell.
    """
    # Pivots: the PIVOTS points with the smallest id hash.
    pivots = _matrix(p.orderBy(F.xxhash64("pid"), "pid").limit(PIVOTS).toPandas().v)

    def to_pivots(v: np.ndarray) -> np.ndarray:
        square = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * v @ pivots.T
        return np.sqrt(np.maximum(square, 0.0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = to_pivots(_matrix(batch.v))
                yield batch.assign(cell=far.argmin(axis=1), far=far.min(axis=1))

    cells = staged(p.mapInPandas(assign, "pid long, v array<double>, cell long, far double"), "knn-cells")
    want = k + int(skip_self)
    # Per cell: rows, radii and the few smallest pivot distances; PIVOTS x 16 x k rows at most.
    salted = Window.partitionBy("cell", F.pmod(F.xxhash64("pid"), F.lit(16))).orderBy("far")
    closest = cells.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= want)
    closest = closest.select("cell", "far").toPandas()
    stats = cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")
    ).toPandas().sort_values("cell")
    ids = stats.cell.to_numpy()
    lo, hi = stats.lo.to_numpy(), stats.hi.to_numpy()
    head = closest.sort_values("far").groupby("cell").head(want)
    head_cell, head_far = head.cell.to_numpy(), head.far.to_numpy()
    places, groups = _packed(stats.n.tolist(), group_rows)
    # Which cell has rows in which group.
    inside = np.zeros((len(ids), groups), bool)
    for i, (first, over) in enumerate(places):
        inside[i, first : first + over] = True

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            far = to_pivots(_matrix(batch.v))
            upper = far[:, head_cell] + head_far[None, :]
            bound = np.partition(upper, min(want, upper.shape[1]) - 1, axis=1)[:, min(want, upper.shape[1]) - 1]
            gap = np.maximum(far[:, ids] - hi[None, :], lo[None, :] - far[:, ids])
            # The slack covers rounding of the pivot distances; it can only add cells.
            near = gap <= bound[:, None] * (1 + 1e-6) + 1e-6
            bits = np.zeros((len(batch), len(pivots)), bool)
            bits[:, ids] = near
            needed = np.array([row.tobytes() for row in np.packbits(bits, axis=1)], object)
            for group in range(groups):
                rows = np.flatnonzero(near[:, inside[:, group]].any(axis=1))
                if len(rows):
                    yield batch.iloc[rows].assign(needed=needed[rows], group=group)

    cores = p.sparkSession.sparkContext.defaultParallelism
    parts = max(math.ceil(q.count() / group_rows), math.ceil(cores / groups), 1)
    table = p.sparkSession.createDataFrame(
        [(int(c), first, over) for c, (first, over) in zip(ids, places, strict=True)], "cell long, first int, over int"
    )
    points = cells.join(F.broadcast(table), "cell")  # one row per pivot
    points = points.withColumn("group", (F.col("first") + F.pmod(F.xxhash64("pid"), F.col("over"))).cast("int"))
    points = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = q.mapInPandas(route, "qid long, v array<double>, needed binary, group int")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    return points.select("group", "part", "pid", "v", "cell"), queries.select("group", "part", "qid", "v", "needed")


def _by_probes(q: DataFrame, p: DataFrame, k: int, skip_self: bool, block_rows: int, n: int, probes: int) -> DataFrame:
    """Approximate: candidates are the points of the cells whose pivots are nearest to the query."""
    count = max(1, math.isqrt(n))
    rows = p.orderBy(F.xxhash64("pid"), "pid").limit(count).toPandas()  # the square root of the number of points
    if rows.empty:
        return q.sparkSession.createDataFrame([], RESULT)
    shared = q.sparkSession.sparkContext.broadcast(_matrix(rows.v))

    def nearest_cells(batch: pd.DataFrame, most: int) -> np.ndarray:
        pivots, v = shared.value, _matrix(batch.v)
        square = (pivots * pivots).sum(axis=1)[None, :] - 2.0 * v @ pivots.T
        most = min(most, len(pivots))
        return np.argpartition(square, most - 1, axis=1)[:, :most]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=nearest_cells(batch, 1)[:, 0])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells = nearest_cells(batch, probes)
                at = np.repeat(np.arange(len(batch)), cells.shape[1])
                yield batch.iloc[at].assign(cell=cells.ravel())

    cells = staged(p.mapInPandas(assign, "pid long, v array<double>, cell long"), "knn-cells")
    routed = staged(q.mapInPandas(route, "qid long, v array<double>, cell long"), "knn-routed")
    sizes = {r["cell"]: math.ceil(r["n"] / block_rows) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _in_blocks(routed, cells, sizes, k, skip_self, block_rows)


def _in_blocks(routed: DataFrame, cells: DataFrame, subs: dict[int, int], k: int, skip_self: bool, block_rows: int) -> DataFrame:
    """Candidates of routed queries among the points of their cells; both sides of a cell are cut into blocks."""
    load = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = routed.sparkSession.createDataFrame(
        [(int(c), int(n), math.ceil(load.get(c, 0) / block_rows)) for c, n in subs.items()], "cell long, subs int, parts int"
    )
    plan = F.broadcast(table)  # one row per pivot

    def spread_over(key: str, own: str, other: str, own_name: str, other_name: str, df: DataFrame) -> DataFrame:
        return (
            df.join(plan, "cell")
            .where("parts > 0")
            .withColumn(own_name, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
            .withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select("cell", "sub", "part", key, "v")
        )

    left = spread_over("pid", "subs", "parts", "sub", "part", cells)
    right = spread_over("qid", "parts", "subs", "part", "sub", routed)

    def block(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if points.empty or asked.empty:
            return pd.DataFrame({"qid": [], "pid": [], "d2": []})
        return _nearest(
            _matrix(asked.v), asked.qid.to_numpy(), _matrix(points.v), points.pid.to_numpy(), k, skip_self
        )

    keys = ["cell", "sub", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, RESULT)


def classify(neighbours: DataFrame, points: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """(qid, prediction, p1): majority label of the neighbours, ties to the smaller label."""
    marks = points.select(F.col(id_col).cast("long").alias("pid"), F.col(label).alias("_l"))
    votes = (
        neighbours.join(marks, "pid")
        .groupBy("qid", "_l")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    best = F.min_by("_l", F.struct(-F.col("votes"), F.col("_l")))
    ones = F.coalesce(F.sum(F.when(F.col("_l") == 1, F.col("votes"))), F.lit(0))
    return votes.groupBy("qid").agg(
        best.alias("prediction"), (ones / F.sum("votes")).alias("p1")
    )
