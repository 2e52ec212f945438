"""Proximity graphs and beam search: an approximate alternative to exact nearest neighbours.

A graph is a table (part, node, neighbours): rows of a part are the vertices of a graph of their own, so that it is
built and searched in one task. A small set, such as an index's centers, is one part; a base is cut into parts of
at most PART_ROWS rows by a hash of the id, every part is searched, and the parts' results are merged. A query walks from seeded entry
points to whichever known vertex is nearest, and stops when the pool of the `ef` nearest has no vertex left to open.
The walks of many queries go in step.
"""

from __future__ import annotations

import heapq
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import kernels
from vicinal.operators.range_join import query_blocks

#: Edges that a vertex keeps, vertices that are considered for them, size of the pool, rows of a part, entry points.
DEGREE, CONSIDERED, EF, PART_ROWS, ENTRIES = 16, 48, 100, 20_000, 4
#: Walks that go in step, and vertices that each opens in a step; vertices that are linked in step, and queries that are
#: compared at once; distances that differ by less are equal, for norms of 1.
BLOCK, WAVE, LINKED, COMPARED, TIE = 64, 32, 256, 2048, 1e-12


def spread_out(rows: np.ndarray, near: np.ndarray, d: np.ndarray, valid: np.ndarray, degree: int) -> np.ndarray:
    """Which neighbours some vertices keep. Of a vertex's valid neighbours, a row of near in order of distance d: those
    that no kept one is nearer to than the vertex is; then the nearest of the others, until there are `degree`. The
    vertices go in step, a place in the order at a time."""
    x = rows[near]
    own = np.einsum("ijk,ijk->ij", x, x)
    nearer = own[:, :, None] + own[:, None] - 2 * (x @ x.transpose(0, 2, 1)) < d[:, :, None] - TIE * (1 + own.max(initial=0))
    kept, count = np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
    for k in range(near.shape[1]):
        kept[:, k] = valid[:, k] & (count < degree) & ~(kept & nearer[:, k]).any(axis=1)
        count += kept[:, k]
    rest = valid & ~kept
    return kept | (rest & (np.cumsum(rest, axis=1) <= degree - count[:, None]))


def link(rows: np.ndarray, degree: int = DEGREE, considered: int = CONSIDERED) -> list[np.ndarray]:
    """The neighbours of each row: spread-out near ones, and, as edges go both ways, those that chose it, so that
    no vertex is out of reach of its own neighbours."""
    n = len(rows)
    if n < 2:
        return [np.zeros(0, np.int32)] * n
    edges = []
    for at in range(0, n, LINKED):
        c, d = kernels.nearest(rows[at : at + LINKED], rows, min(n, considered + 1))
        own = np.arange(at, at + len(c))
        i, j = np.nonzero(spread_out(rows, c, d, c != own[:, None], degree))
        one, other = own[i], c[i, j].astype(np.int64)
        edges += [one * n + other, other * n + one]
    one, other = np.divmod(np.unique(np.concatenate(edges)), n)
    return np.split(other.astype(np.int32), np.searchsorted(one, np.arange(1, n)))


def beam(rows: np.ndarray, links: list[np.ndarray], query: np.ndarray, k: int, ef: int, entries: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, squared distance) of the k nearest rows that a walk finds, ties by row. allowed: rows that may be
    results; others are only passed through."""
    seen = np.zeros(len(rows), bool)
    seen[entries] = True
    d = kernels.exact_l2_sq(rows[entries], np.broadcast_to(query, (len(entries), len(query))))
    todo = list(zip(d.tolist(), entries.tolist(), strict=True))
    heapq.heapify(todo)
    pool = [(-x, -i) for x, i in todo if allowed is None or allowed[i]]
    heapq.heapify(pool)
    while todo:
        near, i = heapq.heappop(todo)
        if len(pool) >= ef and near > -pool[0][0]:
            break
        new = links[i][~seen[links[i]]]
        if not len(new):
            continue
        seen[new] = True
        d = kernels.exact_l2_sq(rows[new], np.broadcast_to(query, (len(new), len(query))))
        for x, j in zip(d.tolist(), new.tolist(), strict=True):
            if len(pool) < ef or x < -pool[0][0]:
                heapq.heappush(todo, (x, j))
                if allowed is None or allowed[j]:
                    heapq.heappush(pool, (-x, -j))
                    if len(pool) > ef:
                        heapq.heappop(pool)
    best = sorted((-x, -i) for x, i in pool)[:k]
    return np.array([i for _, i in best], np.int64), np.array([x for x, _ in best])


def beams(rows: np.ndarray, links: tuple[np.ndarray, np.ndarray], queries: np.ndarray, k: int, ef: int, entries: np.ndarray, allowed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As beam, of many queries in step: (query, rows, squared distances). links: where each vertex's edges start, and all
    edges. In a step every walk opens the nearest of its vertices that its pool does not rule out, WAVE of them at most;
    it has seen what beam sees, and somewhat more. Where a pool can hold all rows that may be results, it never rules a
    vertex out, and the walk sees all it can reach: then these are compared without walking."""
    n, (start, edges) = len(rows), links
    may = np.flatnonzero(allowed & reached(links, entries)) if np.count_nonzero(allowed) <= ef else None
    if may is not None:
        for at in range(0, len(queries), COMPARED):
            q = queries[at : at + COMPARED]
            best, d = kernels.nearest(q, rows[may], k) if len(may) else (np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0)))
            yield from zip(range(at, at + len(q)), may[best], d, strict=True)
        return
    own = np.einsum("ij,ij->i", rows, rows)
    for at in range(0, len(queries), BLOCK):
        q = queries[at : at + BLOCK]
        m, mine = len(q), np.einsum("ij,ij->i", q, q)
        seen, last = np.zeros(m * n, bool), np.zeros(m * n, np.int32)
        who, what = np.repeat(np.arange(m), len(entries)), np.tile(entries, m)
        seen[who * n + what] = True
        d, v, todo = np.zeros((m, 0)), np.zeros((m, 0), np.int64), np.zeros((m, 0), bool)
        while len(who):
            # what is new, a row a walk, padded
            count = np.bincount(who, minlength=m)
            ends = np.cumsum(count)
            place = np.arange(len(who)) - (ends - count)[who]
            new_d, new_v, new = np.full((m, count.max()), np.inf), np.zeros((m, count.max()), np.int64), np.zeros((m, count.max()), bool)
            x = np.concatenate([rows[what[e - c : e]] @ q[i] for i, (c, e) in enumerate(zip(count.tolist(), ends.tolist(), strict=True))])
            new_d[who, place], new_v[who, place], new[who, place] = own[what] + mine[who] - 2 * x, what, True
            d, v, todo = np.hstack([d, new_d]), np.hstack([v, new_v]), np.hstack([todo, new])
            pool = np.where(allowed[v], d, np.inf)
            edge = np.partition(pool, ef - 1, axis=1)[:, ef - 1] if pool.shape[1] >= ef else np.full(m, np.inf)
            todo &= d <= edge[:, None]
            left = np.where(todo, d, np.inf)
            wide = min(WAVE, left.shape[1])
            best = np.argpartition(left, wide - 1, axis=1)[:, :wide]
            walk, column = np.nonzero(np.take_along_axis(todo, best, 1))
            column = best[walk, column]
            todo[walk, column] = False
            opened = v[walk, column]
            size = start[opened + 1] - start[opened]
            who = np.repeat(walk, size)
            what = edges[np.arange(len(who)) + np.repeat(start[opened] - (np.cumsum(size) - size), size)] if len(who) else edges[:0]
            key = who * n + what
            fresh = np.flatnonzero(~seen[key])
            last[key[fresh]] = fresh  # of those that several vertices lead to, one stays
            fresh = fresh[last[key[fresh]] == fresh]
            seen[key[fresh]] = True
            who, what = who[fresh], what[fresh]
        pool = np.where(allowed[v] & np.isfinite(d), d, np.inf)
        take = min(pool.shape[1], k + 8)
        best = np.argpartition(pool, take - 1, axis=1)[:, :take] if take else np.zeros((m, 0), np.int64)
        for i in range(m):
            found = v[i, best[i]][np.isfinite(pool[i, best[i]])]
            exact = kernels.exact_l2_sq(rows[found], np.broadcast_to(q[i], (len(found), q.shape[1])))
            order = np.lexsort((found, exact))[:k]
            yield at + i, found[order], exact[order]


def reached(links: tuple[np.ndarray, np.ndarray], entries: np.ndarray) -> np.ndarray:
    """Whether edges lead to each vertex from some entry."""
    start, edges = links
    seen, new = np.zeros(len(start) - 1, bool), np.unique(entries)
    while len(new):
        seen[new] = True
        size = start[new + 1] - start[new]
        to = np.unique(edges[np.arange(size.sum()) + np.repeat(start[new] - (np.cumsum(size) - size), size)])
        new = to[~seen[to]]
    return seen


class Scores:
    """A heap of vertices by score, highest first, ties by number, whose scores may change: an entry that a later one
    has overtaken is dropped when it comes up."""

    def __init__(self, n: int) -> None:
        self.score = [0] * n
        self.open = [True] * n
        self.heap = [(0, i) for i in range(n)]

    def add(self, i: int, by: int) -> None:
        if self.open[i]:
            self.score[i] += by
            heapq.heappush(self.heap, (-self.score[i], i))

    def pop(self) -> int:
        while True:
            s, i = heapq.heappop(self.heap)
            if self.open[i] and -s == self.score[i]:
                self.open[i] = False
                return i


def locality_order(links: list[np.ndarray], window: int) -> list[int]:
    """An order of a small graph's vertices, such as an index's clusters, in which those that are read one after the
    other are near: greedily, the vertex with the most edges to the `window` vertices before it, counting edges to
    a common neighbour too, comes next. Starts with the vertex of most edges, ties by number."""
    into: list[list[int]] = [[] for _ in links]
    for i, out in enumerate(links):
        for x in out.tolist():
            into[x].append(i)
    scores, order = Scores(len(links)), []

    def change(v: int, by: int) -> None:
        for x in links[v].tolist():
            scores.add(x, by)
        for u in into[v]:
            scores.add(u, by)
            for x in links[u].tolist():
                if x != v:
                    scores.add(x, by)

    if links:
        first = max(range(len(links)), key=lambda i: (len(links[i]), -i))
        scores.add(first, 1)
    while len(order) < len(links):
        order.append(scores.pop())
        change(order[-1], 1)
        if len(order) > window:
            change(order[-1 - window], -1)
    return order


def build_graph(base: DataFrame, degree: int = DEGREE, part_rows: int = PART_ROWS) -> DataFrame:
    """(part, id, vec, neighbours) of base(id, vec): neighbours are ids of the same part. Rows without a finite vector
    are no vertices."""
    good = base.select(F.col("id").cast("long").alias("id"), "vec").where(F.col("vec").isNotNull() & V.is_finite("vec"))
    parts = max(1, -(-good.count() // part_rows))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, links = table.column("id").to_numpy(), link(kernels.matrix(table.column("vec")), degree)
        return table.append_column("neighbours", pa.array([ids[x] for x in links], pa.list_(pa.int64())))

    cut = good.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)).cast("int")).select("part", "id", "vec")
    return cut.groupBy("part").applyInArrow(run, "part int, id long, vec array<double>, neighbours array<bigint>")


def search_graph(graph: DataFrame, queries: DataFrame, k: int, ef: int = EF, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, base_id, dist_sq, rank): each query's k nearest as far as walks find them. allowed(id): rows that may
    be results, such as those of a label, or those that were not deleted since. Queries are broadcast in blocks."""
    spark = graph.sparkSession
    marked = graph.withColumn("ok", F.lit(True))
    if allowed is not None:
        marked = graph.join(allowed.select("id").distinct().withColumn("ok", F.lit(True)), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    marked = marked.select("part", "id", "vec", "neighbours", "ok")
    found = None
    for block in query_blocks(queries):
        part = marked.groupBy("part").applyInArrow(_walk(spark.sparkContext.broadcast(block), k, max(ef, k)), "query_id long, base_id long, dist_sq double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, base_id long, dist_sq double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist_sq", "base_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _walk(block, k: int, ef: int):
    def run(table: pa.Table) -> pa.Table:
        asked, matrix = block.value
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)), ids[order]
        rows, allowed = kernels.matrix(table.column("vec")), table.column("ok").to_numpy(zero_copy_only=False)
        lists = table.column("neighbours").combine_chunks()
        size, wanted = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        of = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        known = ids[of] == wanted
        start = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(len(ids)), size)[known], minlength=len(ids)))]
        entries = np.random.default_rng(5).permutation(len(ids))[:ENTRIES]
        out: list[list] = [[], [], []]
        for q, i, d in beams(rows, (start, of[known]), matrix, k, ef, entries, allowed):
            out[0] += [int(asked[q])] * len(i)
            out[1] += ids[i].tolist()
            out[2] += d.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "base_id": pa.array(out[1], pa.int64()), "dist_sq": pa.array(out[2], pa.float64())})

    return run


def write_graph(graph: DataFrame, path: str) -> None:
    graph.write.mode("overwrite").parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored graph. One that is missing, or is no graph, is a warning and no graph: exact search takes its place."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        warnings.warn(f"no graph: {e}", stacklevel=2)
        return None
    if set(found.columns) != {"part", "id", "vec", "neighbours"}:
        warnings.warn(f"no graph: {path} has {found.columns}", stacklevel=2)
        return None
    return found
