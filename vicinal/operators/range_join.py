"""Range joins: every (query, base) pair with squared distance at most r_sq.

Up to BLOCKS blocks of queries, base rows don't move: queries are broadcast block by block, and each Arrow batch of
base rows is one matrix product. Beyond them both sides are dealt to the cells of pivots, and chunks of cells near
enough meet in tasks of bounded size. base(id, vec) and queries(query_id, vec) hold array<double>; rows with a null or
non-finite vector have no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import kernels
from vicinal.plans.shared import materialize

#: Bytes of queries that are broadcast at once, and so many blocks at most (together what the driver may hold).
BLOCK_BYTES, BLOCKS = 64 << 20, 8
PAIRS = "query_id long, base_id long, dist_sq double"
#: Base rows of one product at most, and pairs in it, about, so that its result stays small.
ROWS, PRODUCT = 4096, 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A few rows in one file would be one task."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def query_bytes(queries: DataFrame) -> int:
    return queries.agg(F.sum(8 * F.size("vec") + 8)).first()[0] or 0


def query_blocks(queries: DataFrame, block_bytes: int | None = None, held: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of finite queries, block by block in order of id. Up to BLOCKS blocks come to the driver at once,
    more of them one at a time."""
    block_bytes = block_bytes or BLOCK_BYTES
    good = queries.select(F.col("query_id").cast("long").alias("query_id"), "vec").where(F.col("vec").isNotNull() & V.is_finite("vec"))
    if (query_bytes(queries) if held is None else held) <= BLOCKS * block_bytes:
        found = good.toArrow()
        if found.num_rows:
            ids, matrix = found.column("query_id").to_numpy(), kernels.matrix(found.column("vec"))
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], matrix[order]
            step = max(1, block_bytes // (8 * matrix.shape[1] + 8))
            for at in range(0, len(ids), step):
                yield ids[at : at + step], matrix[at : at + step]
        return
    ids, rows, size = [], [], 0
    for r in good.orderBy("query_id").toLocalIterator(prefetchPartitions=True):
        ids.append(r["query_id"])
        rows.append(r["vec"])
        size += 8 * len(r["vec"]) + 8
        if size >= block_bytes:
            yield np.array(ids), np.array(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows)


def _scan(block, r_sq: float, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        step = max(64, min(ROWS, PRODUCT // len(ids)))
        for batch in batches:
            key, rows = kernels.finite(batch.column(0).to_numpy(), kernels.matrix(batch.column(1)))
            for at in range(0, len(key), step):
                i, j, d = kernels.within_radius(matrix, rows[at : at + step], r_sq, strict)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(key[at + j]), pa.array(d)], names=["query_id", "base_id", "dist_sq"])

    return run


def finite(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), "vec").where(F.col("vec").isNotNull() & V.is_finite("vec"))


def range_join(base: DataFrame, queries: DataFrame, r_sq: float, strict: bool = False) -> DataFrame:
    """(query_id, base_id, dist_sq) of all pairs within the radius, inclusive unless strict."""
    spark = base.sparkSession
    held = query_bytes(queries)
    if held > BLOCKS * BLOCK_BYTES:
        return pivot_join(base, queries, r_sq, strict)
    rows = spread(base.select(F.col("id").cast("long").alias("id"), "vec").where(F.col("vec").isNotNull()))
    parts = [rows.mapInArrow(_scan(spark.sparkContext.broadcast(b), r_sq, strict), PAIRS) for b in query_blocks(queries, held=held)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PAIRS)


def count_per_query(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, n_hits) with zeros."""
    counts = pairs.groupBy("query_id").agg(F.count("base_id").alias("n"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_hits"))


def verify(pairs: DataFrame, base: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs whose distance, computed again from the tables, differs; empty if all is well."""
    b = base.select(F.col("id").alias("base_id"), F.col("vec").alias("bv"))
    q = queries.select("query_id", F.col("vec").alias("qv"))
    again = pairs.join(b, "base_id", "left").join(q, "query_id", "left")
    return again.where(F.coalesce(F.abs(V.l2_sq("bv", "qv") - F.col("dist_sq")) > 1e-9, F.lit(True))).select("query_id", "base_id", "dist_sq")


#: Rows of one side of a task of a pivot join, and pivots at most.
CHUNK, PIVOTS = 2048, 4096


def _placed(df: DataFrame, centers, name: str) -> DataFrame:
    from vicinal.operators import build

    return materialize(build.assign(df, centers, 1).select("id", "vec", "cluster_id", F.sqrt("dist_sq").alias("d")), name)


def _near_cells(left: DataFrame, right: DataFrame, centers, r: float) -> DataFrame:
    """(a, b) of cells of left(cluster_id, radius) and right whose members may be within r of each other: the
    centers are no further apart than both radii and r. Both are one row a pivot."""
    spark = left.sparkSession
    other = [(x["cluster_id"], x["radius"]) for x in right.collect()]
    ids, radius = np.array([i for i, _ in other], np.int32), np.array([x for _, x in other])
    shared = spark.sparkContext.broadcast((centers.matrix, ids, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, ids, radius = shared.value
        own = np.einsum("ij,ij->i", matrix, matrix)
        for batch in batches:
            for a, ra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gap = np.sqrt(np.maximum(0, own[a] + own[ids] - 2 * (matrix[ids] @ matrix[a])))
                near = ids[gap <= radius + ra + r + 1e-6 * (1 + gap)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), a, np.int32)), pa.array(near)], names=["a", "b"])

    return left.select("cluster_id", "radius").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "a int, b int")


def _pivot_pairs(left: DataFrame, right: DataFrame, centers, r_sq: float, strict: bool, same: bool, chunk: int) -> DataFrame:
    """(l, r, dist_sq) of placed rows. Chunks of cells meet in tasks; the list of tasks is a table, and no task holds
    more than two chunks."""
    size = lambda df: df.groupBy("cluster_id").agg(F.max("d").alias("radius"), F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    ls = materialize(size(left), "left-cells")
    rs = ls if same else materialize(size(right), "right-cells")
    parts = lambda df, c, n: df.select(F.col("cluster_id").alias(c), F.col("parts").alias(n))
    near = _near_cells(ls, rs, centers, float(np.sqrt(r_sq)))
    near = near.where("a <= b") if same else near
    tasks = near.join(parts(ls, "a", "n"), "a").join(parts(rs, "b", "m"), "b")
    tasks = tasks.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    tasks = (tasks.where("a <> b or p <= q") if same else tasks).select(F.xxhash64("a", "p", "b", "q").alias("task"), "a", "p", "b", "q")
    tasks = materialize(tasks, "tasks")

    def side(df: DataFrame, counts: DataFrame, c: str, p: str, is_left: bool) -> DataFrame:
        cut = df.join(counts.select("cluster_id", "parts"), "cluster_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        plan = tasks.select("task", F.col(c).alias("cluster_id"), F.col(p).alias("part"))
        return cut.join(plan, ["cluster_id", "part"]).select("task", F.lit(is_left).alias("is_left"), "id", "vec")

    dealt = side(left, ls, "a", "p", True).unionByName(side(right, rs, "b", "q", False))
    return dealt.groupBy("task").applyInArrow(_cell_pairs(r_sq, strict, same), "l long, r long, dist_sq double")


def _cell_pairs(r_sq: float, strict: bool, same: bool):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("is_left").to_numpy(zero_copy_only=False)
        ids, rows = table.column("id").to_numpy(), kernels.matrix(table.column("vec"))
        i, j, d = kernels.within_radius(rows[side], rows[~side], r_sq, strict)
        a, b = ids[side][i], ids[~side][j]
        if same:
            # a chunk with itself gives each pair twice; two chunks give it once
            once = a > b if np.array_equal(np.sort(ids[side]), np.sort(ids[~side])) else a != b
            a, b, d = a[once], b[once], d[once]
            a, b = np.maximum(a, b), np.minimum(a, b)
        return pa.table({"l": a, "r": b, "dist_sq": d})

    return run


def pivot_join(base: DataFrame, queries: DataFrame, r_sq: float, strict: bool = False, pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """As range_join, for two tables of any size."""
    from vicinal.operators import build

    b, q = finite(base), finite(queries, "query_id")
    n = b.count()
    if not n:
        return base.sparkSession.createDataFrame([], PAIRS)
    centers = build.stride_seeds(b, pivots or max(1, min(PIVOTS, int(np.sqrt(n) / 2))), n)
    found = _pivot_pairs(_placed(q, centers, "queries"), _placed(b, centers, "base"), centers, r_sq, strict, False, chunk)
    return found.select(F.col("l").alias("query_id"), F.col("r").alias("base_id"), "dist_sq")


def self_join(base: DataFrame, r_sq: float, pivots: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b, dist_sq), a > b, of all pairs strictly within the radius.

    Rows are dealt to their nearest of some pivots; two cells meet unless their centers are further apart
    than both radii and the join's. A cell with more than `chunk` rows is cut, so no task holds more than
    two chunks whatever the spread.
    """
    from vicinal.operators import build

    good = finite(base)
    n = good.count()
    if not n:
        return base.sparkSession.createDataFrame([], "a long, b long, dist_sq double")
    centers = build.stride_seeds(good, pivots or max(1, min(PIVOTS, int(np.sqrt(n) / 2))), n)
    placed = _placed(good, centers, "placed")
    found = _pivot_pairs(placed, placed, centers, r_sq, True, True, chunk)
    return found.select(F.col("l").alias("a"), F.col("r").alias("b"), "dist_sq")


def cluster_pairs(clusters: DataFrame, eps: float) -> DataFrame:
    """(a, b, kept) of cluster pairs a < b: not kept if the centers are at least both radii and eps apart,
    or half their distance is at least a's radius and eps. clusters(cluster_id, vec, radius), a small table."""
    a = clusters.select(F.col("cluster_id").alias("a"), F.col("vec").alias("av"), F.col("radius").alias("ar"))
    b = clusters.select(F.col("cluster_id").alias("b"), F.col("vec").alias("bv"), F.col("radius").alias("br"))
    d = V.l2("av", "bv")
    far = (d >= F.col("ar") + F.col("br") + eps) | (d / 2 >= F.col("ar") + eps)
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(d, 6).alias("dist"), (~far).alias("kept"))
