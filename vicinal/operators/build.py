"""Index build: k-means, assignment, cluster statistics, slabs, local PCA and KD cells.

Centers are a small table by contract (k * dim doubles, checked); everything else is a DataFrame. base(id, vec).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import kernels
from vicinal.plans.shared import materialize, new_path

#: Bytes of a center matrix that may be broadcast; rows of a cluster that one task fits or splits in memory; folders
#: of a stored index's base.
CENTER_BYTES, CLUSTER_ROWS, BANDS = 512 << 20, 200_000, 256
#: Rows of a range of ids in which seeds are ranked; moved ids that the driver holds at a time.
RANGE_ROWS, HELD = 1_000_000, 1_000_000
#: An alternative center is taken below this ratio of squared distances, if its bucket is smaller;
#: the seed of training samples.
TWO_CHOICE, SEED = 1.2, 283


@dataclass
class Centers:
    """Center vectors in order of cluster id, from 0."""

    matrix: np.ndarray

    def __post_init__(self) -> None:
        if self.matrix.nbytes > CENTER_BYTES:
            raise ValueError(f"{self.matrix.nbytes} bytes of centers; {CENTER_BYTES} may be broadcast")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(self.matrix)], "cluster_id int, vec array<double>")


def stride_seeds(base: DataFrame, k: int, n: int | None = None) -> Centers:
    """Rows of rank i * floor(n / k) by id, i < k."""
    n = base.count() if n is None else n
    k = min(k, n)
    if not k:
        return Centers(np.zeros((0, 0)))
    step = n // k
    picked = ranked(base, n).where((F.col("rank") % step == 0) & (F.col("rank") < step * k)).select("id", "rank")
    rows = base.join(F.broadcast(picked), "id").orderBy("rank").select("vec").collect()
    return Centers(np.array([r["vec"] for r in rows], np.float64))


def ranked(base: DataFrame, n: int) -> DataFrame:
    """(id, rank) of n rows, ranks from 0 in order of id. Ids are ranked within ranges, by sampled split points, and
    the ranges' sizes are added: no single task orders all rows."""
    cut = base.select("id").repartitionByRange(max(1, n // RANGE_ROWS), "id").withColumn("p", F.spark_partition_id())
    cut = materialize(cut, "ranges")
    sizes = sorted((r["p"], r["count"]) for r in cut.groupBy("p").count().collect())
    starts = np.cumsum([0, *(c for _, c in sizes)]).tolist()
    before = base.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "p int, before long")
    local = F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    return cut.withColumn("local", local).join(F.broadcast(before), "p").select("id", (F.col("before") + F.col("local")).alias("rank"))


def sample(base: DataFrame, k: int, per_center: int = 10, seed: int = SEED) -> DataFrame:
    """min(n, per_center * k) rows of least seeded hash of their id, in order of id."""
    return base.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(per_center * k).orderBy("id")


def _nearest(centers, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = centers.value
        for batch in batches:
            rows = kernels.matrix(batch.column(1))
            good = np.flatnonzero(np.isfinite(rows).all(axis=1))
            if not len(good):
                continue
            if len(good) < len(rows):
                batch, rows = batch.take(pa.array(good)), rows[good]
            c, d = kernels.nearest(rows, matrix, m)
            n = c.shape[1]
            repeat = np.repeat(np.arange(batch.num_rows), n)
            taken = batch.take(pa.array(repeat))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(c.ravel().astype(np.int32)), pa.array(d.ravel()), pa.array(np.tile(np.arange(1, n + 1), batch.num_rows).astype(np.int32))],
                names=["id", "vec", "cluster_id", "dist_sq", "rank"],
            )

    return run


def assign(base: DataFrame, centers: Centers, m: int = 1) -> DataFrame:
    """(id, vec, cluster_id, dist_sq, rank): the m nearest centers of each row, ties by cluster id; no shuffle."""
    shared = base.sparkSession.sparkContext.broadcast(centers.matrix)
    rows = base.select(F.col("id").cast("long").alias("id"), "vec").where(F.col("vec").isNotNull())
    return rows.mapInArrow(_nearest(shared, m), "id long, vec array<double>, cluster_id int, dist_sq double, rank int")


def two_choice(base: DataFrame, centers: Centers, ratio: float = TWO_CHOICE) -> DataFrame:
    """(id, cluster_id): the nearest center, or the second if its squared distance is below ratio times the
    first's and its bucket is smaller at that point of a scan in order of id. The decision needs all earlier ones,
    so the scan streams 28 bytes a row through the driver, in order; bucket sizes and HELD moved ids at most are
    held there, and go to the shared folder in slices."""
    spark = base.sparkSession
    path, slices = new_path(spark, "moved"), 0
    near = assign(base, centers, 2).select("id", "cluster_id", "dist_sq", "rank")
    wide = near.groupBy("id").agg(
        *(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("cluster_id", "dist_sq"))
    )
    sizes = [0] * len(centers.matrix)
    swapped = []
    for r in wide.orderBy("id").toLocalIterator(prefetchPartitions=True):
        first, second = r["cluster_id1"], r["cluster_id2"]
        if second is not None and r["dist_sq2"] < ratio * r["dist_sq1"] and sizes[second] < sizes[first]:
            swapped.append((r["id"],))
            first = second
        sizes[first] += 1
        if len(swapped) >= HELD:
            spark.createDataFrame(swapped, "id long").write.mode("append").parquet(path)
            swapped, slices = [], slices + 1
    moved = spark.createDataFrame(swapped, "id long")
    if slices:
        moved = moved.unionByName(spark.read.schema("id long").parquet(path))
    moved = moved.withColumn("moved", F.lit(True))
    cluster = F.when(F.col("moved"), F.col("cluster_id2")).otherwise(F.col("cluster_id1"))
    return wide.join(moved, "id", "left").select("id", cluster.alias("cluster_id"))


def balanced(base: DataFrame, centers: Centers) -> DataFrame:
    """(id, cluster_id): rows in order of the gap between their two nearest centers' squared distances, ties by id,
    each to the smaller of the two buckets at that point (the nearer one if equal). The scan is as two_choice's."""
    near = assign(base, centers, 2)
    wide = near.groupBy("id").agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("cluster_id", "dist_sq")))
    order = wide.select("id", "cluster_id1", "cluster_id2", (F.col("dist_sq2") - F.col("dist_sq1")).alias("gap")).orderBy("gap", "id")
    spark, sizes, out = base.sparkSession, [0] * len(centers.matrix), []
    path, slices = new_path(spark, "balanced"), 0
    for r in order.toLocalIterator(prefetchPartitions=True):
        a, b = r["cluster_id1"], r["cluster_id2"]
        c = b if b is not None and sizes[b] < sizes[a] else a
        sizes[c] += 1
        out.append((r["id"], c))
        if len(out) >= HELD:
            spark.createDataFrame(out, "id long, cluster_id int").write.mode("append").parquet(path)
            out, slices = [], slices + 1
    found = spark.createDataFrame(out, "id long, cluster_id int")
    return found.unionByName(spark.read.schema(found.schema).parquet(path)) if slices else found


def lloyd_step(base: DataFrame, centers: Centers) -> tuple[Centers, float]:
    """Means of the rows nearest to each center, and the total loss. Partitions send sums of k * dim doubles,
    which are added up by cluster in a shuffle. An empty cluster splits the largest: its center is copied,
    and both move by 1/1024 in opposite directions, alternating over dimensions."""
    shared = base.sparkSession.sparkContext.broadcast(centers.matrix)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        total, count, loss = np.zeros_like(matrix), np.zeros(len(matrix), np.int64), np.zeros(len(matrix))
        for batch in batches:
            rows = kernels.matrix(batch.column(0))
            if not len(rows):
                continue
            c, d = kernels.nearest(rows, matrix, 1)
            np.add.at(total, c[:, 0], rows)
            np.add.at(count, c[:, 0], 1)
            np.add.at(loss, c[:, 0], d[:, 0])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(loss[some]), pa.array(list(total[some]), pa.list_(pa.float64()))],
            names=["cluster_id", "n", "loss", "total"],
        )

    parts = base.select("vec").where(F.col("vec").isNotNull() & V.is_finite("vec")).mapInArrow(sums, "cluster_id int, n long, loss double, total array<double>")
    dim = centers.matrix.shape[1]
    added = parts.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)))
    matrix, sizes, loss = centers.matrix.copy(), np.zeros(len(centers.matrix)), 0.0
    for r in added.collect():  # one row a center
        sizes[r["cluster_id"]] = r["n"]
        matrix[r["cluster_id"]] = np.array([r[f"t{i}"] for i in range(dim)]) / r["n"]
        loss += r["loss"]
    repair(matrix, sizes)
    return Centers(matrix), loss


def repair(matrix: np.ndarray, sizes: np.ndarray) -> None:
    turn = np.where(np.arange(matrix.shape[1]) % 2, -1.0, 1.0) / 1024
    for empty in np.flatnonzero(sizes == 0):
        big = int(np.argmax(sizes))
        if sizes[big] < 2:
            return
        matrix[empty] = matrix[big] * (1 - turn)
        matrix[big] *= 1 + turn
        sizes[empty], sizes[big] = sizes[big] // 2, sizes[big] - sizes[big] // 2


def kmeans(base: DataFrame, k: int, iterations: int = 5, per_center: int = 10) -> Centers:
    """Lloyd's iterations from stride seeds over a seeded sample."""
    training = materialize(sample(base.select("id", "vec"), k, per_center), "training")
    centers = stride_seeds(training, k)
    for _ in range(iterations):
        centers, _ = lloyd_step(training, centers)
    return centers


def anisotropic_step(base: DataFrame, centers: Centers, eta: float) -> tuple[Centers, float]:
    """One iteration under the anisotropic loss for unit vectors: assignment by least loss, then the center c
    that solves (n I + (eta - 1) sum x x' / (|x|^2 + 1e-12)) c = eta sum x. Partitions send one dim x dim
    matrix a center that they met, in slices of a row each."""
    shared = base.sparkSession.sparkContext.broadcast(centers.matrix)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        held: dict[int, list] = {}
        for batch in batches:
            rows = kernels.matrix(batch.column(0))
            for at in range(0, len(rows), 1024):
                x = rows[at : at + 1024]
                own = np.einsum("ij,ij->i", x, x)
                cross = x @ matrix.T
                r_sq = own[:, None] + np.einsum("ij,ij->i", matrix, matrix)[None] - 2 * cross
                along = (own[:, None] - cross) ** 2 / (own[:, None] + 1e-12)
                loss = eta * along + np.maximum(0, r_sq - along)
                best = loss.argmin(axis=1)
                for c in np.unique(best).tolist():
                    mine = x[best == c]
                    w = mine / (np.einsum("ij,ij->i", mine, mine) + 1e-12)[:, None]
                    h = held.setdefault(c, [0, 0.0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)])
                    h[0], h[1], h[2], h[3] = h[0] + len(mine), h[1] + loss[best == c, c].sum(), h[2] + mine.sum(axis=0), h[3] + w.T @ mine
        ids = list(held)
        columns = [pa.array(ids, pa.int32()), pa.array([held[c][0] for c in ids], pa.int64()), pa.array([held[c][1] for c in ids], pa.float64())]
        flat = [np.concatenate([held[c][2], held[c][3].ravel()]) for c in ids]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(flat, pa.list_(pa.float64()))], names=["cluster_id", "n", "loss", "total"])

    def solve(table: pa.Table) -> pa.Table:
        n, total = sum(table.column("n").to_pylist()), kernels.matrix(table.column("total")).sum(axis=0)
        dim = centers_dim
        c = np.linalg.solve(n * np.eye(dim) + (eta - 1) * total[dim:].reshape(dim, dim), eta * total[:dim])
        return pa.table({"cluster_id": table.column("cluster_id")[:1], "n": [n], "loss": [sum(table.column("loss").to_pylist())], "vec": [c.tolist()]})

    centers_dim = centers.matrix.shape[1]
    parts = base.select("vec").where(V.is_finite("vec")).mapInArrow(sums, "cluster_id int, n long, loss double, total array<double>")
    solved = parts.groupBy("cluster_id").applyInArrow(solve, "cluster_id int, n long, loss double, vec array<double>")
    matrix, sizes, loss = centers.matrix.copy(), np.zeros(len(centers.matrix)), 0.0
    for r in solved.collect():
        matrix[r["cluster_id"]], sizes[r["cluster_id"]] = r["vec"], r["n"]
        loss += r["loss"]
    repair(matrix, sizes)
    return Centers(matrix), loss


def anisotropic_kmeans(base: DataFrame, k: int, eta: float, iterations: int = 5, per_center: int = 10) -> Centers:
    """As kmeans; vectors must have norms in [0.95, 1.05]."""
    off = base.where(~V.norm("vec").between(0.95, 1.05)).limit(1).count()
    if off:
        raise ValueError("anisotropic training takes unit vectors")
    training = materialize(sample(base.select("id", "vec"), k, per_center), "training")
    centers = stride_seeds(training, k)
    for _ in range(iterations):
        centers, _ = anisotropic_step(training, centers, eta)
    return centers


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n, radius) of assigned(cluster_id, dist_sq)."""
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt("dist_sq")).alias("radius"))


def offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """sizes with the running total before each row, in order of key; sizes is one row a cluster or cell."""
    by = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.withColumn("offset", F.sum(size).over(by) - F.col(size))


def center_neighbours(centers: Centers, m: int, spark: SparkSession) -> DataFrame:
    """(cluster_id, neighbour_id, dist_sq, slot): the m nearest other centers, ties by id, slots from 0."""
    k = len(centers.matrix)
    if not 0 <= m < k:
        raise ValueError("fewer neighbours than centers are needed")
    shared = spark.sparkContext.broadcast(centers.matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                ids, d = _others(shared.value, i, m)
                columns = [pa.array(np.full(len(ids), i, np.int32)), pa.array(ids.astype(np.int32)), pa.array(d), pa.array(np.arange(len(ids), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["cluster_id", "neighbour_id", "dist_sq", "slot"])

    tasks = spark.range(0, k, 1, max(1, min(k, spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int"))
    found = materialize(tasks.mapInArrow(run, "cluster_id int, neighbour_id int, dist_sq double, slot int"), "neighbours")
    if same := found.where("dist_sq < 1e-18").select("cluster_id").head(1):
        raise ValueError(f"center {same[0][0]} coincides with another")
    return found


def _others(matrix: np.ndarray, i: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest other rows of row i, and their squared distances."""
    c, d = kernels.nearest(matrix[i : i + 1], matrix, min(len(matrix), m + 1))
    keep = np.flatnonzero(c[0] != i)[:m]
    return c[0][keep], d[0][keep]


def slabs(assigned: DataFrame, centers: Centers, m: int) -> DataFrame:
    """(cluster_id, neighbour_id, norm, lo, hi, slot): for each cluster and near center, the interval of the
    members' positions along the direction between the two centers, measured from the own one, padded for
    rounding; an empty cluster has (+inf, -inf). Members are projected where they are; only bounds are shuffled."""
    spark = assigned.sparkSession
    near = center_neighbours(centers, m, spark)
    shared = spark.sparkContext.broadcast(centers.matrix)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, held = shared.value, {}  # cluster -> its directions, lowest and highest positions, longest member
        for batch in batches:
            c, x = batch.column(0).to_numpy(), kernels.matrix(batch.column(1))
            for i in np.unique(c).tolist():
                mine = x[c == i]
                if i not in held:
                    u = matrix[_others(matrix, i, m)[0]] - matrix[i]
                    u /= np.sqrt((u * u).sum(axis=1))[:, None]
                    held[i] = [u, np.full(len(u), np.inf), np.full(len(u), -np.inf), 0.0]
                u, lo, hi, top = held[i]
                p = mine @ u.T - (u @ matrix[i])[None]
                held[i][1:] = [np.minimum(lo, p.min(axis=0)), np.maximum(hi, p.max(axis=0)), max(top, np.sqrt(np.einsum("ij,ij->i", mine, mine)).max())]
        for i, (u, lo, hi, top) in held.items():
            n = len(u)
            columns = [pa.array(np.full(n, i, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(lo), pa.array(hi), pa.array(np.full(n, float(top)))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster_id", "slot", "lo", "hi", "top"])

    dim = centers.matrix.shape[1]
    found = assigned.select("cluster_id", "vec").mapInArrow(bounds, "cluster_id int, slot int, lo double, hi double, top double")
    found = found.groupBy("cluster_id", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"))
    pad = F.lit(4 * dim * 5.96e-8 * 2**-29) * F.greatest("top", F.lit(1.0))  # as for single precision, scaled to double
    joined = near.join(found, ["cluster_id", "slot"], "left")
    return joined.select(
        "cluster_id", "neighbour_id", F.sqrt("dist_sq").alias("norm"),
        F.coalesce(F.col("lo") - pad, F.lit(math.inf)).alias("lo"), F.coalesce(F.col("hi") + pad, F.lit(-math.inf)).alias("hi"), "slot",
    )


def center_products(queries: DataFrame, centers: Centers, wanted: DataFrame) -> DataFrame:
    """(query_id, cluster_id, dot) of the inner products of queries with those centers alone that wanted(query_id,
    cluster_id) names, such as candidate clusters and their slabs' neighbours; repeats count once."""
    shared = queries.sparkSession.sparkContext.broadcast(centers.matrix)
    lists = wanted.groupBy("query_id").agg(F.sort_array(F.collect_set("cluster_id")).alias("wanted"))  # k numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, q, ids in zip(batch.column(0).to_pylist(), kernels.matrix(batch.column(1)), batch.column(2), strict=True):
                ids = np.asarray(ids.values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids), pa.array(shared.value[ids] @ q)], names=["query_id", "cluster_id", "dot"])

    return queries.select("query_id", "vec").join(lists, "query_id").mapInArrow(run, "query_id long, cluster_id int, dot double")


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole numbers from -127 to 127, scale of each row): rows over their largest magnitude, rounded to the
    nearest, halves away from zero."""
    scale = np.abs(rows).max(axis=1, initial=0) / 127
    x = rows / np.where(scale > 0, scale, 1)[:, None]
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int32), scale


def quantised_products(queries: DataFrame, centers: Centers) -> DataFrame:
    """(query_id, cluster_id, dot): inner products of queries and all centers, each quantised to a byte a
    component by its own scale: whole-number products, rescaled."""
    shared = queries.sparkSession.sparkContext.broadcast(quantised(centers.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, c_scale = shared.value
        for batch in batches:
            q, scale = quantised(kernels.matrix(batch.column(1)))
            dot = (q @ c.T) * scale[:, None] * c_scale[None]
            n, k = dot.shape
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(dot.ravel())], names=["query_id", "cluster_id", "dot"])

    return queries.select("query_id", "vec").mapInArrow(run, "query_id long, cluster_id int, dot double")


def slab_order(slab: DataFrame) -> DataFrame:
    """slab with `tightness`: rank within the cluster by width, ties by slot."""
    by = Window.partitionBy("cluster_id").orderBy(F.col("hi") - F.col("lo"), "slot")
    return slab.withColumn("tightness", F.row_number().over(by))


@dataclass
class LocalPca:
    """A cluster's basis (rank x dim), possibly of rank 0."""

    basis: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray, center: np.ndarray, rank: int) -> LocalPca:
        x = rows - center
        rank = min(rank, *x.shape)
        if rank < 1 or len(x) < 2:
            return LocalPca(np.zeros((0, x.shape[1])))
        value, vector = np.linalg.eigh(x.T @ x)
        keep = [i for i in range(len(value) - 1, len(value) - 1 - rank, -1) if value[i] > max(value[-1], 0) * 1e-12 and value[i] > 0]
        return LocalPca(vector[:, keep].T.copy())

    def project(self, rows: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates, and the length of what they leave."""
        x = rows - center
        t = x @ self.basis.T
        return t, np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", t, t)))


def kd_cells(t: np.ndarray, target: int) -> np.ndarray:
    """Cell numbers from median splits of coordinates, axis = depth mod rank, values up to the median left."""
    cell = np.zeros(len(t), np.int64)
    if not t.shape[1] or len(t) <= target:
        return cell
    deepest, count = math.ceil(math.log2(len(t) / target)), 1
    todo = [(np.arange(len(t)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= target or depth >= deepest:
            continue
        x = t[rows, depth % t.shape[1]]
        left = x <= np.median(x)
        if left.all() or not left.any():
            continue
        cell[rows[~left]] = count
        count += 1
        todo += [(rows[left], depth + 1), (rows[~left], depth + 1)]
    return cell


LAID_OUT = (
    "kind string, cluster_id int, part int, cell_id long, id long, vec array<double>, dist_sq double, n long,"
    " basis array<array<double>>, lo array<double>, hi array<double>, res_lo double, res_hi double"
)


def lay_out(assigned: DataFrame, centers: Centers, pca_rank: int = 32, target: int = 24) -> DataFrame:
    """The base in clusters and cells: rows of three kinds, from one pass over the shuffled base.

    member: id, vec, dist_sq, cell_id. cell: n, and its bounds lo, hi, res_lo, res_hi in the cluster's local PCA.
    model: n, basis and the cluster's own bounds lo, hi, res_hi. A cluster is fitted in one task; one of more
    than CLUSTER_ROWS rows is cut by a hash of the id into parts, each with a model and cells of its own."""
    shared = assigned.sparkSession.sparkContext.broadcast(centers.matrix)
    schema = _laid_out_schema()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c, part = (k.as_py() for k in key)
        ids, center = table.column("id").to_numpy(), shared.value[c]
        order = np.argsort(ids, kind="stable")
        ids, rows, dist = ids[order], kernels.matrix(table.column("vec"))[order], table.column("dist_sq").to_numpy()[order]
        pca = LocalPca.fit(rows, center, pca_rank)
        t, res = pca.project(rows, center)
        cell, n = kd_cells(t, target), len(ids)
        own = (part << 32) + cell
        # in order of cell, then id
        order = np.lexsort((ids, cell))
        base = {"cluster_id": [c], "part": [part]}
        out = [_rows(schema, n, kind="member", **base, cell_id=own[order], id=ids[order], vec=pa.array(list(rows[order]), pa.list_(pa.float64())), dist_sq=dist[order])]
        for i in np.unique(cell).tolist():
            m = cell == i
            bounds = {"lo": [t[m].min(axis=0).tolist()], "hi": [t[m].max(axis=0).tolist()], "res_lo": [float(res[m].min())], "res_hi": [float(res[m].max())]}
            out.append(_rows(schema, 1, kind="cell", **base, cell_id=[(part << 32) + i], n=[int(m.sum())], **bounds))
        whole = {"lo": [t.min(axis=0).tolist()], "hi": [t.max(axis=0).tolist()], "res_hi": [float(res.max())]}
        out.append(_rows(schema, 1, kind="model", **base, n=[n], basis=[pca.basis.tolist()], **whole))
        return pa.concat_tables(out)

    parts = assigned.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_ROWS).alias("parts"))
    cut = assigned.select("id", "vec", "cluster_id", "dist_sq").join(F.broadcast(parts), "cluster_id")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    return cut.groupBy("cluster_id", "part").applyInArrow(run, LAID_OUT)


def _rows(schema: pa.Schema, count: int, kind: str, **columns) -> pa.Table:
    """Some rows of a kind; a column of one value holds it throughout, a missing one is null."""
    out = []
    for f in schema:
        v = [kind] if f.name == "kind" else columns.get(f.name)
        v = pa.nulls(count, f.type) if v is None else v if isinstance(v, pa.Array) else pa.array(list(v) * count if len(v) == 1 and count > 1 else v, f.type)
        out.append(v)
    return pa.Table.from_arrays(out, schema=schema)


def _laid_out_schema() -> pa.Schema:
    f, l = pa.float64(), pa.list_
    return pa.schema(
        [("kind", pa.string()), ("cluster_id", pa.int32()), ("part", pa.int32()), ("cell_id", pa.int64()), ("id", pa.int64()), ("vec", l(f)), ("dist_sq", f),
         ("n", pa.int64()), ("basis", l(l(f))), ("lo", l(f)), ("hi", l(f)), ("res_lo", f), ("res_hi", f)]
    )


def kinds(laid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, cells and models of lay_out()'s rows."""
    of = lambda kind, *columns: laid.where(F.col("kind") == kind).select("cluster_id", *columns)
    return (
        of("member", "part", "cell_id", "id", "vec", "dist_sq"),
        of("cell", "part", "cell_id", "n", "lo", "hi", "res_lo", "res_hi"),
        of("model", "part", "n", "basis", "lo", "hi", "res_hi"),
    )


#: Of the tables of a stored index.
SCHEMA_VERSION = 7
