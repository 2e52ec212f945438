"""Range search through clusters and cells: bounds reject what cannot hold a hit, the rest is read and compared.

With every cluster a candidate, alpha 1 and no code filter the result equals the plain range join. Pruning uses
eps = r / alpha; the distance test always uses r. Each stage sees what the stages before it kept: prescreen and
slab are rows of (query, cluster), the PCA box of a cluster meets those that are left, cells those that are left
then, and only cells that are left meet base rows, in tasks of bounded size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import build, codes, kernels, tasks
from vicinal.plans.shared import materialize

STAGES = ("prescreen", "slab", "pca", "cell")
#: Absolute slack of a bound in double precision; slices of a part of a cluster at most.
SLACK, PART_SLICES = 1e-9, 4096


@dataclass
class Index:
    """centers; members(cluster_id, part, cell_id, id, vec, dist_sq), cells and models as lay_out() makes them;
    stats(cluster_id, n, radius, n_cells); slabs and codes, if the index has them."""

    centers: build.Centers
    members: DataFrame
    cells: DataFrame
    models: DataFrame
    stats: DataFrame
    slabs: DataFrame | None = None
    codes: DataFrame | None = None
    meta: dict = field(default_factory=dict)


@dataclass
class Options:
    alpha: float = 1.0
    n_candidates: int | None = None
    stages: tuple[str, ...] = field(default=STAGES)
    #: Whether codes reject rows ("rows") or whole cells ("cells") before vectors are read; no hit is lost.
    code_filter: str | None = None

    def __post_init__(self) -> None:
        if not (np.isfinite(self.alpha) and self.alpha >= 1):
            raise ValueError("alpha is finite and at least 1")
        if unknown := set(self.stages) - set(STAGES):
            raise ValueError(f"no such stages: {sorted(unknown)}")
        if self.code_filter not in (None, "rows", "cells"):
            raise ValueError("code_filter is rows or cells")


def build_index(
    base: DataFrame, centers: build.Centers, slab_count: int = 8, pca_rank: int = 32, target_cell_vecs: int = 24, with_codes: bool = False, normalize: bool = False, assigned: DataFrame | None = None
) -> Index:
    """An index of base(id, vec). normalize: vectors are scaled to length 1 first (centers are taken as they are);
    assigned(id, vec, cluster_id, dist_sq) replaces the assignment to the nearest center."""
    if target_cell_vecs < 2:
        raise ValueError("a cell has at least two vectors")
    if normalize:
        base = base.withColumn("vec", V.normalize("vec"))
    assigned = build.assign(base, centers).drop("rank") if assigned is None else assigned
    laid = materialize(build.lay_out(assigned, centers, pca_rank, target_cell_vecs), "laid-out", partition_by="kind")
    members, cells, models = build.kinds(laid)
    counts = cells.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_cells"))
    stats = materialize(build.cluster_stats(members).join(counts, "cluster_id"), "stats")
    slab = materialize(build.slabs(members, centers, slab_count), "slabs") if slab_count else None
    code = materialize(codes.one_bit_codes(members, centers), "codes") if with_codes else None
    return Index(centers, members, cells, models, stats, slab, code, {"dim": int(centers.matrix.shape[1]), "k": len(centers.matrix), "slab_count": slab_count, "pca_rank": pca_rank, "target_cell_vecs": target_cell_vecs, "normalize": normalize})


def write_index(index: Index, path: str) -> None:
    """The index as Parquet tables: base (in at most BANDS folders of clusters, sorted by cluster, cell and id, so
    that readers skip what they don't want), cells, models, clusters with centers, slabs, codes and one row of
    metadata, written last."""
    spark = index.members.sparkSession
    k = len(index.centers.matrix)
    width = max(1, -(-k // build.BANDS))
    band = F.floor(F.col("cluster_id") / width).cast("int")

    def write(df: DataFrame, name: str, *order: str) -> None:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = df.withColumn("band", band).write if name in ("base", "codes") else df.write
        (writer.partitionBy("band") if name in ("base", "codes") else writer).mode("overwrite").parquet(f"{path}/{name}")

    write(index.members, "base", "cluster_id", "cell_id", "id")
    write(index.cells, "cells", "cluster_id", "cell_id")
    write(index.models, "models", "cluster_id", "part")
    write(index.centers.table(spark).withColumnRenamed("vec", "center").join(index.stats, "cluster_id", "left"), "clusters", "cluster_id")
    if index.slabs is not None:
        write(index.slabs, "slabs", "cluster_id", "slot")
    if index.codes is not None:
        write(index.codes, "codes", "cluster_id", "cell_id", "id")
    meta = index.meta | {"k": k, "width": width, "slabs": index.slabs is not None, "codes": index.codes is not None}
    spark.createDataFrame([(build.SCHEMA_VERSION, json.dumps(meta))], "schema_version int, options string").coalesce(1).write.mode("overwrite").parquet(f"{path}/index_meta")


def load_index(spark: SparkSession, path: str) -> Index:
    """A stored index. Its centers (bounded by contract) come to the driver; a wrong version is an error."""
    version, options = spark.read.parquet(f"{path}/index_meta").select("schema_version", "options").first()
    if version != build.SCHEMA_VERSION:
        raise ValueError(f"index schema version {version}, not {build.SCHEMA_VERSION}")
    meta = json.loads(options)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    clusters = read("clusters")
    rows = clusters.select("cluster_id", "center").orderBy("cluster_id").collect()
    if [r["cluster_id"] for r in rows] != list(range(meta["k"])):
        raise ValueError("clusters are not numbered from 0")
    stats = clusters.where("n is not null").select("cluster_id", "n", "radius", "n_cells")
    slabs = read("slabs") if meta["slabs"] else None
    return Index(build.Centers(np.array([r["center"] for r in rows], np.float64)), read("base"), read("cells"), read("models"), stats, slabs, read("codes") if meta["codes"] else None, meta)


def check_index(spark: SparkSession, path: str) -> DataFrame:
    """(what, cluster_id) that is wrong with an index on disk; empty if nothing is."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    meta, base, clusters, cell, model = (read(t) for t in ("index_meta", "base", "clusters", "cells", "models"))
    k = clusters.count()
    none = F.lit(None).cast("int")
    per_cell = base.groupBy("cluster_id", "cell_id").agg(F.count(F.lit(1)).alias("rows")).join(cell.select("cluster_id", "cell_id", "n"), ["cluster_id", "cell_id"], "full")
    sizes = base.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("rows")).join(clusters.select("cluster_id", "n"), "cluster_id", "full")
    models = model.groupBy("cluster_id").agg(F.sum("n").alias("m")).join(clusters.select("cluster_id", "n"), "cluster_id", "full")
    crossed = F.exists(F.zip_with("lo", "hi", lambda a, b: a > b), lambda x: x)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = [
        (meta.where(F.col("schema_version") != build.SCHEMA_VERSION).select(none.alias("cluster_id")), "schema version"),
        (sizes.where(zero("n") != zero("rows")), "cluster size"),
        (per_cell.where(zero("n") != zero("rows")), "cell size"),
        (models.where(zero("n") != zero("m")), "model size"),
        (cell.where(crossed | (F.col("res_lo") > F.col("res_hi"))), "cell bounds"),
        (model.where(crossed), "cluster bounds"),
        (base.where(~F.col("cluster_id").between(0, k - 1)), "cluster number"),
        (base.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.min("cluster_id").alias("cluster_id")).where("times > 1"), "repeated id"),
    ]
    out = None
    for df, what in parts:
        found = df.select(F.lit(what).alias("what"), F.col("cluster_id").cast("int")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def candidates(index: Index, queries: DataFrame, options: Options) -> DataFrame:
    """(query_id, vec, cluster_id, dist_sq): the nearest n_candidates centers of each query, or all."""
    k = len(index.centers.matrix)
    m = min(options.n_candidates or k, k)
    return build.assign(queries.select(F.col("query_id").alias("id"), "vec"), index.centers, m).select(F.col("id").alias("query_id"), "vec", "cluster_id", "dist_sq")


def prescreen(found: DataFrame, stats: DataFrame, eps: float) -> DataFrame:
    """found with `pre_kept`: the query's distance to the center is at most eps and the radius."""
    joined = found.join(stats.select("cluster_id", "radius", "n", "n_cells"), "cluster_id")
    return joined.withColumn("pre_kept", F.col("dist_sq") <= (F.col("radius") + eps) * (F.col("radius") + eps) + SLACK)


def with_slab_bounds(found: DataFrame, index: Index) -> DataFrame:
    """found(.., vec, cluster_id) with slab_lb: how far outside the widest-missed slab of the cluster the query is. The
    slabs of a cluster meet its queries as one row."""
    c = index.centers.table(found.sparkSession)
    own = c.select("cluster_id", F.col("vec").alias("cv"))
    other = c.select(F.col("cluster_id").alias("neighbour_id"), F.col("vec").alias("nv"))
    u = F.zip_with("nv", "cv", lambda x, y: x - y)
    directions = index.slabs.join(own, "cluster_id").join(other, "neighbour_id").select("cluster_id", F.struct("norm", "lo", "hi", u.alias("u"), V.dot(u, F.col("cv")).alias("at")).alias("s"))
    slabs = directions.groupBy("cluster_id").agg(F.collect_list("s").alias("slabs"))

    def gap(s):
        p = (V.dot(F.col("vec"), s["u"]) - s["at"]) / s["norm"]
        return F.greatest(F.lit(0.0), s["lo"] - p, p - s["hi"])

    return found.join(slabs, "cluster_id").withColumn("slab_lb", F.array_max(F.transform("slabs", gap))).drop("slabs")


def slab_bounds(found: DataFrame, index: Index) -> DataFrame:
    """(query_id, cluster_id, slab_lb)."""
    return with_slab_bounds(found, index).select("query_id", "cluster_id", "slab_lb")


def _outside(t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of points to boxes, row by row."""
    gap = np.maximum(0, np.maximum(lo - t, t - hi))
    return np.einsum("ij,ij->i", gap, gap)


def _lists(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length of a list column, as (row numbers, matrix)."""
    column = column.combine_chunks()
    length = np.asarray(pa.compute.list_value_length(column))
    starts, flat = np.r_[0, np.cumsum(length)], column.flatten().to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        out.append((rows, flat[starts[rows][:, None] + np.arange(n)]))
    return out


def box_bounds(found: DataFrame, index: Index) -> DataFrame:
    """(query_id, cluster_id, part, n, t, res, pca_lb): the query in the local PCA of each of its clusters (t, and
    the length res of what it leaves), and a lower bound of its distance to all in it. A model travels with each
    (query, cluster) that is left."""
    shared = found.sparkSession.sparkContext.broadcast(index.centers.matrix)
    joined = found.select("query_id", "vec", "cluster_id").join(index.models, "cluster_id")
    schema = "query_id long, cluster_id int, part int, n long, t array<double>, res double, pca_lb double"

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            q, c, part = kernels.matrix(table.column("vec")), table.column("cluster_id").to_numpy(), table.column("part").to_numpy()
            res_hi, basis, lo, hi = table.column("res_hi").to_numpy(), table.column("basis"), table.column("lo"), table.column("hi")
            t_out, res, lb = [None] * len(q), np.zeros(len(q)), np.zeros(len(q))
            _, first, group = np.unique(np.stack([c, part]), axis=1, return_index=True, return_inverse=True)
            for g, i in enumerate(first.tolist()):
                rows = np.flatnonzero(group.ravel() == g)
                b = np.array(basis[i].as_py(), np.float64).reshape(-1, q.shape[1])
                x = q[rows] - shared.value[c[i]]
                t = x @ b.T
                res[rows] = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", t, t)))
                box = _outside(t, np.array(lo[i].as_py())[None], np.array(hi[i].as_py())[None])
                lb[rows] = np.sqrt(box + np.maximum(0, res[rows] - res_hi[i]) ** 2)
                for r, values in zip(rows.tolist(), t, strict=True):
                    t_out[r] = values
            columns = [batch.column(x) for x in ("query_id", "cluster_id", "part", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(t_out, pa.list_(pa.float64())), pa.array(res), pa.array(lb)], names=["query_id", "cluster_id", "part", "n", "t", "res", "pca_lb"])

    return joined.mapInArrow(run, schema)


def cell_bounds(boxed: DataFrame, index: Index) -> DataFrame:
    """(query_id, cluster_id, cell_id, n, cell_lb): lower bounds of the distance to anything in a cell, for the
    cells of clusters that are left. Nothing of a cell but its bounds travels."""
    joined = boxed.select("query_id", "cluster_id", "part", "t", "res").join(index.cells, ["cluster_id", "part"])
    schema = "query_id long, cluster_id int, cell_id long, n long, cell_lb double"

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            res, res_lo, res_hi = (table.column(x).to_numpy() for x in ("res", "res_lo", "res_hi"))
            lb = np.maximum(0, np.maximum(res_lo - res, res - res_hi)) ** 2
            for (rows, t), (_, lo), (_, hi) in zip(*(_lists(table.column(x)) for x in ("t", "lo", "hi")), strict=True):
                lb[rows] += _outside(t, lo, hi)
            columns = [batch.column(x) for x in ("query_id", "cluster_id", "cell_id", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.sqrt(lb))], names=["query_id", "cluster_id", "cell_id", "n", "cell_lb"])

    return joined.mapInArrow(run, schema)


def cell_lists(boxed: DataFrame, index: Index, limit: float) -> DataFrame:
    """(query_id, cluster_id, slice, cells, n): the cells whose bounds are at most limit, a row a slice of a cluster, and
    how many vectors they hold. The cells of a part, in slices of about CHUNK rows by number, meet its queries in
    tasks of STEP queries; no row stands for a query and a cell."""
    key, step = ["cluster_id", "part"], tasks.STEP
    chunks = F.broadcast(boxed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / step).cast("int").alias("chunks")))  # a row a part
    null = lambda c, kind="double": F.lit(None).cast(kind).alias(c)
    own = ("lo", "hi", "res_lo", "res_hi")
    asked = boxed.join(chunks, key).select(*key, F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), F.col("query_id").alias("id"), "t", "res", null("n", "long"), *(null(c, "array<double>" if c in ("lo", "hi") else "double") for c in own))
    cells = index.cells.join(chunks, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("cell_id").cast("long").alias("id"), null("t", "array<double>"), null("res"), "n", *own)

    def run(table: pa.Table) -> pa.Table:
        cluster, part = table.column("cluster_id")[0].as_py(), table.column("part")[0].as_py()
        is_cell = pa.compute.is_valid(table.column("n"))
        q, c = table.filter(pa.compute.invert(is_cell)), table.filter(is_cell)
        c = c.take(pa.array(np.argsort(c.column("id").to_numpy(), kind="stable")))
        asked, names, n, res = q.column("id").to_numpy(), c.column("id").to_numpy(), c.column("n").to_numpy(), q.column("res").to_numpy()
        t, lo, hi = kernels.matrix(q.column("t")), kernels.matrix(c.column("lo")), kernels.matrix(c.column("hi"))
        lb = np.maximum(0, np.maximum(c.column("res_lo").to_numpy()[None] - res[:, None], res[:, None] - c.column("res_hi").to_numpy()[None])) ** 2
        for k in range(t.shape[1]):
            lb += np.maximum(0, np.maximum(lo[None, :, k] - t[:, k, None], t[:, k, None] - hi[None, :, k])) ** 2
        i, j = np.nonzero(~(np.sqrt(lb) > limit))
        cut = np.minimum((np.cumsum(n) - n) // tasks.CHUNK, PART_SLICES - 1)
        start = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(cut[j]) != 0)]) if len(i) else i
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(i)], pa.int32()), pa.array(names[j], pa.int64()))
        held = np.add.reduceat(n[j], start) if len(i) else n[:0]
        columns = [pa.array(asked[i[start]]), pa.array(np.full(len(start), cluster, np.int32)), pa.array((part * PART_SLICES + cut[j[start]]).astype(np.int32)), lists, pa.array(held)]
        return pa.table(columns, names=["query_id", "cluster_id", "slice", "cells", "n"])

    return asked.unionByName(cells).groupBy(*key, "chunk").applyInArrow(run, "query_id long, cluster_id int, slice int, cells array<bigint>, n long")


@dataclass
class Search:
    """What each stage of a search saw: clusters(query_id, vec, cluster_id, n, n_cells, stage), with the stage that
    rejected them or null, and cells(query_id, cluster_id, cell_id, n, stage) of those that no stage rejected, or what
    cell_lists() makes of them."""

    clusters: DataFrame
    cells: DataFrame


def _candidates(index: Index, queries: DataFrame, options: Options, eps: float) -> DataFrame:
    """Candidate clusters with `stage`, after prescreen and slab."""
    on = set(options.stages)
    found = prescreen(candidates(index, queries, options), index.stats, eps)
    none = F.lit(None).cast("string")
    found = found.withColumn("stage", F.when(~F.col("pre_kept"), F.lit("prescreen")) if "prescreen" in on else none)
    found = found.select("query_id", "vec", "cluster_id", "n", "n_cells", "stage")
    if "slab" not in on or index.slabs is None:
        return found
    left = with_slab_bounds(found.where(F.col("stage").isNull()), index)
    left = left.withColumn("stage", F.when(F.col("slab_lb") > eps + SLACK, F.lit("slab"))).drop("slab_lb")
    return left.unionByName(found.where(F.col("stage").isNotNull())) if "prescreen" in on else left


def prune(index: Index, queries: DataFrame, r_sq: float, options: Options | None = None, account: bool = True) -> Search:
    """The stages in turn, with an account of what each rejected. Rejected rows go no further; what several readers
    of the account need is written once. Without an account of cells, the cell stage gives lists of those it leaves."""
    options = options or Options()
    eps = float(np.sqrt(r_sq)) / options.alpha
    on, limit = set(options.stages), eps + SLACK
    left = lambda df: df.where(F.col("stage").isNull())
    found = materialize(_candidates(index, queries, options, eps), "clusters")
    if not on & {"pca", "cell"}:
        cells = left(found).select("query_id", "cluster_id").join(index.cells.select("cluster_id", "cell_id", "n"), "cluster_id")
        return Search(found, cells.withColumn("stage", F.lit(None).cast("string")))
    boxed = materialize(box_bounds(left(found), index), "boxes")
    if "pca" in on:
        # a cluster in parts is rejected if all of them are
        missed = boxed.groupBy("query_id", "cluster_id").agg(F.min("pca_lb").alias("lb")).where(F.col("lb") > limit)
        missed = missed.select("query_id", "cluster_id", F.lit("pca").alias("missed"))
        found = found.join(missed, ["query_id", "cluster_id"], "left").withColumn("stage", F.coalesce("stage", "missed")).drop("missed")
        boxed = boxed.join(missed, ["query_id", "cluster_id"], "left_anti")
    if "cell" not in on:
        cells = boxed.select("query_id", "cluster_id", "part").join(index.cells.select("cluster_id", "part", "cell_id", "n"), ["cluster_id", "part"]).drop("part")
        return Search(found, cells.withColumn("stage", F.lit(None).cast("string")))
    if not account:
        return Search(found, materialize(cell_lists(boxed, index, limit), "cells"))
    stage = F.when(F.col("cell_lb") > limit, F.lit("cell"))
    return Search(found, materialize(cell_bounds(boxed, index).withColumn("stage", stage).drop("cell_lb"), "cells"))


def surviving_cells(index: Index, queries: DataFrame, r_sq: float, options: Options | None = None) -> DataFrame:
    """(query_id, cluster_id, cell_id) that no stage rejects: as prune, in one plan without an account."""
    options = options or Options()
    eps = float(np.sqrt(r_sq)) / options.alpha
    on, limit = set(options.stages), eps + SLACK
    found = _candidates(index, queries, options, eps).where(F.col("stage").isNull())
    if not on & {"pca", "cell"}:
        return found.select("query_id", "cluster_id").join(index.cells.select("cluster_id", "cell_id"), "cluster_id")
    boxed = box_bounds(found, index)
    if "pca" in on:
        boxed = boxed.where(F.col("pca_lb") <= limit)
    if "cell" not in on:
        return boxed.select("query_id", "cluster_id", "part").join(index.cells.select("cluster_id", "part", "cell_id"), ["cluster_id", "part"]).drop("part")
    return cell_bounds(boxed, index).where(F.col("cell_lb") <= limit).select("query_id", "cluster_id", "cell_id")


def decisions(search: Search) -> DataFrame:
    """(query_id, cluster_id, stage, cells, vecs): cells and vectors of each candidate cluster by the stage that
    rejected them; stage is null for those that are read."""
    clusters = search.clusters.where(F.col("stage").isNotNull()).select("query_id", "cluster_id", "stage", F.col("n_cells").alias("cells"), F.col("n").alias("vecs"))
    cells = search.cells.groupBy("query_id", "cluster_id", "stage").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("vecs"))
    return clusters.unionByName(cells)


def hits(index: Index, read: DataFrame, queries: DataFrame, r_sq: float, options: Options | None = None) -> DataFrame:
    """(query_id, base_id, dist_sq) from the cells of read(query_id, cluster_id, cell_id), or of lists of cells."""
    options = options or Options()
    dealt = tasks.deal(read, queries, index.stats, index.cells)
    wanted = dealt.wanted()
    if options.code_filter:
        if index.codes is None:
            raise ValueError("the index has no codes")
        wanted = materialize(codes.filtered(index.codes, index.centers, dealt, r_sq, options.code_filter), "kept")
    rows = dealt.rows(index.members.select("cluster_id", F.col("cell_id").cast("long").alias("cell_id"), "id", "vec"), wanted)
    return dealt.meet(rows, tasks.pairs(r_sq), "query_id long, base_id long, dist_sq double")


def range_search(index: Index, queries: DataFrame, r_sq: float, options: Options | None = None) -> DataFrame:
    """(query_id, base_id, dist_sq)."""
    return hits(index, surviving_cells(index, queries, r_sq, options), queries, r_sq, options)


def prune_counters(decided: DataFrame) -> DataFrame:
    """One row: cells and vectors that were candidates, that each stage rejected, and that were read."""
    is_ = lambda s: F.col("stage").isNull() if s == "read" else F.col("stage").eqNullSafe(s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return decided.agg(
        total("cells").alias("cells"), total("vecs").alias("vecs"),
        *(total(F.when(is_(s), F.col(c))).alias(f"{c}_{s}") for c in ("cells", "vecs") for s in (*STAGES, "read")),
    )
