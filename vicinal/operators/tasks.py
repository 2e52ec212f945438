"""Queries meet the rows of cells in tasks of bounded size: a matrix product a task, and no row for a pair that is not kept.

The rows of a cluster are cut into slices of whole cells, a cell of more than CHUNK rows into pieces, queries into chunks.
A task gets its queries once, each with the list of its cells, and each of its rows once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators import kernels
from vicinal.plans.shared import materialize

#: Rows of one side of a task, about; rows of one side that a product takes at a time.
CHUNK, STEP = 2048, 512
TASK = ["cluster_id", "slice", "piece", "chunk"]


@dataclass
class Dealt:
    """asked(query_id, *TASK, cells): the queries' side; big(cluster_id, cell_id, pieces): cells that are cut, if any."""

    asked: DataFrame
    queries: DataFrame
    big: DataFrame | None

    def wanted(self) -> DataFrame:
        """(*TASK, cell_id) of the cells that some query of the task reads. The lists of a batch are united first: no row
        stands for a query and a cell."""
        return self.asked.select(*TASK, "cells").mapInArrow(_united, "cluster_id int, slice int, piece int, chunk int, cell_id long").distinct()

    def rows(self, table: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows of table(cluster_id, cell_id, id, ..) in the tasks of wanted(*TASK, cell_id and, if it has them, id and
        other columns). Joined by sorting: how large a table is that compresses well is not known beforehand."""
        keys = [k for k in ("cluster_id", "cell_id", "id") if k in wanted.columns]
        if self.big is not None and "id" not in keys:
            wanted = wanted.join(self.big.hint("merge"), ["cluster_id", "cell_id"], "left")
            found = table.join(wanted.hint("merge"), keys)
            return found.where(F.col("pieces").isNull() | (F.pmod(F.xxhash64("id"), F.col("pieces")) == F.col("piece"))).drop("pieces")
        return table.join(wanted.hint("merge"), keys)

    def meet(self, rows: DataFrame, run, schema: str) -> DataFrame:
        """run(queries, rows), both in order of id, on the two sides of each task."""
        own = [c for c in rows.columns if c not in (*TASK, "id", "vec", "cells")]
        kinds = dict(rows.dtypes)
        null = lambda c, kind: F.lit(None).cast(kind).alias(c)
        asked = self.asked.hint("merge").join(self.queries.select("query_id", "vec"), "query_id")
        left = asked.select(*TASK, F.lit(True).alias("is_query"), F.col("query_id").alias("id"), "vec", "cells", *(null(c, kinds[c]) for c in own))
        vec = "vec" if "vec" in kinds else null("vec", "array<double>")
        right = rows.select(*TASK, F.lit(False).alias("is_query"), "id", vec, null("cells", "array<bigint>"), *own)

        def both(table: pa.Table) -> pa.Table:
            table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
            side = table.column("is_query").to_numpy(zero_copy_only=False)
            return run(table.filter(pa.array(side)), table.filter(pa.array(~side)))

        return left.unionByName(right).groupBy(*TASK).applyInArrow(both, schema)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(len(TASK))
        names, which = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        if not len(names):
            continue
        found, of = np.unique(np.stack([batch.column(c).to_numpy() for c in range(len(TASK))], axis=1), axis=0, return_inverse=True)
        who = np.repeat(of.ravel(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        pair = np.unique(who * len(names) + which.ravel())
        own = found[pair // len(names)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(pa.array(own[:, c].copy()) for c in range(len(TASK))), pa.array(names[pair % len(names)])], names=[*TASK, "cell_id"])


def deal(read: DataFrame, queries: DataFrame, stats: DataFrame, cells: DataFrame, chunk: int | None = None) -> Dealt:
    """Tasks for read(query_id, cluster_id, cell_id), with stats(cluster_id, n) and cells(cluster_id, cell_id, n). read
    may have lists of cells in slices already, as read(query_id, cluster_id, slice, cells); without a cell that is cut
    they are the queries' side as they are."""
    chunk = chunk or CHUNK
    parts = F.broadcast(stats.select("cluster_id", F.ceil(F.col("n") / chunk).alias("parts")))  # a row a cluster
    chunks = max(1, -(-queries.count() // chunk))
    big = cells.where(F.col("n") > chunk).select("cluster_id", "cell_id", F.ceil(F.col("n") / chunk).alias("pieces"))
    big = big if big.head(1) else None
    if "cells" in read.columns:
        if big is None:
            name = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk")
            return Dealt(read.select("query_id", "cluster_id", "slice", F.lit(0).alias("piece"), name, "cells"), queries, None)
        read = read.select("query_id", "cluster_id", F.explode("cells").alias("cell_id"))
    cut = read.select("query_id", "cluster_id", F.col("cell_id").cast("long").alias("cell_id")).join(parts, "cluster_id")
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("cell_id"), F.col("parts")).cast("int"))
    piece = F.lit(0)
    if big is not None:
        cut = cut.join(big.hint("merge"), ["cluster_id", "cell_id"], "left")
        piece = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)).cast("int") - 1))
    cut = cut.withColumn("piece", piece).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    asked = cut.groupBy("query_id", *TASK).agg(F.collect_list("cell_id").alias("cells"))
    return Dealt(materialize(asked, "asked-cells"), queries, big)


def least(near: DataFrame, rows: DataFrame, chunk: int | None = None) -> DataFrame:
    """(query_id, min_dist_sq) of near(query_id, vec, cluster_id) and rows(id, vec, cluster_id), finite vectors: each
    query's least squared distance to rows of its clusters. Slices of a cluster's rows meet chunks of its queries; a
    number a query leaves a task. Queries whose clusters are empty are left out."""
    chunk = chunk or CHUNK
    count = lambda df, name: df.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))
    parts = materialize(count(near, "chunks").join(count(rows, "slices"), "cluster_id"), "sides")  # a row a cluster

    def side(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        cut = df.join(F.broadcast(parts), "cluster_id").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
        cut = cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        return cut.select("cluster_id", "slice", "chunk", F.lit(key == "query_id").alias("is_query"), F.col(key).alias("id"), "vec")

    def run(table: pa.Table) -> pa.Table:
        of = table.column("is_query").to_numpy(zero_copy_only=False)
        asked, x = table.filter(pa.array(of)), kernels.matrix(table.filter(pa.array(~of)).column("vec"))
        q = kernels.matrix(asked.column("vec"))
        d = [kernels.least(q[at : at + STEP], x) for at in range(0, len(q), STEP)] if len(x) else []
        ids = asked.column("id") if d else asked.column("id")[:0]
        return pa.table({"query_id": ids, "min_dist_sq": pa.array(np.concatenate(d) if d else np.zeros(0))})

    both = side(near, "query_id", "chunk", "slice").unionByName(side(rows, "id", "slice", "chunk"))
    found = both.groupBy("cluster_id", "slice", "chunk").applyInArrow(run, "query_id long, min_dist_sq double")
    return found.groupBy("query_id").agg(F.min("min_dist_sq").alias("min_dist_sq"))


def mask(queries: pa.Table, rows: pa.Table) -> np.ndarray:
    """(row, query): whether the query reads the row's cell."""
    names, of = np.unique(rows.column("cell_id").to_numpy(), return_inverse=True)
    lists = queries.column("cells").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    who = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
    met = np.zeros((len(names), len(lists)), bool)
    if len(names):
        ok = names[at] == flat
        met[at[ok], who[ok]] = True
    return met[of]


def pairs(r_sq: float):
    """For Dealt.meet: (query_id, base_id, dist_sq) within the radius, of the queries that `kept` has a bit for, in order
    of id, or else of those that read the row's cell."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            q, asked, ids, x = kernels.matrix(queries.column("vec")), queries.column("id").to_numpy(), rows.column("id").to_numpy(), kernels.matrix(rows.column("vec"))
            if "kept" in rows.column_names:
                bits = np.frombuffer(b"".join(rows.column("kept").to_pylist()), np.uint8).reshape(len(x), -1)
                may = np.unpackbits(bits, axis=1, count=len(q)).astype(bool)
            else:
                may = mask(queries, rows)
            for at in range(0, len(x), STEP):
                i, j, d = kernels.within_radius(x[at : at + STEP], q, r_sq, allowed=may[at : at + STEP])
                for held, found in zip(out, (asked[j], ids[at + i], d), strict=True):
                    held.append(found)
        columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "base_id", "dist_sq"), map(pa.array, columns), strict=True)))

    return run
