"""Exact nearest neighbours. base(id, vec[, label]), queries(query_id, vec)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import kernels
from vicinal.operators.range_join import ROWS, query_blocks, spread

PAIRS = "query_id long, base_id long, dist_sq double"


#: Scores by which neighbours may be ranked, smallest first, as in the vector functions of these names.
METRICS = ("l2_sq", "neg_dot", "neg_abs_dot", "dot", "abs_dot", "neg_l2_sq")


def _score(queries: np.ndarray, rows: np.ndarray, metric: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of each query's k rows of least score; ties by row."""
    if metric == "l2_sq":
        return kernels.nearest(queries, rows, k)
    if metric == "neg_l2_sq":
        score = -np.stack([kernels.exact_l2_sq(np.broadcast_to(q, rows.shape), rows) for q in queries])
    else:
        score = queries @ rows.T
        score = np.abs(score) if "abs" in metric else score
        score = -score if metric.startswith("neg") else score
    order = np.argsort(score, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(score, order, 1)


def _best(block, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        held_id = np.zeros((len(ids), 0), np.int64)
        held_d = np.zeros((len(ids), 0))
        for batch in batches:
            key, rows = kernels.finite(batch.column(0).to_numpy(), kernels.matrix(batch.column(1)))
            order = np.argsort(key, kind="stable")  # ties go to the smaller id
            key, rows = key[order], rows[order]
            for at in range(0, len(key), ROWS):
                near, d = _score(matrix, rows[at : at + ROWS], metric, k)
                held_id, held_d = np.hstack([held_id, key[at + near]]), np.hstack([held_d, d])
                order = np.lexsort((held_id, held_d), axis=1)[:, :k]
                held_id, held_d = np.take_along_axis(held_id, order, 1), np.take_along_axis(held_d, order, 1)
        n = held_id.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, n)), pa.array(held_id.ravel()), pa.array(held_d.ravel())], names=["query_id", "base_id", "dist_sq"]
        )

    return run


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2_sq") -> DataFrame:
    """(query_id, base_id, dist_sq, rank): each query's k nearest, ties by base id. A task keeps k rows a query;
    only those are shuffled. Labels are filtered on base beforehand. dist_sq holds the metric's score."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    spark = base.sparkSession
    rows = spread(base.select(F.col("id").cast("long").alias("id"), "vec").where(F.col("vec").isNotNull()))
    parts = [rows.mapInArrow(_best(spark.sparkContext.broadcast(b), k, metric), PAIRS) for b in query_blocks(queries)]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PAIRS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist_sq", "base_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def one_nn(base: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, base_id, dist_sq)."""
    return knn(base, queries, 1).drop("rank")


def kth_distance(neighbours: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, base_id, dist_sq) of the k-th neighbour that neighbours(query_id, base_id, rank) lists."""
    kth = neighbours.where(F.col("rank") == k).select("query_id", "base_id")
    b = base.select(F.col("id").alias("base_id"), F.col("vec").alias("bv"))
    q = queries.select("query_id", F.col("vec").alias("qv"))
    return kth.join(b, "base_id").join(q, "query_id").select("query_id", "base_id", V.l2_sq("bv", "qv").alias("dist_sq"))


def as_lists(neighbours: DataFrame) -> DataFrame:
    """(query_id, neighbours: array of (id, dist_sq) in order of rank)."""
    item = F.struct("rank", F.col("base_id").alias("id"), "dist_sq")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["dist_sq"].alias("dist_sq")))
    return neighbours.groupBy("query_id").agg(listed.alias("neighbours"))
