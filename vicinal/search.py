"""Building and searching from a configuration and a truth file: the whole path from vectors to figures."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import build, cascade, codes, knn, metrics, range_join
from vicinal.plans.shared import materialize
from vicinal.sources.config import Config, read_truth


def build_from(config: Config, base: DataFrame, path: str) -> cascade.Index:
    """k-means, index and codes as the configuration says, over base(id, vec), written to path."""
    if config["unit_normalize_prebuild"]:
        base = base.withColumn("vec", V.normalize("vec"))
    k, eta = config["cluster_num"], config["eta"]
    centers = build.anisotropic_kmeans(base, k, eta) if config["partition_objective"] == "anisotropic" else build.kmeans(base, k)
    slabs = min(config["slab_count"], len(centers.matrix) - 1)
    with_codes = config["fast_path_enabled"] and config["fast_path_mode"] == "rbq"
    index = cascade.build_index(base, centers, slabs, config["pca_rank"], config["target_cell_vecs"], with_codes)
    index.meta["normalize"] = config["unit_normalize_prebuild"]
    cascade.write_index(index, path)
    return cascade.load_index(base.sparkSession, path)


def options_of(config: Config, cell_filter: bool = True) -> cascade.Options:
    """The stages that are on. With a candidate for every cluster nothing is prescreened."""
    every = config["K"] >= config["cluster_num"]
    on = {
        "prescreen": not every, "slab": config["slab_cluster_prune_enabled"] and config["slab_count"] > 0,
        "pca": config["pca_cluster_prune_enabled"], "cell": config["cell_filter_enabled"] and cell_filter,
    }
    code_filter = None
    if config["slow_path_rbq_prefilter_enabled"] and on["cell"]:
        code_filter = "cells" if config["slow_path_rbq_phase_b_enabled"] else "rows"
    return cascade.Options(config["approx_alpha"], None if every else config["K"], tuple(s for s in cascade.STAGES if on[s]), code_filter)


def classify(config: Config, index: cascade.Index, queries: DataFrame, r_sq: float) -> DataFrame | None:
    """(query_id, is_empty) by the classifier that is on, if any."""
    if config["fast_path_enabled"]:
        nprobe = min(config["fast_path_nprobe_N"], len(index.centers.matrix))
        if config["fast_path_mode"] == "rbq":
            return codes.emptiness(index.codes, index.centers, queries, r_sq, nprobe)
        return metrics.empty_by_probe(index.members, index.centers, queries, r_sq, nprobe).select("query_id", "is_empty")
    if config["data_hnsw_enabled"]:
        near = knn.one_nn(index.members.select("id", "vec"), queries)
        found = metrics.empty_by_nearest(near, float(np.sqrt(r_sq)), config["data_hnsw_margin_delta"])
        # a query without a nearest row is never called empty
        return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("is_empty", F.lit(False)).alias("is_empty"))
    return None


@dataclass
class Found:
    """hits(query_id, base_id, dist_sq), trace(query_id, is_empty, n_clusters, vecs, vecs_read, n_hits) and one row of figures."""

    hits: DataFrame
    trace: DataFrame
    figures: DataFrame


def search(config: Config, index: cascade.Index, queries: DataFrame, r_sq: float, truth: DataFrame | None = None, cell_filter: bool = True) -> Found:
    """Range search of queries(query_id, vec): those that the classifier calls empty are skipped, the cascade
    searches the rest. With truth(query_id, n_hits) the figures have recall and what skipping cost."""
    options = options_of(config, cell_filter)
    decided = classify(config, index, queries, r_sq)
    decided = queries.select("query_id", F.lit(False).alias("is_empty")) if decided is None else decided
    decided = materialize(decided, "decided")
    asked = materialize(metrics.survivors(queries, decided), "asked")
    pruned = cascade.prune(index, asked, r_sq, options, account=False)
    left = pruned.cells.where(F.col("stage").isNull()) if "stage" in pruned.cells.columns else pruned.cells
    hits = materialize(cascade.hits(index, left, asked, r_sq, options), "hits")
    trace = range_join.count_per_query(decided.select("query_id"), hits).join(decided, "query_id")
    read = left.groupBy("query_id").agg(F.sum("n").alias("vecs_read"))
    met = pruned.clusters.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("vecs"))
    trace = trace.join(met, "query_id", "left").join(read, "query_id", "left").na.fill(0, ["n_clusters", "vecs", "vecs_read"])
    trace = materialize(trace.select("query_id", "is_empty", "n_clusters", "vecs", "vecs_read", "n_hits"), "trace")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    figures = trace.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if("is_empty").alias("n_skipped"), total("vecs"), total("vecs_read"), total("n_hits"))
    if truth is not None:
        cost = metrics.confusion(decided, truth).select("hits", "n_false_empty", "hits_lost", "skip_rate", "false_empty_rate")
        figures = figures.join(F.broadcast(cost)).withColumn("recall", F.when(F.col("hits") > 0, F.round(F.col("total_n_hits") / F.col("hits"), 6)))
    return Found(hits, trace, figures)


def search_by_truth(spark: SparkSession, config: Config, index: cascade.Index, queries: DataFrame, path: str, cell_filter: bool = True) -> Found:
    """As search, with radius and counts from a truth file, which must agree with itself. Its counts are in the
    order of query ids."""
    summary, counts = read_truth(spark, path)
    if wrong := metrics.check_truth(counts, summary).head(1):
        raise ValueError(f"{path}: {wrong[0]['what']} is {wrong[0]['stated']}, its counts give {wrong[0]['found']}")
    raw = spark.read.json(path, multiLine=True).select(F.col("radius_squared").cast("double")).first()
    numbered = build.ranked(queries.select(F.col("query_id").alias("id")), queries.count())
    counts = counts.join(numbered, F.col("query_id") == F.col("rank")).select(F.col("id").alias("query_id"), "n_hits")
    return search(config, index, queries, raw[0], counts, cell_filter)


def figures_json(figures: DataFrame) -> str:
    return json.dumps(figures.first().asDict(), indent=1)
