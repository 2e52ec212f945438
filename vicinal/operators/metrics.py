"""Classifiers of empty queries, and the figures about searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import build, tasks


def empty_by_probe(assigned: DataFrame, centers: build.Centers, queries: DataFrame, r_sq: float, nprobe: int) -> DataFrame:
    """(query_id, min_dist_sq, is_empty): no vector of the nprobe nearest clusters of assigned(id, vec, cluster_id) is
    within the radius. A query that is not finite, or that met no vector, is never called empty."""
    good = queries.where(V.is_finite("vec"))
    near = build.assign(good.select(F.col("query_id").alias("id"), "vec"), centers, nprobe).select(F.col("id").alias("query_id"), "vec", "cluster_id")
    rows = assigned.select("id", "vec", "cluster_id").where(F.col("vec").isNotNull() & V.is_finite("vec"))
    joined = queries.select("query_id").join(tasks.least(near, rows), "query_id", "left")
    return joined.select("query_id", "min_dist_sq", F.coalesce(F.col("min_dist_sq") > r_sq, F.lit(False)).alias("is_empty"))


def empty_by_nearest(nearest: DataFrame, r: float, margin: float = 0.0) -> DataFrame:
    """(query_id, dist, is_empty) of nearest(query_id, dist_sq): the nearest vector is beyond r + margin."""
    if margin < 0:
        raise ValueError("margin is at least 0")
    d = F.sqrt("dist_sq")
    return nearest.select("query_id", d.alias("dist"), (d > r + margin).alias("is_empty"))


def survivors(queries: DataFrame, decided: DataFrame) -> DataFrame:
    return queries.join(decided.where(~F.col("is_empty")), "query_id", "left_semi")


def skipped(queries: DataFrame, decided: DataFrame) -> DataFrame:
    return queries.join(decided.where(~F.col("is_empty")), "query_id", "left_anti")


def confusion(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: what a classifier's decisions(query_id, is_empty) cost against truth(query_id, n_hits)."""
    j = truth.join(decided, "query_id")
    n = F.count(F.lit(1))
    skip, full = F.col("is_empty"), F.col("n_hits") > 0
    ratio = lambda a, b: F.when(b > 0, a / b)
    return j.agg(
        n.alias("n_queries"), F.count_if(skip).alias("n_skipped"), F.count_if(skip & full).alias("n_false_empty"),
        F.coalesce(F.sum(F.when(skip, F.col("n_hits"))), F.lit(0)).alias("hits_lost"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("hits"),
        F.round(ratio(F.count_if(skip), n), 6).alias("skip_rate"), F.round(ratio(F.count_if(skip & full), F.count_if(full)), 6).alias("false_empty_rate"),
        F.round(ratio(F.sum(F.when(skip, F.col("n_hits")).otherwise(0)), F.sum("n_hits")), 6).alias("hit_loss"),
        F.round(ratio(F.count_if(skip & ~full), F.count_if(~full)), 6).alias("zero_short_circuit_rate"),
    )


def count_stats(counts: DataFrame) -> DataFrame:
    """One row of counts(query_id, n_hits): total, min, median (middle two averaged), max, queries without hits."""
    return counts.agg(
        F.sum("n_hits").alias("total_in_range"), F.min("n_hits").alias("min_hits"), F.median("n_hits").alias("median_hits"),
        F.max("n_hits").alias("max_hits"), F.count_if(F.col("n_hits") == 0).alias("zero_hit_queries"), F.count(F.lit(1)).alias("n_queries"),
    )


def check_truth(counts: DataFrame, stated: DataFrame) -> DataFrame:
    """(what, stated, found) of fields of a truth summary that its counts contradict; empty if all agree."""
    own, other = count_stats(counts), stated.select([F.col(c).alias(f"s_{c}") for c in stated.columns])
    both = own.join(F.broadcast(other))
    names = [c for c in stated.columns if c in own.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(f"s_{c}").cast("double").alias("stated"), F.col(c).cast("double").alias("found")) for c in names]))
    return both.select(rows.alias("r")).select("r.*").where(~F.col("stated").eqNullSafe(F.col("found")))


def radius_at(kth: DataFrame, percent: float) -> DataFrame:
    """One row: squared radius at a percentile (linear between ranks) of k-th neighbours' squared distances."""
    r = F.percentile("dist_sq", percent / 100)
    return kth.agg(F.round(r, 6).alias("radius_squared"), F.round(F.sqrt(r), 6).alias("radius_l2"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of pair tables: counts, their ratio (may exceed 1) and the share of true pairs found; null if
    there is nothing to find."""
    f, t = found.select("query_id", "base_id").distinct(), truth.select("query_id", "base_id").distinct()
    both = f.withColumn("f", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["query_id", "base_id"], "full")
    a, b, c = F.count("f"), F.count("t"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull())
    return both.agg(a.alias("n_found"), b.alias("n_true"), F.round(F.when(b > 0, a / b), 6).alias("count_recall"), F.round(F.when(b > 0, c / b), 6).alias("set_recall"))


def search_trace(clusters: DataFrame) -> DataFrame:
    """(query_id, n_clusters, vecs, vecs_read) of a search's candidate clusters(query_id, n, stage)."""
    read = F.coalesce(F.sum(F.when(F.col("stage").isNull(), F.col("n"))), F.lit(0))
    return clusters.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("vecs"), read.alias("vecs_read"))


def nearest_bench(estimated: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, dist, estimate, found): whether the estimated nearest distance is the exact one, within a tolerance."""
    j = exact.join(estimated.withColumnRenamed("dist", "estimate"), "query_id")
    return j.select("query_id", "dist", "estimate", (F.col("estimate") <= F.col("dist") * 1.0001 + 1e-6).alias("found"))


def by_result_class(traces: DataFrame) -> DataFrame:
    """Mean of each figure of traces(query_id, n_hits, ...) for queries with and without hits."""
    figures = [c for c in traces.columns if c not in ("query_id", "n_hits")]
    return traces.groupBy((F.col("n_hits") == 0).alias("no_hits")).agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in figures))


def histogram(counts: DataFrame, bins_per_decade: int = 5) -> DataFrame:
    """(bin, n) of non-zero counts in logarithmic bins."""
    b = F.floor(F.log10("n_hits") * bins_per_decade + 1e-9).cast("int")
    return counts.where("n_hits > 0").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def count_quantiles(counts: DataFrame) -> DataFrame:
    some = counts.where("n_hits > 0")
    return some.agg(F.min("n_hits").alias("min_hits"), F.median("n_hits").alias("median_hits"), F.round(F.percentile("n_hits", 0.95), 6).alias("p95_hits"), F.max("n_hits").alias("max_hits"))


def pareto_front(runs: DataFrame) -> DataFrame:
    """Rows of runs(run, recall, qps) that no other beats in one and matches in the other: in order of falling
    recall, those faster than all before. One aggregated row a recall value is ordered, never pairs."""
    best = runs.groupBy("recall").agg(F.max("qps").alias("best"))
    before = F.max("best").over(Window.orderBy(F.desc("recall")).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("faster", before).where(F.col("faster").isNull() | (F.col("best") > F.col("faster")))
    return runs.join(front.select("recall", "best"), "recall").where(F.col("qps") == F.col("best")).select("run", "recall", "qps")


def io_bytes(decided: DataFrame, dim: int, bytes_per_component: int = 4) -> DataFrame:
    """One row of a cascade's decisions: bytes of candidate cells, of cells read, and the share saved."""
    size = F.col("vecs") * dim * bytes_per_component
    total, read = F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("stage").isNull(), size)), F.lit(0))
    return decided.agg(total.alias("bytes_baseline"), read.alias("bytes_read"), F.round(F.when(total > 0, 1 - read / total), 6).alias("io_reduction"))


def partition_errors(counters: DataFrame) -> DataFrame:
    """Rows of cascade counters whose parts don't add up; empty if all do."""
    parts = sum((F.col(f"vecs_{s}") for s in ("prescreen", "slab", "pca", "cell")), F.col("vecs_read"))
    return counters.where(parts != F.col("vecs"))


def touched_clusters(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id").agg(F.count_distinct("cluster_id").alias("n_clusters"))


def recall_at_1(estimated: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of queries whose estimated nearest distance is within a tolerance of the exact one."""
    j = estimated.select("query_id", F.col("dist").alias("e")).join(exact.select("query_id", "dist"), "query_id")
    return j.agg(F.round(F.avg((F.col("e") <= F.col("dist") * 1.0001 + 1e-6).cast("double")), 6).alias("recall_at_1"))


def assignment_errors(assigned: DataFrame, centers: build.Centers, stride: int) -> DataFrame:
    """One row: rows of every stride-th id checked again, and how many are not with their nearest center."""
    part = assigned.where(F.col("id") % stride == 0)
    again = build.assign(part.select("id", "vec"), centers).select("id", F.col("cluster_id").alias("best"))
    j = part.select("id", "cluster_id").join(again, "id")
    return j.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("best") != F.col("cluster_id")).alias("mismatched"))


def run_medians(runs: DataFrame, key: str = "config", value: str = "seconds") -> DataFrame:
    return runs.groupBy(key).agg(F.round(F.median(value), 6).alias("median_value"))


def set_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sizes of two sets of keys, of what both have and of what only one has."""
    x, y = a.select(keys).distinct().withColumn("in_a", F.lit(True)), b.select(keys).distinct().withColumn("in_b", F.lit(True))
    j = x.join(y, keys, "full")
    in_a, in_b = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    return j.agg(F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"), F.count_if(in_a & in_b).alias("n_both"), F.count_if(in_a != in_b).alias("n_one"))


def as_rows(one_row: DataFrame) -> DataFrame:
    """A row of figures as (metric, value)."""
    items = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
    return one_row.select(F.explode(F.array(*items)).alias("m")).select("m.*")


def truth_json(counts: DataFrame, r_sq: float, dataset: str, dim: int, n_base: int) -> DataFrame:
    """One row (json) with the summary of a truth table and its counts in order of query."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("query_id", "n_hits"))), lambda x: x["n_hits"])
    stats = F.struct(F.min("n_hits").alias("min"), F.median("n_hits").alias("median"), F.max("n_hits").alias("max"), F.count_if(F.col("n_hits") == 0).alias("zero_hit_queries"))
    fields = [
        F.lit(dataset).alias("dataset"), F.lit("l2").alias("metric"), F.count(F.lit(1)).alias("n_queries"), F.lit(n_base).alias("n_base"), F.lit(dim).alias("dim"),
        F.lit(r_sq).alias("radius_squared"), F.sum("n_hits").alias("total_in_range"), stats.alias("per_query_count_stats"), listed.alias("per_query_counts"),
    ]
    return counts.agg(*fields).select(F.to_json(F.struct("*")).alias("json"))


def write_hits(pairs: DataFrame, path: str) -> None:
    """CSV with a header: query_id, original_base_id, distance (squared)."""
    pairs.select("query_id", F.col("base_id").alias("original_base_id"), F.col("dist_sq").alias("distance")).write.mode("overwrite").csv(path, header=True)


def confusion_json(one_row: DataFrame) -> DataFrame:
    """A row of figures as one JSON text."""
    return one_row.select(F.to_json(F.struct("*")).alias("json"))


def write_rows(df: DataFrame, path: str, order: str) -> None:
    """CSV with a header, in an order."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").csv(path, header=True)


def write_trace(trace: DataFrame, path: str) -> None:
    """CSV with a header, in order of query."""
    write_rows(trace, path, "query_id")


def bound_dump(bounds: DataFrame, asked: DataFrame, queries: int = 100) -> DataFrame:
    """Lower bounds by query and cluster for the first queries of asked(query_id) by id, for plotting."""
    return bounds.join(F.broadcast(asked.select("query_id").orderBy("query_id").limit(queries)), "query_id", "left_semi")


def invalid_candidates(found: DataFrame, n_clusters: int) -> DataFrame:
    """Candidates that name no cluster; empty if all do."""
    return found.where(~F.col("cluster_id").between(0, n_clusters - 1)).select("query_id", "cluster_id")


def probe_overlap(found: DataFrame, sizes: DataFrame, a: int, b: int) -> DataFrame:
    """One row: vectors in clusters that are among both the a and the b nearest of a query."""
    both = found.where(F.col("rank") <= min(a, b)).join(sizes.select("cluster_id", "n"), "cluster_id")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shared_vecs"))


def perturbed(df: DataFrame, column: str, scale: float, seed: int) -> DataFrame:
    """df with seeded Gaussian noise added to a column: the same row gets the same noise wherever it is
    computed (Box-Muller over two hashes of its id)."""
    digits = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed + k}:"), F.col("id").cast("string"))), 1, 10), 16, 10)
    u = lambda k: (digits(k).cast("double") + 1) / F.lit(float((1 << 40) + 1))
    noise = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    return df.withColumn(column, F.col(column) + F.lit(scale) * noise)
