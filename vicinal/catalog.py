"""Registered queries of the engine, each with SQL that gives the same rows where SQL can.

All read the whole embeddings table at full width (one query, named so, searches a few dimensions). Searches take
the rows whose id is divisible by 50 as queries. Queries of an index share a stored one, built once a session.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal import search
from vicinal.functions import vectors as V
from vicinal.operators import build, cascade, codes, graph, knn, metrics, range_join, tasks
from vicinal.plans.shared import materialize
from vicinal.sources import config

DIM, R_FULL, R_NEAR, K, CENTERS, SLABS, NPROBE, ETA = 64, 1.5, 1.25, 5, 16, 4, 3, 4.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- tables


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), V.as_double("embedding").alias("vec"), F.col("label").cast("int").alias("label"))


def as_queries(base: DataFrame) -> DataFrame:
    return base.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")


_stored: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf: str) -> str:
    """The folder of the index over the embeddings, built and written once a session."""
    from vicinal.plans.shared import new_path

    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        base = embeddings(spark, sf)
        path = new_path(spark, "index")
        cascade.write_index(cascade.build_index(base, build.stride_seeds(base, CENTERS), SLABS, 32, 24, with_codes=True), path)
        _stored[key] = path
    return _stored[key]


def indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, cascade.Index]:
    base = embeddings(spark, sf)
    return base, as_queries(base), cascade.load_index(spark, stored_index(spark, sf))


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file by Hadoop's file system, so that it is where tasks look; returns its path."""
    from vicinal.plans.shared import new_path

    path = new_path(spark, name)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(data)
    out.close()
    return path.removeprefix("file://").removeprefix("file:")


def integers(df: DataFrame, signed: bool) -> DataFrame:
    """Components as whole numbers: from -127 to 127, or from 0 to 255."""
    x = (lambda v: F.round(v * 127)) if signed else (lambda v: F.round((v + 1) * 127.5))
    return df.withColumn("vec", F.transform("vec", x).cast("array<bigint>"))


# ---- SQL that several queries share

L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"
OWN = "list_sum(list_transform({a}, lambda x: x * x))"


def l2(a: str, b: str) -> str:
    return L2.format(a=a, b=b)


def dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def own(a: str) -> str:
    return OWN.format(a=a)


def with_tables(dims: int = 64, k: int = CENTERS) -> str:
    """b: base; q: queries; c: centers, the stride seeds."""
    return f"""WITH b AS (SELECT vec_id AS id, list_transform(embedding[1:{dims}], lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings),
    q AS (SELECT id AS query_id, v FROM b WHERE id % 50 = 0),
    ranked AS (SELECT id, v, row_number() OVER (ORDER BY id) - 1 AS rk, (SELECT count(*) FROM b) // {k} AS step FROM b),
    c AS (SELECT CAST(rk // step AS INTEGER) AS cluster_id, v FROM ranked WHERE rk % step = 0 AND rk < step * {k})"""


def with_assigned(dims: int = DIM, m: int = 1) -> str:
    """a: (id, v, cluster_id, d2, rank) of the m nearest centers."""
    return (
        with_tables(dims)
        + f""", dist AS (SELECT b.id, b.v, c.cluster_id, {l2("b.v", "c.v")} AS d2 FROM b, c),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster_id) AS rank FROM dist) WHERE rank <= {m})"""
    )


def with_hits(dims: int, r_sq: float) -> str:
    return with_tables(dims) + f""", p AS (SELECT q.query_id, b.id AS base_id, {l2("b.v", "q.v")} AS dist_sq FROM b, q),
    hits AS (SELECT * FROM p WHERE dist_sq <= {r_sq}),
    counts AS (SELECT q.query_id, count(h.base_id) AS n_hits FROM q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id)"""


NEIGHBOURS = f""", cn AS (SELECT * FROM (SELECT x.cluster_id, y.cluster_id AS neighbour_id, x.v AS xv, y.v AS yv, {l2("x.v", "y.v")} AS dist_sq,
      row_number() OVER (PARTITION BY x.cluster_id ORDER BY {l2("x.v", "y.v")}, y.cluster_id) - 1 AS slot
      FROM c x, c y WHERE x.cluster_id <> y.cluster_id) WHERE slot < {SLABS})"""
SLAB_SQL = f""", pr AS (SELECT cn.cluster_id, cn.neighbour_id, cn.slot, sqrt(cn.dist_sq) AS norm,
      ({dot("a.v", "list_transform(list_zip(cn.yv, cn.xv), lambda x: x[1] - x[2])")} - {dot("cn.xv", "list_transform(list_zip(cn.yv, cn.xv), lambda x: x[1] - x[2])")}) / sqrt(cn.dist_sq) AS pos
      FROM cn LEFT JOIN a ON a.cluster_id = cn.cluster_id),
    sl AS (SELECT cluster_id, neighbour_id, slot, any_value(norm) AS norm, min(pos) AS lo, max(pos) AS hi FROM pr GROUP BY cluster_id, neighbour_id, slot)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


def one(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- range joins and truth


@query("range_join", with_hits(64, R_FULL) + "SELECT query_id, base_id, round(dist_sq, 6) AS dist_sq FROM hits")
def q_range_join(spark, sf):
    base = embeddings(spark, sf)
    return rounded(range_join.range_join(base, as_queries(base), R_FULL), "dist_sq")


@query("range_join_small_dim", with_hits(8, 0.1) + "SELECT query_id, base_id, round(dist_sq, 6) AS dist_sq FROM hits")
def q_range_join_small(spark, sf):
    base = embeddings(spark, sf).withColumn("vec", F.slice("vec", 1, 8))
    return rounded(range_join.range_join(base, as_queries(base), 0.1), "dist_sq")


def counts_of(spark, sf):
    base = embeddings(spark, sf)
    queries = as_queries(base)
    return range_join.count_per_query(queries, range_join.range_join(base, queries, R_FULL))


@query("range_count_per_query", with_hits(64, R_FULL) + "SELECT query_id, n_hits FROM counts")
def q_counts(spark, sf):
    return counts_of(spark, sf)


STATS_SQL = "SELECT CAST(sum(n_hits) AS BIGINT) AS total_in_range, min(n_hits) AS min_hits, median(n_hits) AS median_hits, max(n_hits) AS max_hits, count(*) FILTER (n_hits = 0) AS zero_hit_queries, count(*) AS n_queries FROM counts"


@query("range_count_stats", with_hits(64, R_FULL) + STATS_SQL)
def q_count_stats(spark, sf):
    return metrics.count_stats(counts_of(spark, sf))


@query("hit_verification", with_hits(64, R_FULL) + "SELECT query_id, base_id, dist_sq FROM hits WHERE dist_sq > 1e9")
def q_verify(spark, sf):
    base = embeddings(spark, sf)
    queries = as_queries(base)
    return range_join.verify(range_join.range_join(base, queries, R_FULL), base, queries)


def truth_file(spark, sf, shift: int = 0) -> str:
    """A truth file from a join by SQL functions alone; its stated total is off by shift."""
    base = embeddings(spark, sf)
    pairs = base.join(as_queries(base).select("query_id", F.col("vec").alias("qv"))).where(V.l2_sq("vec", "qv") <= R_FULL)
    counts = range_join.count_per_query(as_queries(base), pairs.select("query_id", F.col("id").alias("base_id"))).orderBy("query_id")
    text = metrics.truth_json(counts, R_FULL, "embeddings", DIM, base.count()).first()["json"]
    found = json.loads(text)
    found["total_in_range"] += shift
    return put_file(spark, "truth", json.dumps(found).encode())


@query("truth_cross_check", with_hits(64, R_FULL) + "SELECT 'total_in_range' AS what, CAST(count(*) + 3 AS DOUBLE) AS stated, CAST(count(*) AS DOUBLE) AS found FROM hits")
def q_truth_check(spark, sf):
    """A truth file whose total is wrong, against the counts of the matrix product: the total alone is named."""
    return metrics.check_truth(counts_of(spark, sf), config.read_truth(spark, truth_file(spark, sf, 3))[0])


@query("truth_file_counts", with_hits(64, R_FULL) + "SELECT CAST(row_number() OVER (ORDER BY query_id) - 1 AS BIGINT) AS query_id, n_hits FROM counts")
def q_truth_counts(spark, sf):
    """Counts by the number of the query in the file."""
    return config.read_truth(spark, truth_file(spark, sf))[1]


@query("truth_json", with_hits(64, R_FULL) + "SELECT 'embeddings' AS dataset, count(*) AS n_queries, CAST(sum(n_hits) AS BIGINT) AS total_in_range, median(n_hits) AS median_hits, list(n_hits ORDER BY query_id) AS per_query_counts FROM counts")
def q_truth_json(spark, sf):
    made = metrics.truth_json(counts_of(spark, sf), R_FULL, "embeddings", DIM, embeddings(spark, sf).count())
    kind = "dataset string, n_queries long, total_in_range long, per_query_count_stats struct<median: double>, per_query_counts array<long>"
    return made.select(F.from_json("json", kind).alias("j")).select("j.dataset", "j.n_queries", "j.total_in_range", F.col("j.per_query_count_stats.median").alias("median_hits"), "j.per_query_counts")


@query("metric_rows", with_hits(64, R_FULL) + f", s AS ({STATS_SQL}) SELECT metric, value FROM (UNPIVOT (SELECT total_in_range::DOUBLE AS total_in_range, min_hits::DOUBLE AS min_hits, median_hits::DOUBLE AS median_hits, max_hits::DOUBLE AS max_hits, zero_hit_queries::DOUBLE AS zero_hit_queries, n_queries::DOUBLE AS n_queries FROM s) ON COLUMNS(*) INTO NAME metric VALUE value)")
def q_metric_rows(spark, sf):
    return metrics.as_rows(metrics.count_stats(counts_of(spark, sf)))


@query("histogram_counts", with_hits(64, R_FULL) + "SELECT CAST(floor(log10(n_hits) * 5 + 1e-9) AS INTEGER) AS bin, count(*) AS n FROM counts WHERE n_hits > 0 GROUP BY 1")
def q_histogram(spark, sf):
    return metrics.histogram(counts_of(spark, sf))


@query("histogram_csv", with_hits(64, R_FULL) + "SELECT CAST(floor(log10(n_hits) * 5 + 1e-9) AS INTEGER) AS bin, count(*) AS n FROM counts WHERE n_hits > 0 GROUP BY 1")
def q_histogram_csv(spark, sf):
    from vicinal.plans.shared import new_path

    path = new_path(spark, "histogram")
    metrics.write_rows(metrics.histogram(counts_of(spark, sf)), path, "bin")
    return spark.read.csv(path, header=True, schema="bin int, n long")


@query("count_quantiles", with_hits(64, R_FULL) + "SELECT min(n_hits) AS min_hits, median(n_hits) AS median_hits, round(quantile_cont(n_hits, 0.95), 6) AS p95_hits, max(n_hits) AS max_hits FROM counts WHERE n_hits > 0")
def q_count_quantiles(spark, sf):
    return metrics.count_quantiles(counts_of(spark, sf))


KNN_SQL = f""", nn AS (SELECT * FROM (SELECT query_id, base_id, dist_sq, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, base_id) AS rank FROM p) WHERE rank <= {K})"""


@query("knn_topk", with_hits(64, R_FULL) + KNN_SQL + "SELECT query_id, base_id, round(dist_sq, 6) AS dist_sq, rank FROM nn")
def q_knn(spark, sf):
    base = embeddings(spark, sf)
    return rounded(knn.knn(base, as_queries(base), K), "dist_sq")


@query("knn_lists", with_hits(64, R_FULL) + KNN_SQL + "SELECT query_id, list(base_id ORDER BY rank) AS ids, list(round(dist_sq, 6) ORDER BY rank) AS dists FROM nn GROUP BY query_id")
def q_knn_lists(spark, sf):
    base = embeddings(spark, sf)
    listed = knn.as_lists(knn.knn(base, as_queries(base), K))
    return listed.select("query_id", F.col("neighbours.id").alias("ids"), F.transform("neighbours", lambda x: F.round(x["dist_sq"], 6)).alias("dists"))


@query("knn_label_filtered", with_tables() + f"SELECT query_id, base_id, round(dist_sq, 6) AS dist_sq, rank FROM (SELECT q.query_id, b.id AS base_id, {l2('b.v', 'q.v')} AS dist_sq, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2('b.v', 'q.v')}, b.id) AS rank FROM b, q WHERE b.label = 3) WHERE rank <= {K}")
def q_knn_label(spark, sf):
    base = embeddings(spark, sf)
    return rounded(knn.knn(base.where("label = 3"), as_queries(base), K), "dist_sq")


@query("one_nn", with_tables() + f"SELECT query_id, base_id, round(dist_sq, 6) AS dist_sq FROM (SELECT q.query_id, b.id AS base_id, {l2('b.v', 'q.v')} AS dist_sq, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2('b.v', 'q.v')}, b.id) AS rank FROM b, q WHERE b.id % 50 <> 0) WHERE rank = 1")
def q_one_nn(spark, sf):
    base = embeddings(spark, sf)
    return rounded(knn.one_nn(base.where("id % 50 <> 0"), as_queries(base)), "dist_sq")


@query("kth_distance", with_hits(64, R_FULL) + KNN_SQL + f"SELECT query_id, base_id, round(dist_sq, 6) AS dist_sq FROM nn WHERE rank = {K}")
def q_kth(spark, sf):
    base = embeddings(spark, sf)
    queries = as_queries(base)
    return rounded(knn.kth_distance(knn.knn(base, queries, K), base, queries, K), "dist_sq")


@query("radius_percentile", with_hits(64, R_FULL) + KNN_SQL + f"SELECT round(quantile_cont(dist_sq, 0.5), 6) AS radius_squared, round(sqrt(quantile_cont(dist_sq, 0.5)), 6) AS radius_l2 FROM nn WHERE rank = {K}")
def q_radius(spark, sf):
    base = embeddings(spark, sf)
    queries = as_queries(base)
    return metrics.radius_at(knn.kth_distance(knn.knn(base, queries, K), base, queries, K), 50)


@query("self_join_strict", with_tables() + f"SELECT x.id AS a, y.id AS b, round({l2('x.v', 'y.v')}, 6) AS dist_sq FROM b x, b y WHERE x.id > y.id AND {l2('x.v', 'y.v')} < {R_NEAR}")
def q_self_join(spark, sf):
    return rounded(range_join.self_join(embeddings(spark, sf), R_NEAR), "dist_sq")


# ---- build


@query("stride_seeds", with_tables() + "SELECT cluster_id, list_transform(v, lambda x: round(x, 6)) AS vec FROM c")
def q_seeds(spark, sf):
    base = embeddings(spark, sf)
    return build.stride_seeds(base, CENTERS).table(spark).select("cluster_id", F.transform("vec", lambda x: V.rounded(x)).alias("vec"))


@query("nearest_centroid", with_assigned() + "SELECT id, cluster_id, round(d2, 6) AS dist_sq FROM a")
def q_nearest(spark, sf):
    base = embeddings(spark, sf)
    return rounded(build.assign(base, build.stride_seeds(base, CENTERS)).select("id", "cluster_id", "dist_sq"), "dist_sq")


@query("two_nn_assign", with_assigned(m=2) + "SELECT id, cluster_id, round(d2, 6) AS dist_sq, CAST(rank AS INTEGER) AS rank FROM a")
def q_two_nn(spark, sf):
    base = embeddings(spark, sf)
    return rounded(build.assign(base, build.stride_seeds(base, CENTERS), 2).select("id", "cluster_id", "dist_sq", "rank"), "dist_sq")


WIDE = """, w AS (SELECT id, max(cluster_id) FILTER (rank = 1) AS c1, max(cluster_id) FILTER (rank = 2) AS c2, max(d2) FILTER (rank = 1) AS d1, max(d2) FILTER (rank = 2) AS dd FROM a GROUP BY id)"""


def fold_sql(order: str, pick: str) -> str:
    """Rows one after the other, with bucket sizes: s.sizes[cluster + 1] before each row."""
    return f"""WITH RECURSIVE o AS ({with_assigned(m=2)}{WIDE} SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM w),
    s(n, sizes, id, cluster_id) AS (SELECT 0::BIGINT, list_transform(range({CENTERS}), lambda x: 0::BIGINT), NULL::BIGINT, NULL::INTEGER
      UNION ALL SELECT o.n, list_transform(sizes, lambda x, i: x + CASE WHEN i = 1 + ({pick}) THEN 1 ELSE 0 END), o.id, CAST({pick} AS INTEGER) FROM s JOIN o ON o.n = s.n + 1)
    SELECT id, cluster_id FROM s WHERE id IS NOT NULL"""


@query("two_choice_assign", fold_sql("id", f"CASE WHEN o.dd < {build.TWO_CHOICE} * o.d1 AND sizes[o.c2 + 1] < sizes[o.c1 + 1] THEN o.c2 ELSE o.c1 END"))
def q_two_choice(spark, sf):
    base = embeddings(spark, sf)
    return build.two_choice(base, build.stride_seeds(base, CENTERS))


@query("balanced_assign", fold_sql("dd - d1, id", "CASE WHEN sizes[o.c2 + 1] < sizes[o.c1 + 1] THEN o.c2 ELSE o.c1 END"))
def q_balanced(spark, sf):
    base = embeddings(spark, sf)
    return build.balanced(base, build.stride_seeds(base, CENTERS))


@query("lloyd_step", with_assigned() + f", m AS (SELECT cluster_id, d AS dim, avg(v[d]) AS x FROM a, range(1, {DIM + 1}) t(d) GROUP BY cluster_id, d) SELECT c.cluster_id, list(round(m.x, 6) ORDER BY m.dim) AS vec FROM c JOIN m USING (cluster_id) GROUP BY c.cluster_id")
def q_lloyd(spark, sf):
    base = embeddings(spark, sf)
    after, _ = build.lloyd_step(base, build.stride_seeds(base, CENTERS))
    return after.table(spark).select("cluster_id", F.transform("vec", lambda x: V.rounded(x)).alias("vec"))


@query("clustering_loss", with_assigned() + "SELECT round(sum(d2), 6) AS loss FROM a")
def q_loss(spark, sf):
    base = embeddings(spark, sf)
    return spark.createDataFrame([(round(build.lloyd_step(base, build.stride_seeds(base, CENTERS))[1], 6),)], "loss double")


STEP = "SELECT cluster_id, list(x ORDER BY d) AS v FROM (SELECT cluster_id, d, avg(v[d]) AS x FROM {a}, range(1, {n}) t(d) GROUP BY cluster_id, d) GROUP BY cluster_id"


def step(a: str) -> str:
    return STEP.format(a=a, n=DIM + 1)


@query("kmeans_train", with_assigned() + f", c2 AS ({step('a')}), a2 AS (SELECT id, v, cluster_id FROM (SELECT b.id, b.v, c2.cluster_id, row_number() OVER (PARTITION BY b.id ORDER BY {l2('b.v', 'c2.v')}, c2.cluster_id) AS rank FROM b, c2) WHERE rank = 1), c3 AS ({step('a2')}) SELECT cluster_id, list_transform(v, lambda x: round(x, 6)) AS vec FROM c3")
def q_kmeans(spark, sf):
    """Two iterations over a sample that takes in all rows."""
    base = embeddings(spark, sf)
    found = build.kmeans(base, CENTERS, iterations=2, per_center=base.count())
    return found.table(spark).select("cluster_id", F.transform("vec", lambda x: V.rounded(x)).alias("vec"))


@query("anisotropic_update", with_tables() + "SELECT cluster_id, true AS solved FROM c")
def q_anisotropic(spark, sf):
    """Whether each new center solves (n I + (eta - 1) sum x x' / (|x|^2 + 1e-12)) c = eta sum x over the rows that had
    the least loss, by SQL functions."""
    base = embeddings(spark, sf)
    old = build.stride_seeds(base, CENTERS)
    new = build.anisotropic_step(base, old, ETA)[0].table(spark).select("cluster_id", F.col("vec").alias("c"))
    olds = old.table(spark).select("cluster_id", F.col("vec").alias("cv"))
    loss = V.anisotropic_loss("vec", "cv", ETA)
    best = base.join(F.broadcast(olds)).groupBy("id").agg(F.min(F.struct(loss, "cluster_id")).alias("b")).select("id", "b.cluster_id")
    rows = base.join(best, "id").join(new, "cluster_id")
    along = V.dot("vec", "c") / (V.norm_sq("vec") + 1e-12)
    sums = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col("vec")[i] * along).alias(f"a{i}") for i in range(DIM)), *(F.sum(F.col("vec")[i]).alias(f"x{i}") for i in range(DIM))
    )
    both = sums.join(new, "cluster_id")
    miss = F.greatest(*[F.abs(F.col("n") * F.col("c")[i] + (ETA - 1) * F.col(f"a{i}") - ETA * F.col(f"x{i}")) for i in range(DIM)])
    return both.select("cluster_id", (miss < 1e-6).alias("solved"))


def assigned_of(spark, sf):
    base = embeddings(spark, sf)
    centers = build.stride_seeds(base, CENTERS)
    return build.assign(base, centers), centers


@query("cluster_stats", with_assigned() + "SELECT cluster_id, count(*) AS n, round(max(sqrt(d2)), 6) AS radius FROM a GROUP BY cluster_id")
def q_cluster_stats(spark, sf):
    return rounded(build.cluster_stats(assigned_of(spark, sf)[0]), "radius")


@query("cluster_offsets", with_assigned() + ", s AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id) SELECT cluster_id, n, CAST(sum(n) OVER (ORDER BY cluster_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS \"offset\" FROM s")
def q_offsets(spark, sf):
    return build.offsets(build.cluster_stats(assigned_of(spark, sf)[0]).select("cluster_id", "n"), "cluster_id", "n")


@query("centroid_knn", with_tables() + NEIGHBOURS + "SELECT cluster_id, neighbour_id, round(dist_sq, 6) AS dist_sq, CAST(slot AS INTEGER) AS slot FROM cn")
def q_centroid_knn(spark, sf):
    centers = build.stride_seeds(embeddings(spark, sf), CENTERS)
    return rounded(build.center_neighbours(centers, SLABS, spark), "dist_sq")


@query("slab_bounds", with_assigned() + NEIGHBOURS + SLAB_SQL + "SELECT cluster_id, neighbour_id, CAST(slot AS INTEGER) AS slot, round(norm, 6) AS norm, round(lo, 6) AS lo, round(hi, 6) AS hi FROM sl")
def q_slabs(spark, sf):
    assigned, centers = assigned_of(spark, sf)
    return rounded(build.slabs(assigned, centers, SLABS).select("cluster_id", "neighbour_id", "slot", "norm", "lo", "hi"), "norm", "lo", "hi")


@query("slab_rank", with_assigned() + NEIGHBOURS + SLAB_SQL + "SELECT cluster_id, CAST(slot AS INTEGER) AS slot, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY hi - lo, slot) AS INTEGER) AS tightness FROM sl")
def q_slab_rank(spark, sf):
    assigned, centers = assigned_of(spark, sf)
    return build.slab_order(build.slabs(assigned, centers, SLABS)).select("cluster_id", "slot", "tightness")


@query("seeded_sample", f"SELECT vec_id AS id FROM embeddings ORDER BY md5(concat('{build.SEED}:', vec_id)), vec_id LIMIT 80")
def q_sample(spark, sf):
    return build.sample(embeddings(spark, sf), 8).select("id")


@query("kd_split_step", with_assigned() + ", m AS (SELECT cluster_id, median(v[1]) AS cut FROM a GROUP BY cluster_id) SELECT a.cluster_id, round(cut, 6) AS cut, count(*) FILTER (v[1] <= cut) AS n_left, count(*) FILTER (v[1] > cut) AS n_right FROM a JOIN m USING (cluster_id) GROUP BY a.cluster_id, cut")
def q_kd_step(spark, sf):
    assigned, _ = assigned_of(spark, sf)
    x = F.col("vec")[0]
    cuts = assigned.groupBy("cluster_id").agg(F.median(x).alias("cut"))
    j = assigned.join(cuts, "cluster_id")
    return rounded(j.groupBy("cluster_id", "cut").agg(F.count_if(x <= F.col("cut")).alias("n_left"), F.count_if(x > F.col("cut")).alias("n_right")), "cut")


@query("cluster_pair_prune", with_assigned() + f", s AS (SELECT a.cluster_id, any_value(c.v) AS v, max(sqrt(d2)) AS radius FROM a JOIN c USING (cluster_id) GROUP BY a.cluster_id) SELECT x.cluster_id AS a, y.cluster_id AS b, round(sqrt({l2('x.v', 'y.v')}), 6) AS dist, NOT (sqrt({l2('x.v', 'y.v')}) >= x.radius + y.radius - 1.2 OR sqrt({l2('x.v', 'y.v')}) / 2 >= x.radius - 1.2) AS kept FROM s x, s y WHERE x.cluster_id < y.cluster_id")
def q_pair_prune(spark, sf):
    assigned, centers = assigned_of(spark, sf)
    return range_join.cluster_pairs(build.cluster_stats(assigned).join(centers.table(spark), "cluster_id"), -1.2)


@query("assignment_check", "SELECT count(*) AS checked, count(*) FILTER (vec_id % 11 = 0) AS mismatched FROM embeddings WHERE vec_id % 7 = 0")
def q_assignment_check(spark, sf):
    """An assignment that gives every eleventh row its second center."""
    base = embeddings(spark, sf)
    centers = build.stride_seeds(base, CENTERS)
    assigned = build.assign(base, centers, 2).where((F.col("id") % 11 == 0) == (F.col("rank") == 2))
    return metrics.assignment_errors(assigned, centers, 7)


# ---- cascade

EPS = R_FULL**0.5
#: dec: (query_id, cluster_id, n, d2, pre_kept, stage) after prescreen and slab, with pruning radius {eps}.
STAGED = (
    NEIGHBOURS + SLAB_SQL + f""", st AS (SELECT cluster_id, count(*) AS n, max(sqrt(d2)) AS radius FROM a GROUP BY cluster_id),
    qc AS (SELECT q.query_id, q.v, c.cluster_id, {l2("q.v", "c.v")} AS d2, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2("q.v", "c.v")}, c.cluster_id) AS rank FROM q, c),
    qp AS (SELECT q.query_id, cn.cluster_id, cn.slot, ({dot("q.v", "list_transform(list_zip(cn.yv, cn.xv), lambda x: x[1] - x[2])")} - {dot("cn.xv", "list_transform(list_zip(cn.yv, cn.xv), lambda x: x[1] - x[2])")}) / sqrt(cn.dist_sq) AS pos FROM q, cn),
    lb AS (SELECT qp.query_id, qp.cluster_id, max(greatest(0.0, sl.lo - pos, pos - sl.hi)) AS slab_lb FROM qp JOIN sl USING (cluster_id, slot) GROUP BY qp.query_id, qp.cluster_id),
    dec AS (SELECT qc.query_id, qc.v, qc.cluster_id, st.n, qc.rank, qc.d2, CASE WHEN qc.d2 > power({{eps}} + radius, 2) THEN 'prescreen' WHEN slab_lb > {{eps}} THEN 'slab' END AS stage
      FROM qc JOIN st USING (cluster_id) JOIN lb USING (query_id, cluster_id))"""
)
#: Pruning that SQL can follow, at a radius that rejects some clusters.
COARSE, R_COARSE = ("prescreen", "slab"), 0.2


def staged(r_sq: float = R_COARSE, alpha: float = 1.0) -> str:
    return with_assigned() + STAGED.format(eps=r_sq**0.5 / alpha)


@query("prescreen", staged() + "SELECT query_id, cluster_id, stage IS NULL OR stage <> 'prescreen' AS kept FROM dec")
def q_prescreen(spark, sf):
    _, queries, index = indexed(spark, sf)
    found = cascade.prescreen(cascade.candidates(index, queries, cascade.Options()), index.stats, R_COARSE**0.5)
    return found.select("query_id", "cluster_id", F.col("pre_kept").alias("kept"))


@query("slab_lower_bound", staged() + "SELECT query_id, cluster_id, round(slab_lb, 6) AS slab_lb FROM lb")
def q_slab_lb(spark, sf):
    _, queries, index = indexed(spark, sf)
    return rounded(cascade.slab_bounds(cascade.candidates(index, queries, cascade.Options()), index), "slab_lb")


HITS = "SELECT query_id, base_id, round(dist_sq, 6) AS dist_sq FROM hits"


@query("cascade_exact", with_hits(DIM, R_FULL) + HITS)
def q_cascade(spark, sf):
    _, queries, index = indexed(spark, sf)
    return rounded(cascade.range_search(index, queries, R_FULL), "dist_sq")


@query("cascade_without_cells", with_hits(DIM, R_FULL) + HITS)
def q_cascade_toggled(spark, sf):
    _, queries, index = indexed(spark, sf)
    return rounded(cascade.range_search(index, queries, R_FULL, cascade.Options(stages=COARSE)), "dist_sq")


@query("cascade_code_rows", with_hits(DIM, R_FULL) + HITS)
def q_cascade_codes(spark, sf):
    """Vectors are only read for rows that the one-bit bounds keep."""
    _, queries, index = indexed(spark, sf)
    return rounded(cascade.range_search(index, queries, R_FULL, cascade.Options(code_filter="rows")), "dist_sq")


@query("cascade_code_cells", with_hits(DIM, R_FULL) + HITS)
def q_cascade_code_cells(spark, sf):
    """Cells are only read if a one-bit bound of a member keeps them."""
    _, queries, index = indexed(spark, sf)
    return rounded(cascade.range_search(index, queries, R_FULL, cascade.Options(code_filter="cells")), "dist_sq")


def bytes_index(spark, sf, signed: bool) -> tuple[DataFrame, cascade.Index]:
    base = integers(embeddings(spark, sf), signed).withColumn("vec", V.as_double("vec"))
    return as_queries(base), cascade.build_index(base, build.stride_seeds(base, CENTERS), SLABS, 32, 24)


@query("prune_counters", staged() + "SELECT CAST(sum(n) AS BIGINT) AS vecs, CAST(coalesce(sum(n) FILTER (stage = 'prescreen'), 0) AS BIGINT) AS vecs_prescreen, CAST(coalesce(sum(n) FILTER (stage = 'slab'), 0) AS BIGINT) AS vecs_slab, CAST(0 AS BIGINT) AS vecs_pca, CAST(0 AS BIGINT) AS vecs_cell, CAST(coalesce(sum(n) FILTER (stage IS NULL), 0) AS BIGINT) AS vecs_read FROM dec")
def q_counters(spark, sf):
    return coarse_counters(spark, sf)


def coarse_counters(spark, sf) -> DataFrame:
    _, queries, index = indexed(spark, sf)
    counters = cascade.prune_counters(cascade.decisions(cascade.prune(index, queries, R_COARSE, cascade.Options(stages=COARSE))))
    return counters.select(*[c for c in counters.columns if c.startswith("vecs")])


@query("prune_counters_all_stages", staged() + "SELECT CAST(sum(n) AS BIGINT) AS vecs, CAST(coalesce(sum(n) FILTER (stage = 'prescreen'), 0) AS BIGINT) AS vecs_prescreen, CAST(coalesce(sum(n) FILTER (stage = 'slab'), 0) AS BIGINT) AS vecs_slab, CAST(coalesce(sum(n) FILTER (stage IS NULL), 0) AS BIGINT) AS vecs_later FROM dec")
def q_counters_all(spark, sf):
    """The stages that SQL can't follow share what the first two leave."""
    _, queries, index = indexed(spark, sf)
    counters = cascade.prune_counters(cascade.decisions(cascade.prune(index, queries, R_COARSE)))
    return counters.select("vecs", "vecs_prescreen", "vecs_slab", (F.col("vecs_pca") + F.col("vecs_cell") + F.col("vecs_read")).alias("vecs_later"))


@query("later_stages_see_less", "SELECT true AS less")
def q_less(spark, sf):
    """Whether cells were only bounded in clusters that earlier stages kept, and only those kept cells were read."""
    _, queries, index = indexed(spark, sf)
    search = cascade.prune(index, queries, R_COARSE)
    kept = search.clusters.where("stage is null").select("query_id", "cluster_id")
    strays = search.cells.join(kept, ["query_id", "cluster_id"], "left_anti").count()
    seen, all_ = search.cells.count(), search.clusters.agg(F.sum("n_cells")).first()[0]
    return spark.createDataFrame([(strays == 0 and seen < all_,)], "less boolean")


@query("partition_identity", "SELECT count(*) * (SELECT count(*) FROM embeddings) + 1 AS vecs FROM embeddings WHERE vec_id % 50 = 0")
def q_identity(spark, sf):
    """Counters of a search, and the same with one vector too many: only these don't add up."""
    counters = coarse_counters(spark, sf)
    wrong = counters.withColumn("vecs", F.col("vecs") + 1)
    return metrics.partition_errors(counters.unionByName(wrong)).select("vecs")


@query("bound_soundness", "SELECT CAST(0 AS BIGINT) AS query_id, CAST(0 AS BIGINT) AS base_id WHERE false")
def q_soundness(spark, sf):
    """Pairs that are nearer than a bound of their cluster or cell says."""
    _, queries, index = indexed(spark, sf)
    found = cascade.candidates(index, queries, cascade.Options())
    boxed = cascade.box_bounds(found, index)
    pca = boxed.groupBy("query_id", "cluster_id").agg(F.min("pca_lb").alias("pca_lb"))
    bounds = cascade.cell_bounds(boxed, index).join(pca, ["query_id", "cluster_id"]).join(cascade.slab_bounds(found, index), ["query_id", "cluster_id"])
    both = bounds.join(index.members.select("cluster_id", "cell_id", "id", F.col("vec").alias("bv")), ["cluster_id", "cell_id"]).join(queries, "query_id")
    bound = F.greatest("pca_lb", "cell_lb", "slab_lb")
    return both.where(bound > V.l2("bv", "vec") + 1e-5).select("query_id", F.col("id").alias("base_id"))


@query("io_bytes", staged() + f"SELECT CAST(sum(n) * {DIM * 4} AS BIGINT) AS bytes_baseline, CAST(coalesce(sum(n) FILTER (stage IS NULL), 0) * {DIM * 4} AS BIGINT) AS bytes_read, round(1 - coalesce(sum(n) FILTER (stage IS NULL), 0) / sum(n), 6) AS io_reduction FROM dec")
def q_io(spark, sf):
    _, queries, index = indexed(spark, sf)
    return metrics.io_bytes(cascade.decisions(cascade.prune(index, queries, R_COARSE, cascade.Options(stages=COARSE))), DIM)


@query("touched_clusters", staged() + "SELECT query_id, count(DISTINCT cluster_id) AS n_clusters FROM dec WHERE stage IS NULL OR stage <> 'prescreen' GROUP BY query_id")
def q_touched(spark, sf):
    _, queries, index = indexed(spark, sf)
    found = cascade.prescreen(cascade.candidates(index, queries, cascade.Options()), index.stats, R_COARSE**0.5)
    return metrics.touched_clusters(found.where("pre_kept"))


#: tr: a search's trace: (query_id, n_clusters, vecs, vecs_read).
TRACE = ", tr AS (SELECT query_id, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS vecs, CAST(coalesce(sum(n) FILTER (stage IS NULL), 0) AS BIGINT) AS vecs_read FROM dec GROUP BY query_id)"


def trace_of(spark, sf) -> DataFrame:
    _, queries, index = indexed(spark, sf)
    return metrics.search_trace(cascade.prune(index, queries, R_COARSE, cascade.Options(stages=COARSE)).clusters)


@query("by_result_class", staged() + TRACE + f", hc AS (SELECT q.query_id, count(b.id) AS n_hits FROM q LEFT JOIN b ON {l2('q.v', 'b.v')} <= {R_FULL} GROUP BY q.query_id) SELECT n_hits <= 1 AS alone, count(*) AS n_queries, round(avg(n_clusters), 6) AS mean_n_clusters, round(avg(vecs), 6) AS mean_vecs, round(avg(vecs_read), 6) AS mean_vecs_read FROM hc JOIN tr USING (query_id) GROUP BY 1")
def q_by_class(spark, sf):
    """Traces of queries that find nothing but themselves, and of others."""
    others = counts_of(spark, sf).withColumn("n_hits", F.col("n_hits") - 1)
    return metrics.by_result_class(others.withColumn("n_hits", F.greatest("n_hits", F.lit(0))).join(trace_of(spark, sf), "query_id")).withColumnRenamed("no_hits", "alone")


def alpha_sql(alpha: float) -> str:
    found = f"SELECT count(*) FROM dec JOIN a USING (cluster_id) WHERE stage IS NULL AND {l2('dec.v', 'a.v')} <= {R_FULL}"
    return f"SELECT * FROM ({staged(R_FULL, alpha)}, f AS ({found}), t AS (SELECT count(*) AS n FROM q, b WHERE {l2('q.v', 'b.v')} <= {R_FULL}) SELECT (SELECT * FROM f) AS n_found, n AS n_true, round((SELECT * FROM f) / n, 6) AS count_recall, round((SELECT * FROM f) / n, 6) AS set_recall, CAST({alpha} AS DOUBLE) AS alpha FROM t)"


ALPHAS = (1.0, 3.0, 8.0, 20.0)


@query("alpha_recall", " UNION ALL ".join(map(alpha_sql, ALPHAS)))
def q_alpha(spark, sf):
    base, queries, index = indexed(spark, sf)
    truth = range_join.range_join(base, queries, R_FULL)
    return one([metrics.recall(cascade.range_search(index, queries, R_FULL, cascade.Options(alpha=a, stages=COARSE)), truth).withColumn("alpha", F.lit(a)) for a in ALPHAS])


def recall_sql(n: int) -> str:
    return f"""SELECT {n} AS run, round((SELECT count(*) FROM dec JOIN a USING (cluster_id) WHERE dec.rank <= {n} AND {l2('dec.v', 'a.v')} <= {R_FULL}) / (SELECT count(*) FROM q, b WHERE {l2('q.v', 'b.v')} <= {R_FULL}), 6) AS recall,
      round(1e6 / (SELECT sum(n) FROM dec WHERE rank <= {n}), 6) AS qps"""


#: Searches of some numbers of candidate clusters: (run, recall, qps), with searches for a million vectors read.
PROBES = (1, 2, 4, 8, 12, 16)
RUN_SQL = staged(R_FULL) + ", r AS (" + " UNION ALL ".join(map(recall_sql, PROBES)) + " UNION ALL SELECT 99, 0.0, 0.5 UNION ALL SELECT 98, 0.0, 1e9)"


def runs_of(spark, sf) -> DataFrame:
    """Real runs, a run that others beat and one that is fast and finds nothing. Each is made once, however often read."""
    base, queries, index = indexed(spark, sf)
    truth = materialize(range_join.range_join(base, queries, R_FULL), "true-pairs")
    out = [spark.createDataFrame([(99, 0.0, 0.5), (98, 0.0, 1e9)], "run int, recall double, qps double")]
    for n in PROBES:
        options = cascade.Options(n_candidates=n, stages=())
        search = cascade.prune(index, queries, R_FULL, options)
        found = metrics.recall(cascade.hits(index, search.cells, queries, R_FULL, options), truth).select("set_recall")
        read = search.clusters.agg(F.round(1e6 / F.sum("n"), 6).alias("qps"))
        out.append(found.join(read).select(F.lit(n).alias("run"), F.col("set_recall").alias("recall"), "qps"))
    return materialize(one(out), "runs")


@query("pareto_front", RUN_SQL + "SELECT run, CAST(recall AS DOUBLE) AS recall, CAST(qps AS DOUBLE) AS qps FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.recall >= r.recall AND o.qps >= r.qps AND (o.recall > r.recall OR o.qps > r.qps))")
def q_pareto(spark, sf):
    return metrics.pareto_front(runs_of(spark, sf))


@query("pareto_csv", RUN_SQL + "SELECT run, CAST(recall AS DOUBLE) AS recall, CAST(qps AS DOUBLE) AS qps FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.recall >= r.recall AND o.qps >= r.qps AND (o.recall > r.recall OR o.qps > r.qps))")
def q_pareto_csv(spark, sf):
    from vicinal.plans.shared import new_path

    path = new_path(spark, "pareto")
    metrics.write_rows(metrics.pareto_front(runs_of(spark, sf)), path, "recall")
    return spark.read.csv(path, header=True, schema="run int, recall double, qps double")


@query("run_medians", staged() + f"SELECT cluster_id, round(median(d2), 6) AS median_value FROM dec WHERE rank <= {NPROBE} GROUP BY cluster_id")
def q_medians(spark, sf):
    """Of each cluster the median squared distance of queries that have it among their nearest."""
    _, queries, index = indexed(spark, sf)
    return metrics.run_medians(cascade.candidates(index, queries, cascade.Options(n_candidates=NPROBE)), "cluster_id", "dist_sq")


@query("recall_by_candidates", with_assigned() + f", qc AS (SELECT * FROM (SELECT q.query_id, q.v, c.cluster_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2('q.v', 'c.v')}, c.cluster_id) AS rank FROM q, c) WHERE rank <= {NPROBE}), f AS (SELECT qc.query_id, a.id FROM qc JOIN a USING (cluster_id) WHERE {l2('qc.v', 'a.v')} <= {R_FULL}), t AS (SELECT count(*) AS n FROM q, b WHERE {l2('q.v', 'b.v')} <= {R_FULL}) SELECT (SELECT count(*) FROM f) AS n_found, n AS n_true, round((SELECT count(*) FROM f) / n, 6) AS count_recall, round((SELECT count(*) FROM f) / n, 6) AS set_recall FROM t")
def q_recall(spark, sf):
    base, queries, index = indexed(spark, sf)
    found = cascade.range_search(index, queries, R_FULL, cascade.Options(n_candidates=NPROBE))
    return metrics.recall(found, range_join.range_join(base, queries, R_FULL))


@query("cluster_scan", with_assigned() + "SELECT id, cluster_id FROM a WHERE cluster_id IN (1, 3)")
def q_scan(spark, sf):
    """Some clusters of an index on disk: folders and row groups of others are skipped."""
    return spark.read.parquet(f"{stored_index(spark, sf)}/base").where("band in (1, 3) and cluster_id in (1, 3)").select("id", F.col("cluster_id").cast("int"))


# ---- classifiers

EMPTY_SQL = with_assigned() + f""", qc AS (SELECT * FROM (SELECT q.query_id, q.v, c.cluster_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2("q.v", "c.v")}, c.cluster_id) AS rank FROM q, c) WHERE rank <= {NPROBE}),
    e AS (SELECT qc.query_id, min({l2("qc.v", "a.v")}) AS min_dist_sq FROM qc JOIN a USING (cluster_id) WHERE a.id % 50 <> 0 GROUP BY qc.query_id),
    d AS (SELECT q.query_id, min_dist_sq, coalesce(min_dist_sq > {R_NEAR}, false) AS is_empty FROM q LEFT JOIN e USING (query_id)),
    t AS (SELECT q.query_id, count(b.id) AS n_hits FROM q LEFT JOIN b ON b.id % 50 <> 0 AND {l2("q.v", "b.v")} <= {R_NEAR} GROUP BY q.query_id)"""


def decided_of(spark, sf):
    """A classifier's decisions and the truth, for rows other than the queries."""
    base = embeddings(spark, sf)
    centers = build.stride_seeds(base, CENTERS)
    queries, rest = as_queries(base), base.where("id % 50 <> 0")
    decided = metrics.empty_by_probe(build.assign(rest, centers), centers, queries, R_NEAR, NPROBE)
    return queries, decided, range_join.count_per_query(queries, range_join.range_join(rest, queries, R_NEAR))


@query("emptiness_exact_nprobe", EMPTY_SQL + "SELECT query_id, round(min_dist_sq, 6) AS min_dist_sq, is_empty FROM d")
def q_empty(spark, sf):
    return rounded(decided_of(spark, sf)[1], "min_dist_sq")


@query("emptiness_1nn", with_tables() + f"SELECT q.query_id, round(sqrt(min({l2('b.v', 'q.v')})), 6) AS dist, sqrt(min({l2('b.v', 'q.v')})) > {R_NEAR ** 0.5} + 0.001 AS is_empty FROM q, b WHERE b.id % 50 <> 0 GROUP BY q.query_id")
def q_empty_1nn(spark, sf):
    base = embeddings(spark, sf)
    return rounded(metrics.empty_by_nearest(knn.one_nn(base.where("id % 50 <> 0"), as_queries(base)), R_NEAR**0.5, 0.001), "dist")


@query("survivors_semi", EMPTY_SQL + "SELECT query_id FROM d WHERE NOT is_empty")
def q_survivors(spark, sf):
    queries, decided, _ = decided_of(spark, sf)
    return metrics.survivors(queries, decided).select("query_id")


@query("skipped_anti", EMPTY_SQL + "SELECT query_id FROM d WHERE is_empty")
def q_skipped(spark, sf):
    queries, decided, _ = decided_of(spark, sf)
    return metrics.skipped(queries, decided).select("query_id")


@query("nonempty_workload", EMPTY_SQL + "SELECT query_id FROM t WHERE n_hits > 0")
def q_nonempty(spark, sf):
    queries, _, truth = decided_of(spark, sf)
    return queries.join(truth.where("n_hits > 0"), "query_id", "left_semi").select("query_id")


@query("oracle_confusion", EMPTY_SQL + "SELECT count(*) AS n_queries, count(*) FILTER (is_empty) AS n_skipped, count(*) FILTER (is_empty AND n_hits > 0) AS n_false_empty, CAST(coalesce(sum(n_hits) FILTER (is_empty), 0) AS BIGINT) AS hits_lost, CAST(sum(n_hits) AS BIGINT) AS hits, round(count(*) FILTER (is_empty) / count(*), 6) AS skip_rate, round(count(*) FILTER (is_empty AND n_hits > 0) / nullif(count(*) FILTER (n_hits > 0), 0), 6) AS false_empty_rate, round(coalesce(sum(n_hits) FILTER (is_empty), 0) / nullif(sum(n_hits), 0), 6) AS hit_loss, round(count(*) FILTER (is_empty AND n_hits = 0) / nullif(count(*) FILTER (n_hits = 0), 0), 6) AS zero_short_circuit_rate FROM d JOIN t USING (query_id)")
def q_confusion(spark, sf):
    _, decided, truth = decided_of(spark, sf)
    return metrics.confusion(decided, truth)


EXACT_SQL = f", x AS (SELECT q.query_id, min({l2('b.v', 'q.v')}) AS least FROM q, b WHERE b.id % 50 <> 0 GROUP BY q.query_id)"


def estimated_of(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(query_id, dist) of the nearest row in a few clusters, and of the nearest of all."""
    _, decided, _ = decided_of(spark, sf)
    base = embeddings(spark, sf)
    exact = knn.one_nn(base.where("id % 50 <> 0"), as_queries(base))
    return decided.select("query_id", F.sqrt("min_dist_sq").alias("dist")), exact.select("query_id", F.sqrt("dist_sq").alias("dist"))


@query("recall_at_1", EMPTY_SQL + EXACT_SQL + "SELECT round(avg(CASE WHEN sqrt(min_dist_sq) <= sqrt(least) * 1.0001 + 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1 FROM e JOIN x USING (query_id)")
def q_recall_at_1(spark, sf):
    return metrics.recall_at_1(*estimated_of(spark, sf))


@query("nearest_bench_csv", EMPTY_SQL + EXACT_SQL + "SELECT query_id, round(sqrt(least), 6) AS dist, round(sqrt(min_dist_sq), 6) AS estimate, sqrt(min_dist_sq) <= sqrt(least) * 1.0001 + 1e-6 AS found FROM e JOIN x USING (query_id)")
def q_nearest_bench(spark, sf):
    """The benchmark of a nearest-neighbour estimate, written as CSV and read back."""
    from vicinal.plans.shared import new_path

    path = new_path(spark, "bench")
    metrics.write_trace(metrics.nearest_bench(*estimated_of(spark, sf)), path)
    return rounded(spark.read.csv(path, header=True, schema="query_id long, dist double, estimate double, found boolean"), "dist", "estimate")


@query("set_overlap", with_assigned() + f", qc AS (SELECT * FROM (SELECT q.query_id, c.cluster_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2('q.v', 'c.v')}, c.cluster_id) AS rank FROM q, c)) SELECT count(*) FILTER (rank <= 3) AS n_a, count(*) FILTER (rank <= 5) AS n_b, count(*) FILTER (rank <= 3) AS n_both, count(*) FILTER (rank IN (4, 5)) AS n_one FROM qc")
def q_overlap(spark, sf):
    base = embeddings(spark, sf)
    centers = build.stride_seeds(base, CENTERS)
    near = build.assign(base.where("id % 50 = 0"), centers, 5).select(F.col("id").alias("query_id"), "cluster_id", "rank")
    return metrics.set_overlap(near.where("rank <= 3"), near, ["query_id", "cluster_id"])


@query("hit_set_equality", "SELECT CAST(0 AS BIGINT) AS query_id, CAST(0 AS BIGINT) AS base_id WHERE false")
def q_set_equality(spark, sf):
    base, queries, index = indexed(spark, sf)
    a, b = (x.select("query_id", "base_id") for x in (cascade.range_search(index, queries, R_FULL), range_join.range_join(base, queries, R_FULL)))
    return a.exceptAll(b).unionAll(b.exceptAll(a))


# ---- vector functions


@query("l2_normalize", with_tables() + f"SELECT id, list_transform(v, lambda x: round(x / (sqrt({own('v')}) + 1e-12), 6)) AS vec FROM b")
def q_normalize(spark, sf):
    return embeddings(spark, sf).select("id", F.transform(V.normalize("vec"), lambda x: V.rounded(x)).alias("vec"))


@query("inner_products", with_tables() + f"SELECT q.query_id, b.id AS base_id, round({dot('b.v', 'q.v')}, 6) AS ip, round(-{dot('b.v', 'q.v')}, 6) AS neg_ip, round(abs({dot('b.v', 'q.v')}), 6) AS abs_ip, round(-abs({dot('b.v', 'q.v')}), 6) AS neg_abs_ip, round(-{l2('b.v', 'q.v')}, 6) AS neg_l2 FROM b, q")
def q_inner(spark, sf):
    """Every query against every row, the queries in one broadcast block."""
    base = range_join.spread(embeddings(spark, sf))
    blocks = []
    for ids, matrix in range_join.query_blocks(as_queries(base)):
        items = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, matrix, strict=True)], "query_id long, qv array<double>")
        j = base.join(F.broadcast(items), F.lit(True))
        f = {"ip": V.dot, "neg_ip": V.neg_dot, "abs_ip": V.abs_dot, "neg_abs_ip": V.neg_abs_dot, "neg_l2": V.neg_l2_sq}
        blocks.append(j.select("query_id", F.col("id").alias("base_id"), *(F.round(g("vec", "qv"), 6).alias(n) for n, g in f.items())))
    return one(blocks)


@query("norms", with_tables() + f"SELECT id, round({own('v')}, 6) AS norm_sq, round(sqrt({own('v')}), 6) AS norm, round({own('v')} + {own('v')} - 2 * {dot('v', 'v')}, 6) AS self_dist FROM b")
def q_norms(spark, sf):
    n = V.norm_sq("vec")
    return embeddings(spark, sf).select("id", F.round(n, 6).alias("norm_sq"), F.round(V.norm("vec"), 6).alias("norm"), F.round(V.l2_sq_via_norms(n, n, V.dot("vec", "vec")), 6).alias("self_dist"))


@query("point_center_distance", with_assigned() + "SELECT id, cluster_id, round(sqrt(d2), 6) AS dist FROM a")
def q_point_center(spark, sf):
    assigned, centers = assigned_of(spark, sf)
    table = centers.table(spark).select("cluster_id", F.col("vec").alias("cv"))
    return assigned.join(F.broadcast(table), "cluster_id").select("id", "cluster_id", F.round(V.l2("vec", "cv"), 6).alias("dist"))


LOSS = "list_transform(list_zip(a.v, c.v), lambda x: x[1] - x[2])"


@query("anisotropic_loss", with_assigned() + f", r AS (SELECT a.id, a.v, {LOSS} AS r FROM a JOIN c USING (cluster_id)), s AS (SELECT id, power({dot('r', 'v')}, 2) / ({own('v')} + 1e-12) AS along, {own('r')} AS whole FROM r) SELECT id, round({ETA} * along + greatest(0.0, whole - along), 6) AS loss FROM s")
def q_anisotropic_loss(spark, sf):
    assigned, centers = assigned_of(spark, sf)
    table = centers.table(spark).select("cluster_id", F.col("vec").alias("cv"))
    return assigned.join(F.broadcast(table), "cluster_id").select("id", F.round(V.anisotropic_loss("vec", "cv", ETA), 6).alias("loss"))


def int_sql(component: str, r_sq: int) -> str:
    return f"""WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(round({component}) AS BIGINT)) AS v FROM embeddings),
    p AS (SELECT q.id AS query_id, b.id AS base_id, CAST({l2("b.v", "q.v")} AS BIGINT) AS dist_sq FROM b, b q WHERE q.id % 50 = 0) SELECT * FROM p WHERE dist_sq <= {r_sq}"""


def int_join(spark, sf, signed: bool, r_sq: int):
    base = integers(embeddings(spark, sf), signed)
    pairs = range_join.range_join(base.withColumn("vec", V.as_double("vec")), as_queries(base.withColumn("vec", V.as_double("vec"))), r_sq)
    # sums of squares of integers are exact in doubles; distances are taken again in integers
    b, q = base.select(F.col("id").alias("base_id"), F.col("vec").alias("bv")), base.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"))
    exact = pairs.select("query_id", "base_id").join(b, "base_id").join(q, "query_id")
    return exact.select("query_id", "base_id", V.int_l2_sq("bv", "qv").alias("dist_sq")).where(F.col("dist_sq") <= r_sq)


@query("int8_l2", int_sql("CAST(x AS DOUBLE) * 127", 25000))
def q_int8(spark, sf):
    return int_join(spark, sf, True, 25000)


@query("uint8_l2", int_sql("(CAST(x AS DOUBLE) + 1) * 127.5", 25000))
def q_uint8(spark, sf):
    return int_join(spark, sf, False, 25000)


def int_cascade(spark, sf, signed: bool) -> DataFrame:
    queries, index = bytes_index(spark, sf, signed)
    return cascade.range_search(index, queries, 25000).withColumn("dist_sq", F.col("dist_sq").cast("long"))


@query("cascade_int8", int_sql("CAST(x AS DOUBLE) * 127", 25000))
def q_cascade_int8(spark, sf):
    """Bytes through the index: sums of squares of whole numbers are exact in doubles."""
    return int_cascade(spark, sf, True)


@query("cascade_uint8", int_sql("(CAST(x AS DOUBLE) + 1) * 127.5", 25000))
def q_cascade_uint8(spark, sf):
    return int_cascade(spark, sf, False)


@query("byte_sums", "WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(round((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT)) AS v FROM embeddings) SELECT id, CAST(list_sum(v) AS BIGINT) AS byte_sum, CAST(list_sum(list_transform(v, lambda x: x * x)) AS BIGINT) AS byte_norm_sq FROM b")
def q_byte_sums(spark, sf):
    return integers(embeddings(spark, sf), False).select("id", V.byte_sum("vec").alias("byte_sum"), V.byte_norm_sq("vec").alias("byte_norm_sq"))


@query("pack_ids", "SELECT vec_id AS id, (CAST(label AS BIGINT) << 48) | vec_id AS packed, CAST(label AS BIGINT) AS grp, vec_id AS local FROM embeddings")
def q_pack(spark, sf):
    packed = embeddings(spark, sf).select("id", V.pack_id(F.col("label"), F.col("id")).alias("packed"))
    return packed.select("id", "packed", V.unpack_group("packed").alias("grp"), V.unpack_local(F.col("packed")).alias("local"))


@query("finite_queries", with_tables() + "SELECT query_id, query_id % 100 <> 0 AS is_finite FROM q")
def q_finite(spark, sf):
    """Some queries have a component that is infinite or no number."""
    odd = F.when(F.col("query_id") % 200 == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    vec = F.when(F.col("query_id") % 100 == 0, F.transform("vec", lambda x, i: F.when(i == 5, odd).otherwise(x))).otherwise(F.col("vec"))
    return as_queries(embeddings(spark, sf)).withColumn("vec", vec).select("query_id", V.is_finite("vec").alias("is_finite"))


@query("sql_functions", with_tables() + f"SELECT id, round({own('v')}, 6) AS d, round(sqrt({own('v')}), 6) AS n FROM b")
def q_sql_functions(spark, sf):
    V.register(spark)
    return embeddings(spark, sf).selectExpr("id", "round(dot(vec, vec), 6) AS d", "round(l2_norm(vec), 6) AS n")


# ---- codes, sources and sinks


@query("one_bit_codes", with_assigned() + "SELECT id, cluster_id, CAST(8 AS INTEGER) AS n_bytes, CAST(64 AS INTEGER) AS n_bytes8, round(d2, 6) AS f_add FROM a WHERE d2 > 0")
def q_codes(spark, sf):
    """A code's first factor is the squared length of the residual, which the rotation keeps."""
    _, _, index = indexed(spark, sf)
    found = index.codes.where("f_add > 0").select("id", "cluster_id", F.octet_length("bits").alias("n_bytes"), F.octet_length("bits8").alias("n_bytes8"), "f_add")
    return rounded(found, "f_add")


def asked_of(spark, sf) -> tuple[DataFrame, cascade.Index]:
    """(query_id, qv, cluster_id): the queries and their nearest clusters."""
    _, queries, index = indexed(spark, sf)
    found = cascade.candidates(index, queries, cascade.Options(n_candidates=NPROBE))
    return found.select("query_id", F.col("vec").alias("qv"), "cluster_id"), index


PROBED = with_assigned() + f", qc AS (SELECT * FROM (SELECT q.query_id, q.v, c.cluster_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2('q.v', 'c.v')}, c.cluster_id) AS rank FROM q, c) WHERE rank <= {NPROBE}), m AS (SELECT qc.query_id, qc.cluster_id, a.id, {l2('qc.v', 'a.v')} AS dist_sq FROM qc JOIN a USING (cluster_id))"


@query("code_bounds", PROBED + "SELECT CAST(bits AS INTEGER) AS bits, (SELECT count(*) FROM m) AS n, true AS lb_holds, true AS ub_holds FROM (VALUES (1), (8)) t(bits)")
def q_code_bounds(spark, sf):
    """One row for one-bit and eight-bit codes: pairs, and whether no more than one bound in a thousand is wrong."""
    asked, index = asked_of(spark, sf)
    out = []
    for extra, bits in ((False, 1), (True, 8)):
        found = codes.bounds(index.codes, index.centers, asked, extra).join(asked, ["query_id", "cluster_id"])
        found = found.join(index.members.select("id", F.col("vec").alias("bv")), "id").withColumn("d", V.l2_sq("qv", "bv"))
        few = lambda wrong: F.count_if(wrong) <= F.count(F.lit(1)) / 1000
        out.append(found.agg(F.lit(bits).alias("bits"), F.count(F.lit(1)).alias("n"), few(F.col("lb") > F.col("d") + 1e-9).alias("lb_holds"), few(F.col("ub") < F.col("d") - 1e-9).alias("ub_holds")))
    return one(out)


@query("code_row_filter", PROBED + f"SELECT query_id, id FROM m WHERE dist_sq <= {R_FULL}")
def q_code_filter(spark, sf):
    """Hits among the rows that the codes keep: none is lost."""
    _, queries, index = indexed(spark, sf)
    asked = cascade.candidates(index, queries, cascade.Options(n_candidates=NPROBE)).select("query_id", "cluster_id")
    read = asked.join(index.cells.select("cluster_id", "cell_id"), "cluster_id")
    kept = codes.filtered(index.codes, index.centers, tasks.deal(read, queries, index.stats, index.cells), R_FULL)
    both = kept.join(queries.select("query_id", F.col("vec").alias("qv")), "query_id").join(index.members.select("id", F.col("vec").alias("bv")), "id")
    return both.where(V.l2_sq("qv", "bv") <= R_FULL).select("query_id", "id")


@query("code_cell_filter", PROBED + f"SELECT DISTINCT query_id, cluster_id FROM m WHERE dist_sq <= {R_FULL}")
def q_code_cells(spark, sf):
    """Clusters of cells that the codes keep and that hold a hit: none is lost."""
    asked, index = asked_of(spark, sf)
    kept = codes.cell_filter(codes.bounds(index.codes, index.centers, asked), R_FULL).join(asked, ["query_id", "cluster_id"])
    both = kept.join(index.members.select("cluster_id", "cell_id", F.col("vec").alias("bv")), ["cluster_id", "cell_id"])
    return both.where(V.l2_sq("qv", "bv") <= R_FULL).select("query_id", "cluster_id").distinct()


@query("least_code_bound", PROBED + "SELECT query_id, true AS below FROM m GROUP BY query_id")
def q_least_bound(spark, sf):
    """Whether the least eight-bit bound of a query is below its least distance in the same clusters, and by little."""
    asked, index = asked_of(spark, sf)
    found = codes.bounds(index.codes, index.centers, asked, True).join(asked, ["query_id", "cluster_id"]).join(index.members.select("id", F.col("vec").alias("bv")), "id")
    least = found.groupBy("query_id").agg(F.min("lb").alias("lb"), F.min(V.l2_sq("qv", "bv")).alias("d"))
    return least.select("query_id", F.col("lb").between(F.col("d") - 0.2, F.col("d") + 1e-9).alias("below"))


#: Far from any query's own distance 0, so that near bounds decide.
@query("emptiness_codes", EMPTY_SQL + "SELECT query_id, is_empty FROM d WHERE abs(min_dist_sq - {R}) > 0.2".replace("{R}", str(R_NEAR)))
def q_code_emptiness(spark, sf):
    """Decisions by codes, where the nearest distance is not so near the radius that eight bits can't tell."""
    base = embeddings(spark, sf)
    queries, rest = as_queries(base), base.where("id % 50 <> 0")
    centers = build.stride_seeds(base, CENTERS)
    assigned = build.assign(rest, centers)
    found = codes.one_bit_codes(assigned.withColumn("cell_id", F.lit(0)), centers)
    clear = metrics.empty_by_probe(assigned, centers, queries, R_NEAR, NPROBE).where(F.abs(F.col("min_dist_sq") - R_NEAR) > 0.2)
    return codes.emptiness(found, centers, queries, R_NEAR, NPROBE).join(clear.select("query_id"), "query_id")


@query("sparse_center_products", with_tables() + NEIGHBOURS + f"SELECT q.query_id, c.cluster_id, round({dot('q.v', 'c.v')}, 6) AS dot FROM q, c WHERE c.cluster_id = 1 OR c.cluster_id IN (SELECT neighbour_id FROM cn WHERE cluster_id = 1)")
def q_sparse_products(spark, sf):
    """Products of the queries with a cluster's center and its slabs' neighbours alone."""
    _, queries, index = indexed(spark, sf)
    wanted = index.slabs.where("cluster_id = 1").select(F.explode(F.array("cluster_id", "neighbour_id")).alias("cluster_id"))
    return rounded(build.center_products(queries, index.centers, queries.select("query_id").join(F.broadcast(wanted))), "dot")


def quantised_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: CAST(round(x / (list_max(list_transform({v}, lambda y: abs(y))) / 127)) AS BIGINT))"


@query("quantised_center_products", with_tables() + f", qq AS (SELECT query_id, list_max(list_transform(v, lambda y: abs(y))) / 127 AS s, {quantised_sql('v')} AS v FROM q), cc AS (SELECT cluster_id, list_max(list_transform(v, lambda y: abs(y))) / 127 AS s, {quantised_sql('v')} AS v FROM c) SELECT qq.query_id, cc.cluster_id, round({dot('qq.v', 'cc.v')} * qq.s * cc.s, 6) AS dot FROM qq, cc")
def q_quantised_products(spark, sf):
    _, queries, index = indexed(spark, sf)
    return rounded(build.quantised_products(queries, index.centers), "dot")


@query("knn_inner_product", with_tables() + f"SELECT * FROM (SELECT q.query_id, b.id AS base_id, round(-{dot('b.v', 'q.v')}, 6) AS dist_sq, row_number() OVER (PARTITION BY q.query_id ORDER BY -{dot('b.v', 'q.v')}, b.id) AS rank FROM b, q) WHERE rank <= {K}")
def q_knn_dot(spark, sf):
    base = embeddings(spark, sf)
    return rounded(knn.knn(base, as_queries(base), K, "neg_dot"), "dist_sq")


@query("pivot_join", with_hits(64, R_FULL) + HITS)
def q_pivot_join(spark, sf):
    """The join of tables that are both too large to broadcast."""
    base = embeddings(spark, sf)
    return rounded(range_join.pivot_join(base, as_queries(base), R_FULL, chunk=100), "dist_sq")


@query("fbin_roundtrip", "SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS vec FROM embeddings WHERE vec_id >= 100")
def q_fbin(spark, sf):
    """Writes a vector file and reads a range of it, on storage that driver and tasks share."""
    from vicinal.plans.shared import new_path
    from vicinal.sources import vector_files

    vector_files.register(spark)
    path = new_path(spark, "vectors").removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    path = f"{path}-{uuid.uuid4().hex}.fbin"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    rows.orderBy("id").write.format("fbin").option("path", path).mode("append").save()
    found = spark.read.format("fbin").option("path", path).option("rangeBytes", "65536").load().where("id >= 100")
    return found.select("id", F.transform("vec", lambda x: V.rounded(x.cast("double"))).alias("vec"))


@query("index_check", "SELECT CAST(NULL AS VARCHAR) AS what, CAST(NULL AS INTEGER) AS cluster_id WHERE false")
def q_index_check(spark, sf):
    return cascade.check_index(spark, stored_index(spark, sf))


@query("index_check_of_faults", "SELECT * FROM (VALUES ('schema version', NULL), ('cluster size', 2), ('cell size', 2), ('model size', 4), ('cell bounds', 5), ('cluster bounds', 6)) t(what, cluster_id)")
def q_index_faults(spark, sf):
    """An index with a member of cluster 2 missing, wrong sizes and bounds elsewhere, and an old version."""
    from vicinal.plans.shared import new_path

    good, bad = stored_index(spark, sf), new_path(spark, "bad-index")
    read = lambda t: spark.read.parquet(f"{good}/{t}")
    least = read("base").where("cluster_id = 2").agg(F.min("id")).first()[0]
    at = lambda c, cluster, wrong: F.when(F.col("cluster_id") == cluster, wrong).otherwise(F.col(c)).alias(c)
    flip = lambda df, cluster: df.withColumns({"lo": at("lo", cluster, F.col("hi")), "hi": at("hi", cluster, F.transform("lo", lambda x: x - 1))})
    read("base").where(F.col("id") != least).write.parquet(f"{bad}/base")
    flip(read("cells"), 5).write.parquet(f"{bad}/cells")
    flip(read("models").withColumn("n", at("n", 4, F.col("n") + 1)), 6).write.parquet(f"{bad}/models")
    read("clusters").write.parquet(f"{bad}/clusters")
    read("index_meta").withColumn("schema_version", F.lit(0)).write.parquet(f"{bad}/index_meta")
    return cascade.check_index(spark, bad)


@query("cell_scan", with_assigned() + "SELECT cluster_id, count(*) AS n, round(sum(v[1]), 6) AS payload FROM a WHERE cluster_id IN (0, 2) GROUP BY cluster_id")
def q_cell_scan(spark, sf):
    """All cells of two clusters of an index on disk, read by (cluster, cell) from a plan of cells to read."""
    _, _, index = indexed(spark, sf)
    plan = index.cells.where("cluster_id in (0, 2)").select("cluster_id", "cell_id")
    rows = index.members.join(F.broadcast(plan), ["cluster_id", "cell_id"])
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("vec")[0]), 6).alias("payload"))


@query("member_order", "SELECT CAST(0 AS BIGINT) AS id WHERE false")
def q_member_order(spark, sf):
    """Members of an index on disk that are out of order within a file: by cluster, cell and id."""
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{stored_index(spark, sf)}/base").select("id", "cluster_id", "cell_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("place"))
    before = F.lag(F.struct("cluster_id", "cell_id", "id")).over(Window.partitionBy("f").orderBy("place"))
    return rows.withColumn("before", before).where(F.col("before") > F.struct("cluster_id", "cell_id", "id")).select("id")


@query("hits_csv", with_hits(64, R_FULL) + "SELECT query_id, base_id AS original_base_id, round(dist_sq, 6) AS distance FROM hits")
def q_hits_csv(spark, sf):
    from vicinal.plans.shared import new_path

    base, path = embeddings(spark, sf), new_path(spark, "hits")
    metrics.write_hits(range_join.range_join(base, as_queries(base), R_FULL), path)
    return rounded(spark.read.csv(path, header=True, schema="query_id long, original_base_id long, distance double"), "distance")


@query("trace_csv", EMPTY_SQL + "SELECT query_id, round(min_dist_sq, 6) AS min_dist_sq, is_empty FROM d")
def q_trace_csv(spark, sf):
    from vicinal.plans.shared import new_path

    path = new_path(spark, "trace")
    metrics.write_trace(decided_of(spark, sf)[1], path)
    return rounded(spark.read.csv(path, header=True, schema="query_id long, min_dist_sq double, is_empty boolean"), "min_dist_sq")


@query("search_trace_csv", staged() + TRACE + "SELECT * FROM tr")
def q_search_trace(spark, sf):
    from vicinal.plans.shared import new_path

    path = new_path(spark, "search-trace")
    metrics.write_trace(trace_of(spark, sf), path)
    return spark.read.csv(path, header=True, schema="query_id long, n_clusters long, vecs long, vecs_read long")


@query("nearest_trace_csv", with_tables() + EXACT_SQL + f"SELECT query_id, round(sqrt(least), 6) AS dist, sqrt(least) > {R_NEAR ** 0.5} + 0.001 AS is_empty FROM x")
def q_nearest_trace(spark, sf):
    from vicinal.plans.shared import new_path

    base, path = embeddings(spark, sf), new_path(spark, "nearest-trace")
    metrics.write_trace(metrics.empty_by_nearest(knn.one_nn(base.where("id % 50 <> 0"), as_queries(base)), R_NEAR**0.5, 0.001), path)
    return rounded(spark.read.csv(path, header=True, schema="query_id long, dist double, is_empty boolean"), "dist")


@query("confusion_json", EMPTY_SQL + "SELECT count(*) AS n_queries, count(*) FILTER (is_empty) AS n_skipped, count(*) FILTER (is_empty AND n_hits > 0) AS n_false_empty, round(count(*) FILTER (is_empty) / count(*), 6) AS skip_rate FROM d JOIN t USING (query_id)")
def q_confusion_json(spark, sf):
    _, decided, truth = decided_of(spark, sf)
    made = metrics.confusion_json(metrics.confusion(decided, truth))
    return made.select(F.from_json("json", "n_queries long, n_skipped long, n_false_empty long, skip_rate double").alias("j")).select("j.*")


@query("bound_dump", staged() + "SELECT query_id, cluster_id, round(slab_lb, 6) AS slab_lb, true AS pca_holds FROM lb WHERE query_id IN (SELECT query_id FROM q ORDER BY query_id LIMIT 4)")
def q_bound_dump(spark, sf):
    """Bounds of the first queries; the PCA bound is below the least distance to the cluster."""
    _, queries, index = indexed(spark, sf)
    found = cascade.candidates(index, queries, cascade.Options())
    pca = cascade.box_bounds(found, index).groupBy("query_id", "cluster_id").agg(F.min("pca_lb").alias("pca_lb"))
    dump = metrics.bound_dump(pca.join(cascade.slab_bounds(found, index), ["query_id", "cluster_id"]), queries, 4)
    near = dump.join(queries, "query_id").join(index.members.select("cluster_id", F.col("vec").alias("bv")), "cluster_id").groupBy("query_id", "cluster_id").agg(F.min(V.l2("vec", "bv")).alias("d"))
    both = dump.join(near, ["query_id", "cluster_id"])
    return both.select("query_id", "cluster_id", F.round("slab_lb", 6).alias("slab_lb"), (F.col("pca_lb") <= F.col("d") + 1e-9).alias("pca_holds"))


@query("invalid_candidates", with_tables() + f"SELECT query_id, CAST({CENTERS} AS INTEGER) AS cluster_id FROM q WHERE query_id % 100 = 0")
def q_invalid(spark, sf):
    """Candidates of which some name a cluster that there isn't."""
    _, queries, index = indexed(spark, sf)
    found = cascade.candidates(index, queries, cascade.Options()).withColumn("cluster_id", F.when((F.col("query_id") % 100 == 0) & (F.col("cluster_id") == 0), CENTERS).otherwise(F.col("cluster_id")))
    return metrics.invalid_candidates(found, CENTERS)


@query("probe_overlap", with_assigned() + f", s AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id), qc AS (SELECT * FROM (SELECT q.query_id, c.cluster_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2('q.v', 'c.v')}, c.cluster_id) AS rank FROM q, c) WHERE rank <= 2) SELECT CAST(sum(n) AS BIGINT) AS shared_vecs FROM qc JOIN s USING (cluster_id)")
def q_probe_overlap(spark, sf):
    assigned, centers = assigned_of(spark, sf)
    near = build.assign(embeddings(spark, sf).where("id % 50 = 0"), centers, 5)
    return metrics.probe_overlap(near, build.cluster_stats(assigned), 2, 5)


@query("incremental_base", with_hits(64, R_FULL) + "SELECT query_id, base_id, round(dist_sq, 6) AS dist_sq FROM hits")
def q_incremental(spark, sf):
    """Hits of two parts of the base, joined apart and put together."""
    base = embeddings(spark, sf)
    queries = as_queries(base)
    return rounded(one([range_join.range_join(base.where(f"label % 2 = {k}"), queries, R_FULL) for k in (0, 1)]), "dist_sq")


@query("knn_after_delete", with_tables() + f"SELECT query_id, base_id, rank FROM (SELECT q.query_id, b.id AS base_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2('b.v', 'q.v')}, b.id) AS rank FROM b, q WHERE b.label <> 7) WHERE rank <= {K}")
def q_delete(spark, sf):
    base = embeddings(spark, sf)
    deleted = base.where("label = 7").select("id")
    return knn.knn(base.join(deleted, "id", "left_anti"), as_queries(base), K).select("query_id", "base_id", "rank")


@query("code_lookup", with_assigned() + "SELECT id, cluster_id, round(d2, 6) AS f_add FROM a WHERE id % 50 = 0 AND d2 > 0")
def q_code_lookup(spark, sf):
    """Codes of the query rows, fetched by id."""
    base, _, index = indexed(spark, sf)
    return rounded(index.codes.join(base.where("id % 50 = 0").select("id"), "id").where("f_add > 0").select("id", "cluster_id", "f_add"), "f_add")


@query("pca_projection", "SELECT CAST(0 AS BIGINT) AS id WHERE false")
def q_projection(spark, sf):
    """Members whose coordinates, taken by the vector functions, lie outside their cluster's box and residual."""
    base, _, index = indexed(spark, sf)
    c = index.centers.table(spark).select("cluster_id", F.col("vec").alias("cv"))
    bounds = index.cells.join(index.models.select("cluster_id", "part", "basis"), ["cluster_id", "part"])
    members = index.members.select("cluster_id", "cell_id", "id", "vec").join(bounds, ["cluster_id", "cell_id"]).join(F.broadcast(c), "cluster_id")
    t = V.project(F.col("basis"), F.col("vec"), F.col("cv"))
    members = members.withColumn("t", t).withColumn("res", V.residual(F.col("vec"), F.col("cv"), F.col("t")))
    outside = F.exists(F.zip_with("t", "lo", lambda x, y: x < y - 1e-9), lambda x: x) | F.exists(F.zip_with("t", "hi", lambda x, y: x > y + 1e-9), lambda x: x)
    return members.where(outside | ~F.col("res").between(F.col("res_lo") - 1e-6, F.col("res_hi") + 1e-6)).select("id")


def uniform_sql(k: int) -> str:
    return f"((('0x' || substr(md5(concat('{7 + k}:', id)), 1, 10))::BIGINT + 1) / {float((1 << 40) + 1)})"


@query("seeded_noise", with_tables() + f"SELECT id, round(sqrt({own('v')}) + 0.01 * sqrt(-2 * ln({uniform_sql(0)})) * cos(2 * pi() * {uniform_sql(1)}), 6) AS value FROM b")
def q_noise(spark, sf):
    return rounded(metrics.perturbed(embeddings(spark, sf).select("id", V.norm("vec").alias("value")), "value", 0.01, 7), "value")


def some_vectors(spark, sf, signed: bool | None = None) -> tuple[list[int], list[list]]:
    """The rows of ids below 64, on the driver, for files made by hand."""
    base = embeddings(spark, sf) if signed is None else integers(embeddings(spark, sf), signed)
    rows = base.where("id < 64").orderBy("id").select("id", "vec").collect()
    return [r["id"] for r in rows], [r["vec"] for r in rows]


FEW = "SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS vec FROM embeddings WHERE vec_id < 64"


def read_file(spark, kind: str, path: str, **options) -> DataFrame:
    from vicinal.sources import vector_files

    vector_files.register(spark)
    return spark.read.format(kind).options(path=path, **options).load()


@query("fvecs_scan", FEW)
def q_fvecs(spark, sf):
    _, rows = some_vectors(spark, sf)
    path = put_file(spark, "vectors.fvecs", b"".join(struct.pack(f"<i{DIM}f", DIM, *r) for r in rows))
    return read_file(spark, "fvecs", path, rangeBytes="4096").select("id", F.transform("vec", lambda x: V.rounded(x.cast("double"))).alias("vec"))


@query("f32_scan", "SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS value FROM embeddings WHERE vec_id < 64")
def q_f32(spark, sf):
    ids, rows = some_vectors(spark, sf)
    path = put_file(spark, "column.f32", struct.pack(f"<{len(ids)}f", *(r[0] for r in rows)))
    return read_file(spark, "f32", path).select("id", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("knn_ids_scan", with_hits(64, R_FULL) + KNN_SQL + "SELECT query_id // 50 AS row, list(base_id ORDER BY rank) AS ids, list(round(dist_sq, 4) ORDER BY rank) AS dists FROM nn WHERE query_id < 500 GROUP BY query_id")
def q_knn_ids(spark, sf):
    """Exact neighbours written as an ids file with distances, and read back."""
    base = embeddings(spark, sf)
    lists = knn.as_lists(knn.knn(base, as_queries(base).where("query_id < 500"), K)).orderBy("query_id").collect()
    ids = b"".join(struct.pack(f"<{K}I", *(x["id"] for x in r["neighbours"])) for r in lists)
    dists = b"".join(struct.pack(f"<{K}f", *(x["dist_sq"] for x in r["neighbours"])) for r in lists)
    found = read_file(spark, "knn_ids", put_file(spark, "truth.knn", struct.pack("<2I", len(lists), K) + ids + dists))
    return found.select(F.col("id").alias("row"), F.col("neighbours").alias("ids"), F.transform("distances", lambda x: F.round(x.cast("double"), 4)).alias("dists"))


@query("fbin_bytes", "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 127) AS BIGINT)) AS vec FROM embeddings WHERE vec_id < 64")
def q_fbin_bytes(spark, sf):
    """A file of signed bytes without a type, wrapped anew as one that names its type, with its shape checked."""
    _, rows = some_vectors(spark, sf, True)
    bare = put_file(spark, "bytes.fbin", struct.pack("<2I", len(rows), DIM) + b"".join(struct.pack(f"{DIM}b", *r) for r in rows))
    wrapped = f"{bare}-wrapped"
    read_file(spark, "fbin", bare, dtype="int8").orderBy("id").write.format("fbin").options(path=wrapped, dtype="int8", version="2").mode("append").save()
    found = read_file(spark, "fbin", wrapped, expectRows=str(len(rows)), expectDim=str(DIM), expectDtype="int8")
    return found.select("id", F.col("vec").cast("array<bigint>").alias("vec"))


CONFIG = f"cluster_num {CENTERS}\nK {CENTERS}\nmem_budget 1\nmode disk\ngorder_window 0\nslab_count {SLABS}\nfast_path_enabled true\nfast_path_mode exact\nfast_path_nprobe_N {NPROBE}\n"


@query("search_by_config", with_assigned() + f""", qc AS (SELECT * FROM (SELECT q.query_id, q.v, c.cluster_id, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2("q.v", "c.v")}, c.cluster_id) AS rank FROM q, c) WHERE rank <= {NPROBE}),
    e AS (SELECT qc.query_id, min({l2("qc.v", "a.v")}) > {R_NEAR} AS is_empty FROM qc JOIN a USING (cluster_id) GROUP BY qc.query_id),
    t AS (SELECT q.query_id, count(b.id) AS n FROM q LEFT JOIN b ON {l2("q.v", "b.v")} <= {R_NEAR} GROUP BY q.query_id)
    SELECT count(*) AS n_queries, count(*) FILTER (is_empty) AS n_skipped, CAST(coalesce(sum(n) FILTER (NOT is_empty), 0) AS BIGINT) AS total_n_hits, CAST(sum(n) AS BIGINT) AS hits,
      count(*) FILTER (is_empty AND n > 0) AS n_false_empty, round(coalesce(sum(n) FILTER (NOT is_empty), 0) / sum(n), 6) AS recall FROM t JOIN e USING (query_id)""")
def q_search_by_config(spark, sf):
    """Configuration and truth file, classifier, skipping and cascade together; every query finds itself, so none may be skipped."""
    base, queries, index = indexed(spark, sf)
    truth = range_join.count_per_query(queries, range_join.range_join(base, queries, R_NEAR)).orderBy("query_id")
    path = put_file(spark, "truth", metrics.truth_json(truth, R_NEAR, "embeddings", DIM, base.count()).first()["json"].encode())
    found = search.search_by_truth(spark, config.parse_config(CONFIG), index, queries, path)
    return found.figures.select("n_queries", "n_skipped", "total_n_hits", "hits", "n_false_empty", "recall")


@query("batch_center_distances", with_tables() + f"SELECT q.query_id, c.cluster_id, round({l2('q.v', 'c.v')}, 6) AS dist_sq FROM q, c")
def q_center_matrix(spark, sf):
    base = embeddings(spark, sf)
    found = build.assign(base.where("id % 50 = 0"), build.stride_seeds(base, CENTERS), CENTERS)
    return rounded(found.select(F.col("id").alias("query_id"), "cluster_id", "dist_sq"), "dist_sq")


# ---- streams, configuration, and cases that data rarely show


@query("range_stream", with_hits(DIM, R_FULL) + HITS)
def q_stream(spark, sf):
    """Queries that arrive file by file, each micro-batch written by its epoch."""
    from vicinal.plans.shared import new_path
    from vicinal.streaming.range_stream import range_search_stream

    base, path, out = embeddings(spark, sf), new_path(spark, "stream-in"), new_path(spark, "stream-out")
    as_queries(base).repartition(3).write.parquet(path)
    queries = spark.readStream.schema("query_id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(path)
    running = range_search_stream(base, queries, R_FULL, lambda found, epoch: found.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), new_path(spark, "stream-state"), availableNow=True)
    running.awaitTermination()
    return rounded(spark.read.parquet(out).select("query_id", "base_id", "dist_sq"), "dist_sq")


@query("config_values", f"SELECT * FROM (VALUES ('K', '{CENTERS}'), ('approx_alpha', '1.0'), ('cell_filter_enabled', 'True'), ('cluster_num', '{CENTERS}'), ('fast_path_mode', 'exact'), ('fast_path_nprobe_N', '{NPROBE}'), ('pca_rank', '32'), ('slab_count', '{SLABS}'), ('target_cell_vecs', '24')) t(key, value)")
def q_config(spark, sf):
    """A configuration file's values and defaults that bear on results."""
    path = put_file(spark, "config", CONFIG.encode())
    found = config.parse_config("\n".join(r["value"] for r in spark.read.text(path).collect()))
    keys = ("K", "approx_alpha", "cell_filter_enabled", "cluster_num", "fast_path_mode", "fast_path_nprobe_N", "pca_rank", "slab_count", "target_cell_vecs")
    return spark.createDataFrame([(k, str(found[k])) for k in keys], "key string, value string")


@query("code_sentinels", with_assigned() + "SELECT id, cluster_id, true AS is_zero FROM a WHERE d2 = 0")
def q_sentinels(spark, sf):
    """Rows at their centers have no code: all factors are 0."""
    _, _, index = indexed(spark, sf)
    factors = [F.col(c) == 0 for c in ("f_rescale", "f_error", "f_rescale8", "f_error8")]
    return index.codes.where("f_add = 0").select("id", "cluster_id", (factors[0] & factors[1] & factors[2] & factors[3]).alias("is_zero"))


@query("pca_bases", with_tables() + "SELECT cluster_id, true AS orthonormal, true AS falls FROM c")
def q_pca_bases(spark, sf):
    """Whether a cluster's axes are orthonormal and its members' spread along them falls."""
    _, _, index = indexed(spark, sf)
    identity = F.expr("forall(transform(basis, (x, i) -> forall(transform(basis, (y, j) -> abs(aggregate(zip_with(x, y, (s, t) -> s * t), 0D, (s, t) -> s + t) - IF(i = j, 1, 0)) < 1e-9), z -> z)), z -> z)")
    c = index.centers.table(spark).select("cluster_id", F.col("vec").alias("cv"))
    members = index.members.select("cluster_id", "vec").join(index.models.select("cluster_id", "basis"), "cluster_id").join(F.broadcast(c), "cluster_id")
    t = members.select("cluster_id", F.posexplode(V.project(F.col("basis"), F.col("vec"), F.col("cv"))).alias("axis", "t"))
    spread = t.groupBy("cluster_id", "axis").agg(F.sum(F.col("t") * F.col("t")).alias("s")).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "s"))), lambda x: x["s"]).alias("s"))
    falls = F.expr("forall(sequence(1, size(s)), i -> get(s, i) IS NULL OR get(s, i) <= s[i - 1] + 1e-9)")
    return index.models.select("cluster_id", identity.alias("orthonormal")).join(spread, "cluster_id").select("cluster_id", "orthonormal", falls.alias("falls"))


def with_far_center(spark, sf) -> tuple[DataFrame, build.Centers]:
    base = embeddings(spark, sf)
    return base, build.Centers(np.vstack([build.stride_seeds(base, CENTERS).matrix, np.full((1, DIM), 50.0)]))


@query("empty_slab", f"SELECT CAST({CENTERS} AS INTEGER) AS cluster_id, CAST(unnest(range({SLABS})) AS INTEGER) AS slot")
def q_empty_slab(spark, sf):
    """Slabs that hold nothing: those of a cluster without members."""
    base, centers = with_far_center(spark, sf)
    return build.slabs(build.assign(base, centers), centers, SLABS).where("lo > hi").select("cluster_id", "slot")


@query("empty_repair", with_assigned() + f", big AS (SELECT cluster_id FROM a GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1) SELECT d AS dim, round(avg(v[d]) * (1 - CASE WHEN d % 2 = 1 THEN 1 ELSE -1 END / 1024.0), 6) AS x FROM a JOIN big USING (cluster_id), range(1, {DIM + 1}) t(d) GROUP BY d")
def q_repair(spark, sf):
    """Where an empty cluster's center goes: beside the largest cluster's mean."""
    base, centers = with_far_center(spark, sf)
    after = build.lloyd_step(base, centers)[0].matrix[CENTERS]
    return spark.createDataFrame([(d + 1, round(float(x), 6)) for d, x in enumerate(after)], "dim long, x double")


# ---- graphs


_graphs: dict[tuple[str, str], str] = {}


def stored_graph(spark, sf) -> DataFrame:
    """The graph over the embeddings, in a few parts, built and written once a session."""
    from vicinal.plans.shared import new_path

    key = (spark.sparkContext.applicationId, sf)
    if key not in _graphs:
        path = new_path(spark, "graph")
        graph.write_graph(graph.build_graph(embeddings(spark, sf), part_rows=700), path)
        _graphs[key] = path
    return graph.load_graph(spark, _graphs[key])


@query("graph_edges", "SELECT vec_id AS id, true AS linked, true AS both_ways FROM embeddings")
def q_graph_edges(spark, sf):
    """Whether every vertex has edges, all to vertices of its part that have one back."""
    g = stored_graph(spark, sf)
    edges = g.select("part", "id", F.explode("neighbours").alias("other"))
    back = edges.select(F.col("part").alias("p"), F.col("other").alias("i"), F.col("id").alias("o"))
    met = edges.join(back, (F.col("part") == F.col("p")) & (F.col("id") == F.col("i")) & (F.col("other") == F.col("o")), "left")
    ways = met.groupBy("id").agg(F.bool_and(F.col("p").isNotNull()).alias("both_ways"))
    return g.join(ways, "id").select("id", (F.size("neighbours") > 0).alias("linked"), "both_ways")


def graph_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs that there are, and whether nine in ten were found."""
    return metrics.recall(found, exact).select("n_true", (F.col("set_recall") >= 0.9).alias("found"))


@query("graph_search_recall", f"SELECT count(*) * {K} AS n_true, true AS found FROM embeddings WHERE vec_id % 50 = 0")
def q_graph_search(spark, sf):
    base = embeddings(spark, sf)
    queries = as_queries(base)
    return graph_recall(graph.search_graph(stored_graph(spark, sf), queries, K), knn.knn(base, queries, K))


@query("graph_search_label", with_tables() + f"SELECT CAST(sum(least({K}, n)) AS BIGINT) AS n_true, true AS found FROM q, (SELECT count(*) AS n FROM b WHERE label = 3)")
def q_graph_label(spark, sf):
    """Only rows of one label may be results."""
    base = embeddings(spark, sf)
    queries = as_queries(base)
    mine = base.where("label = 3")
    return graph_recall(graph.search_graph(stored_graph(spark, sf), queries, K, 200, mine), knn.knn(mine, queries, K))


@query("graph_search_after_delete", with_tables() + f"SELECT count(*) * {K} AS n_true, true AS found FROM q")
def q_graph_delete(spark, sf):
    """Deleted rows are passed through and never found."""
    base = embeddings(spark, sf)
    queries, left = as_queries(base), base.where("label <> 7")
    found = materialize(graph.search_graph(stored_graph(spark, sf), queries, K, 200, left), "found")  # read twice
    wrong = found.join(base.where("label = 7"), F.col("base_id") == F.col("id"), "left_semi").count()
    return graph_recall(found, knn.knn(left, queries, K)).withColumn("found", F.col("found") & F.lit(wrong == 0))


@query("graph_candidates", with_tables() + f"SELECT count(*) * {NPROBE} AS n_true, true AS found FROM q")
def q_graph_candidates(spark, sf):
    """Candidate clusters by the graph of the centers, against exact ones."""
    _, queries, index = indexed(spark, sf)
    centers = index.centers.table(spark).select(F.col("cluster_id").alias("id"), "vec")
    found = graph.search_graph(graph.build_graph(centers, 4), queries, NPROBE, 8)
    exact = cascade.candidates(index, queries, cascade.Options(n_candidates=NPROBE)).select("query_id", F.col("cluster_id").alias("base_id"))
    return graph_recall(found, exact)
