"""Joins, neighbours, index and cascade against brute force, and hand-computed cases."""

import json
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinal import catalog, search
from vicinal.operators import build, cascade, codes, graph, knn, metrics, range_join, tasks
from vicinal.sources.config import parse_config


def table(spark, rows, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{key} long, vec array<double>")


#: base, queries, squared radius, hits of each query
CASES = [
    ([[0], [1], [3], [5]], [[0], [4]], 1, [2, 2]),
    ([[0, 0], [1, 0], [3, 0], [5, 0]], [[0, 0], [4, 0]], 1, [2, 2]),
    ([[0], [1], [2], [4], [7]], [[0], [3], [8]], 1, [2, 2, 1]),
    ([[0, 0], [1, 0], [0, 2], [3, 3], [5, 5], [9, 9]], [[0, 0], [3, 2], [8, 8]], 5, [3, 1, 1]),
    ([[0] * 4, [10] * 4, [255] * 4, [200, 1, 2, 3]], [[0] * 4, [200, 0, 0, 0]], 14, [1, 1]),
]


@pytest.mark.parametrize("case", CASES)
def test_hand_computed(spark, case):
    base, queries, r_sq, want = case
    b, q = table(spark, base), table(spark, queries, "query_id")
    counts = range_join.count_per_query(q, range_join.range_join(b, q, r_sq))
    assert [r.n_hits for r in counts.orderBy("query_id").collect()] == want


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.3, (120, 3)) for c in (0, 3, 6)])
    q = r.uniform(-1, 7, (25, 3))
    return x, q, table(spark, x), table(spark, q, "query_id")


def brute(x, q, r_sq):
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    return {(i, j) for i, j in zip(*np.nonzero(d <= r_sq), strict=True)}


def pairs(df):
    return {(r.query_id, r.base_id) for r in df.collect()}


def test_range_join(cloud, spark):
    x, q, b, qs = cloud
    found = range_join.range_join(b, qs, 0.8)
    assert pairs(found) == brute(x, q, 0.8)
    assert range_join.verify(found, b, qs).count() == 0
    wrong = found.limit(1).withColumn("dist_sq", F.col("dist_sq") + 1)
    assert range_join.verify(wrong, b, qs).count() == 1


@pytest.mark.parametrize("blocks", [1, 1000])
def test_range_join_in_blocks(cloud, spark, monkeypatch, blocks):
    """Blocks of a few queries, that come to the driver at once or one by one."""
    x, q, b, qs = cloud
    made = range_join.query_blocks
    monkeypatch.setattr(range_join, "BLOCKS", 1000)
    monkeypatch.setattr(range_join, "query_blocks", lambda queries, held: made(queries, 100, held if blocks == 1000 else 10**9))
    assert len(list(made(qs, 100))) > 3
    assert pairs(range_join.range_join(b, qs, 0.8)) == brute(x, q, 0.8)


def test_no_rows_and_odd_vectors(spark):
    b = spark.createDataFrame([(1, [0.0]), (2, None), (3, [float("nan")])], "id long, vec array<double>")
    q = spark.createDataFrame([(1, [0.0]), (2, None), (3, [float("inf")])], "query_id long, vec array<double>")
    assert pairs(range_join.range_join(b, q, 1.0)) == {(1, 1)}
    assert range_join.range_join(b.limit(0), q, 1.0).count() == 0
    assert range_join.range_join(b, q.limit(0), 1.0).count() == 0
    assert knn.knn(b, q, 3).count() == 1


def test_self_join_is_strict(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 12, (150, 2)).astype(float)
    got = {(p.a, p.b) for p in range_join.self_join(table(spark, x), 4.0, pivots=6, chunk=20).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert got == {(i, j) for i in range(150) for j in range(i) if d[i, j] < 4}


def test_knn(cloud):
    x, q, b, qs = cloud
    got = {}
    for r in knn.knn(b, qs, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.base_id
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(len(q)):
        assert [got[i][k] for k in (1, 2, 3, 4)] == sorted(range(len(x)), key=lambda j: (d[i, j], j))[:4]


@pytest.fixture(scope="module")
def index(cloud, spark):
    _, _, b, _ = cloud
    return cascade.build_index(b, build.stride_seeds(b, 9), 4, 2, 10)


def test_stages_only_see_what_is_left(cloud, index):
    _, _, _, qs = cloud
    search = cascade.prune(index, qs, 0.8)
    left = {(r.query_id, r.cluster_id) for r in search.clusters.where("stage is null").collect()}
    assert {(r.query_id, r.cluster_id) for r in search.cells.collect()} == left
    assert {r.stage for r in search.clusters.collect()} >= {"prescreen", "slab", None}
    assert len(left) < 25 * 9 / 2 and set(search.cells.columns) == {"query_id", "cluster_id", "cell_id", "n", "stage"}


def test_index_survives_storage(cloud, spark, tmp_path):
    x, q, b, qs = cloud
    made = cascade.build_index(b, build.stride_seeds(b, 9), 4, 2, 10, with_codes=True)
    path = str(tmp_path / "index")
    cascade.write_index(made, path)
    found = cascade.load_index(spark, path)
    assert cascade.check_index(spark, path).count() == 0 and found.meta["k"] == 9
    for options in (None, cascade.Options(code_filter="rows"), cascade.Options(code_filter="cells", alpha=1.0)):
        assert pairs(cascade.range_search(found, qs, 0.8, options)) == brute(x, q, 0.8)
    spark.read.parquet(f"{path}/index_meta").withColumn("schema_version", F.lit(1)).write.parquet(f"{path}/old")
    spark.read.parquet(f"{path}/old").write.mode("overwrite").parquet(f"{path}/index_meta")
    with pytest.raises(ValueError, match="version 1"):
        cascade.load_index(spark, path)
    with pytest.raises(ValueError):
        cascade.range_search(cascade.build_index(b, build.stride_seeds(b, 2), 0), qs, 0.8, cascade.Options(code_filter="rows"))


def test_large_clusters_in_parts(cloud, spark, monkeypatch):
    x, q, b, qs = cloud
    monkeypatch.setattr(build, "CLUSTER_ROWS", 40)
    made = cascade.build_index(b, build.stride_seeds(b, 3), 2, 2, 10)
    assert made.models.count() > 3 and made.cells.select("cluster_id", "cell_id").distinct().count() == made.cells.count()
    assert pairs(cascade.range_search(made, qs, 0.8)) == brute(x, q, 0.8)


def test_normalised_index(spark):
    b = table(spark, [[3, 4], [0, 2], [1, 0]])
    made = cascade.build_index(b, build.Centers(np.array([[0.6, 0.8], [1.0, 0.0]])), 0, 2, 2, normalize=True)
    q = table(spark, [[0.6, 0.8], [1, 0]], "query_id")
    assert pairs(cascade.range_search(made, q, 1e-6)) == {(0, 0), (1, 2)}


def test_code_bounds_hold(spark):
    r = np.random.default_rng(8)
    x, q = r.normal(size=(3000, 48)), r.normal(size=(20, 48))
    centers = build.Centers(x[:4].copy())
    assigned = build.assign(table(spark, x), centers).withColumn("cell_id", F.lit(0))
    found = codes.one_bit_codes(assigned, centers)
    asked = build.assign(table(spark, q), centers, 4).select(F.col("id").alias("query_id"), F.col("vec").alias("qv"), "cluster_id")
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    widths = []
    for extra in (False, True):
        rows = codes.bounds(found, centers, asked, extra).collect()
        assert len(rows) == 60000
        assert sum(w.lb > d[w.query_id, w.id] + 1e-9 for w in rows) < 60 and sum(w.ub < d[w.query_id, w.id] - 1e-9 for w in rows) < 60
        widths.append(np.mean([w.ub - w.lb for w in rows]))
    assert widths[1] < widths[0] / 20


def test_code_classifier_abstains(spark):
    b = table(spark, [[0.0, 0, 0], [1.0, 0, 0]])
    centers = build.Centers(np.array([[0.0, 0, 0], [1.0, 0, 0], [9.0, 0, 0]]))
    found = codes.one_bit_codes(build.assign(b, centers).withColumn("cell_id", F.lit(0)), centers)
    q = spark.createDataFrame([(0, [0.1, 0.0, 0.0]), (1, [float("nan"), 0.0, 0.0]), (2, [9.0, 0.0, 0.0]), (3, None)], "query_id long, vec array<double>")
    got = {w.query_id: w.is_empty for w in codes.emptiness(found, centers, q, 0.04, 1).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False}
    wide = {w.query_id: w.is_empty for w in codes.emptiness(found, centers, q, 0.04, 3).collect()}
    assert wide == {0: False, 1: False, 2: True, 3: False}


def test_pivot_join(cloud, monkeypatch):
    x, q, b, qs = cloud
    assert pairs(range_join.pivot_join(b, qs, 0.8, pivots=7, chunk=20)) == brute(x, q, 0.8)
    monkeypatch.setattr(range_join, "BLOCK_BYTES", 10)
    assert pairs(range_join.range_join(b, qs, 0.8)) == brute(x, q, 0.8)
    assert range_join.pivot_join(b.limit(0), qs, 0.8).count() == 0 and range_join.pivot_join(b, qs.limit(0), 0.8).count() == 0


@pytest.mark.parametrize("metric", knn.METRICS)
def test_knn_by_metric(cloud, metric):
    x, q, b, qs = cloud
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    dots = q @ x.T
    score = {"l2_sq": d, "neg_l2_sq": -d, "dot": dots, "neg_dot": -dots, "abs_dot": abs(dots), "neg_abs_dot": -abs(dots)}[metric]
    for r in knn.knn(b, qs, 3, metric).collect():
        assert np.isclose(r.dist_sq, np.sort(score[r.query_id])[r["rank"] - 1])
    with pytest.raises(ValueError):
        knn.knn(b, qs, 3, "cosine")


def test_seeds_by_rank(spark):
    ids = [*range(0, 4000, 3), 1 << 60]
    b = spark.createDataFrame([(i, [float(k)]) for k, i in enumerate(ids)], "id long, vec array<double>")
    step = len(ids) // 7
    assert build.stride_seeds(b, 7).matrix[:, 0].tolist() == [step * i for i in range(7)]


CONFIG = "cluster_num 9\nK 4\nmem_budget 1\nmode disk\ngorder_window 0\nslab_count 3\npca_rank 2\ntarget_cell_vecs 10\n"


@pytest.mark.parametrize("more", ["", "K 9", "fast_path_enabled true\nfast_path_mode exact\nfast_path_nprobe_N 9", "fast_path_enabled true\nfast_path_nprobe_N 9\nslow_path_rbq_prefilter_enabled true", "data_hnsw_enabled true", "unit_normalize_prebuild true\npartition_objective anisotropic\neta 2"])
def test_search_by_configuration(cloud, spark, tmp_path, more):
    x, q, b, qs = cloud
    text = "\n".join([*(w for w in CONFIG.splitlines() if w.split()[0] not in {m.split()[0] for m in more.splitlines()}), more])
    config = parse_config(text)
    if config["unit_normalize_prebuild"]:
        unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
        x, q = unit(x), unit(q)
        qs = table(spark, q, "query_id")
    index = search.build_from(config, b, str(tmp_path / "index"))
    r_sq = 0.02 if config["unit_normalize_prebuild"] else 0.8
    want = brute(x, q, r_sq)
    counts = [sum(int(i == k) for k, _ in want) for i in range(len(q))]
    truth = {"radius_squared": r_sq, "n_queries": len(q), "total_in_range": sum(counts), "per_query_counts": counts, "per_query_count_stats": {"min": min(counts), "median": float(np.median(counts)), "max": max(counts), "zero_hit_queries": counts.count(0)}}
    (tmp_path / "gt.json").write_text(json.dumps(truth))
    found = search.search_by_truth(spark, config, index, qs, str(tmp_path / "gt.json"))
    figures = found.figures.first()
    assert pairs(found.hits) <= want and figures.hits == len(want) and figures.n_queries == 25
    if config["K"] == 9 or "anisotropic" not in more:
        assert figures.recall > 0.9
    if more.startswith("K"):
        assert pairs(found.hits) == want
    if "fast" in more or "hnsw" in more:
        assert 0 < figures.n_skipped <= counts.count(0) + figures.n_false_empty
    assert {r.query_id: r.n_hits for r in found.trace.collect()} == {i: sum(k == i for k, _ in pairs(found.hits)) for i in range(25)}
    truth["total_in_range"] += 1
    (tmp_path / "bad.json").write_text(json.dumps(truth))
    with pytest.raises(ValueError, match="total_in_range"):
        search.search_by_truth(spark, config, index, qs, str(tmp_path / "bad.json"))


def test_command_line(cloud, spark, tmp_path, capsys):
    from vicinal import __main__

    x, q, b, qs = cloud
    at = lambda name: str(tmp_path / name)
    b.write.parquet(at("base"))
    qs.write.parquet(at("queries"))
    (tmp_path / "config").write_text(CONFIG.replace("K 4", "K 9"))
    counts = range_join.count_per_query(qs, range_join.range_join(b, qs, 0.8)).orderBy("query_id")
    (tmp_path / "gt.json").write_text(metrics.truth_json(counts, 0.8, "cloud", 3, 360).first()["json"])
    __main__.main(["build", "--config", at("config"), "--index", at("index"), "--base", at("base")])
    __main__.main(["search", "--config", at("config"), "--index", at("index"), "--queries", at("queries"), "--gt", at("gt.json"), "--dump-range-hits", at("hits")])
    assert json.loads(capsys.readouterr().out)["recall"] == 1.0
    assert spark.read.csv(at("hits"), header=True).count() == len(brute(x, q, 0.8))


@pytest.mark.parametrize("stages", [cascade.STAGES, ("prescreen",), ("slab", "cell"), ()])
def test_cascade_is_exact(cloud, index, stages):
    x, q, _, qs = cloud
    assert pairs(cascade.range_search(index, qs, 0.8, cascade.Options(stages=stages))) == brute(x, q, 0.8)


def test_cascade_accounts(cloud, index):
    _, _, _, qs = cloud
    counters = cascade.prune_counters(cascade.decisions(cascade.prune(index, qs, 0.8)))
    assert metrics.partition_errors(counters).count() == 0
    r = counters.first()
    assert r.vecs == 25 * 360 and 0 < r.vecs_read < r.vecs


def test_alpha_only_loses(cloud, index):
    x, q, _, qs = cloud
    sets = [pairs(cascade.range_search(index, qs, 0.8, cascade.Options(alpha=a))) for a in (1.0, 2.0, 16.0)]
    assert sets[0] == brute(x, q, 0.8) and sets[0] >= sets[1] >= sets[2]
    with pytest.raises(ValueError):
        cascade.Options(alpha=0.5)


def test_candidates_only_lose(cloud, index):
    x, q, _, qs = cloud
    sets = [pairs(cascade.range_search(index, qs, 0.8, cascade.Options(n_candidates=n))) for n in (1, 3, 9)]
    assert sets[0] <= sets[1] <= sets[2] == brute(x, q, 0.8)


@pytest.mark.parametrize("rows", [[[1, 2, 3]], [[1, 2, 3]] * 3, [[1, 2, 3], [1, 2, 4]]])
def test_degenerate_clusters(spark, rows):
    b = table(spark, rows)
    made = cascade.build_index(b, build.Centers(np.array([[1.0, 2.0, 3.0]])), 0, 2, 2)
    q = table(spark, [[1, 2, 3], [0, 0, 0], [1, 2, 3.5]], "query_id")
    assert pairs(cascade.range_search(made, q, 0.3)) == brute(np.array(rows, float), np.array([[1, 2, 3], [0, 0, 0], [1, 2, 3.5]], float), 0.3)


def test_empty_cluster_and_slabs(spark):
    b = table(spark, [[0, 0], [1, 0]])
    centers = build.Centers(np.array([[0.0, 0.0], [1.0, 0.0], [50.0, 0.0]]))
    rows = {r.cluster_id: (r.lo, r.hi) for r in build.slabs(build.assign(b, centers), centers, 1).collect()}
    assert rows[2] == (float("inf"), float("-inf")) and rows[0][0] <= 0 <= rows[0][1]
    with pytest.raises(ValueError):
        build.center_neighbours(build.Centers(np.zeros((2, 2))), 1, spark)
    with pytest.raises(ValueError):
        build.center_neighbours(centers, 3, spark)


def test_kd_cells_follow_medians():
    t = np.arange(16.0).reshape(-1, 1)
    cell = build.kd_cells(t, 4)
    assert sorted(np.bincount(cell).tolist()) == [4, 4, 4, 4]
    assert build.kd_cells(np.zeros((9, 1)), 2).max() == 0


def test_kmeans_finds_lobes(spark):
    x = np.array([[0.01 * i, 0.0] for i in range(40)] + [[100 + 0.01 * i, 0.0] for i in range(40)])
    b = table(spark, x)
    made = build.kmeans(b, 2)
    assert np.allclose(sorted(made.matrix[:, 0]), [x[:40, 0].mean(), x[40:, 0].mean()], atol=0.2)


def test_anisotropic_with_eta_one_is_the_mean(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    b = table(spark, x)
    seeds = build.stride_seeds(b, 3)
    plain, _ = build.lloyd_step(b, seeds)
    other, _ = build.anisotropic_step(b, seeds, 1.0)
    assert np.allclose(plain.matrix, other.matrix)
    with pytest.raises(ValueError):
        build.anisotropic_kmeans(table(spark, x * 3), 3, 2.0)


@pytest.mark.parametrize("held", [2, 1000])
def test_two_choice_balances(spark, monkeypatch, held):
    x = [[0.49]] * 10
    monkeypatch.setattr(build, "HELD", held)
    got = [r.cluster_id for r in build.two_choice(table(spark, x), build.Centers(np.array([[0.0], [1.0]]))).orderBy("id").collect()]
    sizes, want = [0, 0], []
    for _ in x:
        c = 1 if 0.51**2 < 1.2 * 0.49**2 and sizes[1] < sizes[0] else 0
        sizes[c] += 1
        want.append(c)
    assert got == want


def test_repair_splits_the_largest():
    m, sizes = np.array([[1.0, 1.0], [9.0, 9.0]]), np.array([10.0, 0.0])
    build.repair(m, sizes)
    assert sizes.tolist() == [5, 5] and not np.allclose(m[0], m[1]) and np.allclose(m[0], 1, atol=0.01)


def test_recall_without_truth(spark):
    none = spark.createDataFrame([], "query_id long, base_id long")
    r = metrics.recall(none, none).first()
    assert (r.n_found, r.n_true, r.count_recall, r.set_recall) == (0, 0, None, None)


def test_classifier_abstains(spark):
    b = table(spark, [[0.0], [1.0]])
    centers = build.Centers(np.array([[0.0], [1.0], [9.0]]))
    q = spark.createDataFrame([(0, [0.1]), (1, [float("nan")]), (2, [9.0]), (3, [5.5])], "query_id long, vec array<double>")
    got = {r.query_id: r.is_empty for r in metrics.empty_by_probe(build.assign(b, centers), centers, q, 0.04, 1).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False}  # 2 and 3 meet an empty cluster
    wide = {r.query_id: r.is_empty for r in metrics.empty_by_probe(build.assign(b, centers), centers, q, 0.04, 3).collect()}
    assert wide == {0: False, 1: False, 2: True, 3: True}


def test_truth_that_lies(spark):
    counts = spark.createDataFrame([(0, 2), (1, 0)], "query_id long, n_hits long")
    stated = metrics.count_stats(counts)
    assert metrics.check_truth(counts, stated).count() == 0
    assert [r.what for r in metrics.check_truth(counts, stated.withColumn("total_in_range", F.lit(3))).collect()] == ["total_in_range"]


@pytest.mark.parametrize("part_rows", [90, 1000])
def test_graph_search_finds_most(cloud, spark, tmp_path, part_rows):
    x, q, b, qs = cloud
    path = str(tmp_path / "graph")
    graph.write_graph(graph.build_graph(b, 8, part_rows), path)
    found = graph.load_graph(spark, path)
    exact = knn.knn(b, qs, 5)
    assert metrics.recall(graph.search_graph(found, qs, 5, 40), exact).first().set_recall >= 0.9
    some = b.where("id % 3 = 0")
    got = graph.search_graph(found, qs, 4, 60, some).collect()
    assert all(r.base_id % 3 == 0 for r in got) and len(got) == 100
    assert graph.search_graph(found, qs.limit(0), 5).count() == 0


def test_graph_that_is_none(spark, tmp_path):
    with pytest.warns(UserWarning, match="no graph"):
        assert graph.load_graph(spark, str(tmp_path / "missing")) is None
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.warns(UserWarning, match="no graph"):
        assert graph.load_graph(spark, str(tmp_path / "other")) is None


def test_tiny_graphs(spark):
    q = table(spark, [[0.0, 0.0]], "query_id")
    for rows in ([], [[1.0, 1.0]], [[1.0, 1.0]] * 3):
        b = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id long, vec array<double>")
        assert graph.search_graph(graph.build_graph(b), q, 2).count() == min(2, len(rows))


@pytest.mark.parametrize("window", [1, 3, 20])
def test_locality_order_is_greedy(window):
    r = np.random.default_rng(window)
    links = graph.link(r.normal(size=(40, 2)), 4, 8)
    order = graph.locality_order(links, window)
    assert sorted(order) == list(range(40)) and len(links[order[0]]) == max(map(len, links))
    for n in range(1, 40):
        score = {}
        for v in set(range(40)) - set(order[:n]):
            score[v] = sum((v in links[u]) + (u in links[v]) + sum(1 for c in range(40) if u in links[c] and v in links[c] and u != v) for u in order[max(0, n - window) : n])
        best = max(score.values())
        assert order[n] == min(v for v, s in score.items() if s == best)
    assert graph.locality_order([], window) == []


@pytest.fixture(scope="module")
def wide_index(spark, tmp_path_factory):
    """Directions in 64 dimensions, where one-bit bounds of 3.66 standard errors are wrong for some of a million pairs,
    rows that are all equal in a cell that has to be cut, and the index of both."""
    r = np.random.default_rng(11)
    x = r.normal(size=(3000, 64))
    x = np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.tile(x[:1] / np.linalg.norm(x[0]), (300, 1))])
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    q = b.where("id < 700").withColumnRenamed("id", "query_id")
    path = str(tmp_path_factory.mktemp("wide") / "index")
    cascade.write_index(cascade.build_index(b, build.stride_seeds(b, 4), 2, 8, 24, with_codes=True), path)
    d = ((x[:700, None] - x[None]) ** 2).sum(axis=2)
    return cascade.load_index(spark, path), q, d


@pytest.mark.parametrize("code_filter", [None, "rows", "cells"])
def test_code_filters_lose_no_hit(wide_index, monkeypatch, code_filter):
    """At 1.7 the probabilistic bounds lose some of the hits here."""
    index, q, d = wide_index
    monkeypatch.setattr(tasks, "CHUNK", 200)
    monkeypatch.setattr(tasks, "STEP", 64)
    found = cascade.range_search(index, q, 1.7, cascade.Options(code_filter=code_filter))
    assert {(r.query_id, r.base_id) for r in found.collect()} == set(zip(*(x.tolist() for x in np.nonzero(d <= 1.7)), strict=True))


def test_rows_that_codes_keep(wide_index):
    """All hits, little else, and nothing called sure that is none; bounds() alone would lose some."""
    index, q, d = wide_index
    read = q.select("query_id").join(index.cells.select("cluster_id", "cell_id"))
    kept = codes.filtered(index.codes, index.centers, tasks.deal(read, q, index.stats, index.cells, 500), 1.7).collect()
    pairs, hits = {(r.query_id, r.id) for r in kept}, set(zip(*(x.tolist() for x in np.nonzero(d <= 1.7)), strict=True))
    assert len(pairs) == len(kept) and hits <= pairs and len(pairs) < 1.2 * len(hits)
    assert {(r.query_id, r.id) for r in kept if r.sure} <= hits


def test_sound_bounds_hold_without_exception():
    r = np.random.default_rng(5)
    for x in (r.normal(size=(400, 60)), r.normal(size=(400, 60)) * 1e-7 + 1, np.zeros((3, 60))):
        q = np.vstack([r.normal(size=(200, 60)), x[:50]])
        for extra in (0, codes.EXTRA_BITS):
            c = codes.encode(x, np.full(60, 0.1), extra)
            u = c["levels"].astype(float) if extra else codes.unpack(pa.chunked_array([pa.array([b.tobytes() for b in c["levels"]], pa.binary())]), False)
            lb, ub = codes.sound_bounds(codes.rotate(q - 0.1), u, c["f_add"], c["f_rescale"])
            d = ((x[:, None] - q[None]) ** 2).sum(axis=2)
            assert (lb <= d).all() and (d <= ub).all()


@pytest.mark.parametrize("share", [1.0, 0.1])
def test_walks_in_step_find_what_single_walks_find(share):
    r = np.random.default_rng(9)
    x, q = r.normal(size=(700, 16)), r.normal(size=(150, 16))
    links = graph.link(x)
    allowed, entries = r.random(700) < share, np.arange(4)
    flat = np.r_[0, np.cumsum([len(y) for y in links])], np.concatenate(links)
    exact = np.where(allowed[None], ((q[:, None] - x[None]) ** 2).sum(axis=2), np.inf)
    best, single, step = np.sort(exact, axis=1)[:, :5], 0, 0
    for i, found, d in graph.beams(x, flat, q, 5, 30, entries, allowed):
        assert len(found) == 5 and allowed[found].all() and np.allclose(d, exact[i, found]) and (np.diff(d) >= 0).all()
        step += (d <= best[i, -1] + 1e-9).sum()
        single += (graph.beam(x, links, q[i], 5, 30, entries, allowed)[1] <= best[i, -1] + 1e-9).sum()
    assert i == 149 and step >= single and step >= 0.9 * best.size


def test_walks_in_step_are_fast():
    """A part of the size that the catalogue's graph has, with every tenth row allowed: single walks are many times slower."""
    import time

    r = np.random.default_rng(2)
    x, q = (y / np.linalg.norm(y, axis=1)[:, None] for y in (r.normal(size=(700, 64)), r.normal(size=(256, 64))))
    links = graph.link(x)
    flat = np.r_[0, np.cumsum([len(y) for y in links])], np.concatenate(links)
    allowed = r.random(700) < 0.1
    took = []
    for walk in (lambda: [graph.beam(x, links, v, 5, 200, np.arange(4), allowed) for v in q[:32]], lambda: list(graph.beams(x, flat, q, 5, 200, np.arange(4), allowed))):
        began = time.process_time()
        took.append((len(walk()), time.process_time() - began))
    (a, s), (b, t) = took
    assert t / b < s / a / 2


def counting(function, folder):
    """function(*args), which makes a function of a table, such that each call of that leaves a file."""

    def made(*args):
        run = function(*args)

        def counted(table):
            (folder / uuid.uuid4().hex).touch()
            return run(table)

        return counted

    return made


def test_search_after_delete_walks_once(spark, sf, tmp_path, monkeypatch):
    """Its smallest graph is one part."""
    monkeypatch.setattr(graph, "_walk", counting(graph._walk, tmp_path))
    assert catalog.QUERIES["graph_search_after_delete"](spark, sf).first().found
    assert len(list(tmp_path.iterdir())) == 1


def test_runs_of_the_front_are_made_once(spark, sf, tmp_path, monkeypatch):
    """The front reads its runs twice, and writing it in an order twice again."""
    real = tasks.pairs

    def counted(r_sq):
        run = real(r_sq)

        def both(queries, rows):
            (tmp_path / uuid.uuid4().hex).touch()
            return run(queries, rows)

        return both

    monkeypatch.setattr(tasks, "pairs", counted)
    runs = catalog.runs_of(spark, sf)
    first = sorted(map(tuple, runs.collect()))
    made = len(list(tmp_path.iterdir()))
    assert made and len(first) == 8 and sorted(map(tuple, runs.collect())) == first
    assert len(list(tmp_path.iterdir())) == made


@pytest.mark.parametrize("chunk", [40, 2048])
def test_least_distances_in_tasks(spark, chunk):
    """Of a query to the rows of its clusters, where many are copies: no row stands for a pair."""
    r = np.random.default_rng(12)
    x, q = np.vstack([r.normal(size=(200, 8)), np.repeat(r.normal(size=(1, 8)), 300, axis=0)]), r.normal(size=(90, 8))
    q[:3] = x[-1]
    c, of = r.integers(0, 3, 500), r.integers(0, 4, (90, 2))  # cluster 3 is empty
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id long, vec array<double>, cluster_id int")
    near = spark.createDataFrame([(i, q[i].tolist(), int(k)) for i in range(90) for k in set(of[i].tolist())], "query_id long, vec array<double>, cluster_id int")
    found = tasks.least(near, rows, chunk)
    met = {i: np.isin(c, of[i]) for i in range(90)}
    want = {i: ((x[m] - q[i]) ** 2).sum(axis=1).min() for i, m in met.items() if m.any()}
    got = {row.query_id: row.min_dist_sq for row in found.collect()}
    assert got.keys() == want.keys() and len(want) < 90 and all(abs(got[i] - want[i]) < 1e-12 for i in want)


@pytest.mark.parametrize("part_rows, chunk", [(200_000, 2048), (200_000, 30), (40, 25), (40, 5)])
def test_cells_left_as_lists(cloud, spark, monkeypatch, part_rows, chunk):
    """The same cells and vectors as the account has, in few rows, and the same hits, also with parts, slices and cut cells."""
    x, q, b, qs = cloud
    monkeypatch.setattr(build, "CLUSTER_ROWS", part_rows)
    monkeypatch.setattr(tasks, "CHUNK", chunk)
    monkeypatch.setattr(tasks, "STEP", 7)
    made = cascade.build_index(b, build.stride_seeds(b, 3), 2, 2, 10)
    rows = cascade.prune(made, qs, 0.8).cells.where("stage is null").collect()
    lists = cascade.prune(made, qs, 0.8, account=False).cells
    got = lists.collect()
    assert sorted((r.query_id, r.cluster_id, c) for r in got for c in r.cells) == sorted((r.query_id, r.cluster_id, r.cell_id) for r in rows)
    assert sum(r.n for r in got) == sum(r.n for r in rows) and len(got) < len(rows)
    assert pairs(cascade.hits(made, lists, qs, 0.8)) == brute(x, q, 0.8)


def linked_one_by_one(rows, degree, considered):
    """Neighbours as single vertices choose them."""
    out = [set() for _ in rows]
    for i, v in enumerate(rows):
        d = ((rows - v) ** 2).sum(axis=1)
        near, kept = [x for x in np.argsort(d, kind="stable")[: considered + 1].tolist() if x != i], []
        for x in near:
            if len(kept) < degree and (((rows[kept] - rows[x]) ** 2).sum(axis=1) >= d[x]).all():
                kept.append(x)
        for x in [*kept, *[x for x in near if x not in kept][: degree - len(kept)]]:
            out[i].add(x)
            out[x].add(i)
    return [sorted(x) for x in out]


@pytest.mark.parametrize("n, degree", [(2, 16), (30, 16), (600, 6)])
def test_links_in_step_are_those_of_single_vertices(n, degree):
    x = np.random.default_rng(5).normal(size=(n, 12))
    assert [y.tolist() for y in graph.link(x, degree, 20)] == linked_one_by_one(x, degree, 20)


def test_copies_are_linked():
    """So many that a vertex may not be among its own nearest."""
    x = np.repeat(np.random.default_rng(6).normal(size=(4, 8)), 80, axis=0)
    links = graph.link(x)
    assert all(len(y) >= graph.DEGREE and i not in y and (np.diff(y) > 0).all() for i, y in enumerate(links))
    assert all(i in links[j] for i, y in enumerate(links) for j in y.tolist())


@pytest.mark.parametrize("few", [0, 1, 40, 60])
def test_few_allowed_rows_are_found_without_walks(monkeypatch, few):
    """A pool that can hold all of them never fills: single walks find the same, also where edges lead to a part only."""
    r = np.random.default_rng(13)
    x, q = r.normal(size=(400, 8)), r.normal(size=(30, 8))
    x[200:] += 1000  # out of reach
    links = graph.link(x)
    flat = np.r_[0, np.cumsum([len(y) for y in links])], np.concatenate(links)
    allowed, entries = np.zeros(400, bool), np.arange(4)
    allowed[r.choice(400, few, replace=False)] = True
    monkeypatch.setattr(np, "partition", None)  # walks need it
    monkeypatch.setattr(graph.kernels, "nearest", lambda a, b, k: (lambda d: (np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]))(np.stack([graph.kernels.exact_l2_sq(np.broadcast_to(v, b.shape), b) for v in a])))
    found = list(graph.beams(x, flat, q, 5, 60, entries, allowed))
    assert [i for i, _, _ in found] == list(range(30))
    for i, v, d in found:
        want, far = graph.beam(x, links, q[i], 5, 60, entries, allowed)
        assert v.tolist() == want.tolist() and np.array_equal(d, far) and (v < 200).all()


def test_products_of_many_queries_stay_small(monkeypatch):
    """Of a block of many queries and a batch of base rows."""
    from types import SimpleNamespace

    r, sizes, real = np.random.default_rng(14), [], range_join.kernels.within_radius
    x, q = r.normal(size=(3000, 4)), r.normal(size=(5000, 4))
    monkeypatch.setattr(range_join.kernels, "within_radius", lambda a, b, *more: (sizes.append(len(a) * len(b)), real(a, b, *more))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])
    found = pa.Table.from_batches(range_join._scan(SimpleNamespace(value=(np.arange(5000), q)), 0.01, False)(iter([batch])))
    assert max(sizes) <= range_join.PRODUCT and sum(sizes) == 3000 * 5000
    i, j, _ = real(q, x, 0.01)
    assert set(zip(found["query_id"].to_pylist(), found["base_id"].to_pylist(), strict=True)) == set(zip(i.tolist(), j.tolist(), strict=True))


def test_cells_of_tasks_are_united(spark):
    """As unfolding all lists gives them, without a row a query and a cell."""
    r = np.random.default_rng(15)
    rows = [(i, int(c), int(s), 0, int(k), sorted(set(r.integers(0, 30, n).tolist()))) for i, (c, s, k, n) in enumerate(r.integers(0, 4, (300, 4)) * [1, 1, 1, 10])]
    asked = spark.createDataFrame(rows, "query_id long, cluster_id int, slice int, piece int, chunk int, cells array<bigint>")
    wanted = tasks.Dealt(asked, None, None).wanted()
    assert "Generate" not in wanted._jdf.queryExecution().optimizedPlan().toString()
    got = wanted.collect()
    assert sorted(map(tuple, got)) == sorted({(*x[1:5], c) for x in rows for c in x[5]})
