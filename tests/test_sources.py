"""Vector files, configuration and truth files."""

import json
import struct

import duckdb
import numpy as np
import pytest

from vicinal import catalog
from vicinal.sources import config, vector_files
from vicinal.streaming.range_stream import range_search_stream


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    vector_files.register(spark)


@pytest.mark.parametrize("dtype", ["float32", "int8", "uint8"])
@pytest.mark.parametrize("version", [1, 2])
def test_fbin(spark, tmp_path, dtype, version):
    rows = np.arange(60).reshape(12, 5).astype(vector_files.NUMPY[dtype])
    path = str(tmp_path / "x.fbin")
    code = {"float32": 0, "int8": 1, "uint8": 2}[dtype]
    head = struct.pack("<4I", vector_files.MAGIC, code, 12, 5) if version == 2 else struct.pack("<2I", 12, 5)
    open(path, "wb").write(head + rows.tobytes())
    read = spark.read.format("fbin").option("path", path).option("dtype", dtype).option("rangeBytes", "30")
    df = read.load()
    assert df.rdd.getNumPartitions() > 1
    assert [list(r.vec) for r in df.orderBy("id").collect()] == rows.tolist()
    assert [r.id for r in df.where("id >= 3 and id < 6").orderBy("id").collect()] == [3, 4, 5]
    with pytest.raises(Exception, match="dim is 5"):
        read.option("expectDim", "6").load().count()


def test_fbin_errors(tmp_path):
    path = str(tmp_path / "bad")
    open(path, "wb").write(struct.pack("<2I", 3, 4) + b"x" * 10)
    with pytest.raises(ValueError):
        vector_files.read_header(path)
    open(path, "wb").write(struct.pack("<4I", vector_files.MAGIC, 3, 0, 0))
    with pytest.raises(ValueError):
        vector_files.read_header(path)


def test_fbin_write(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<float>")
    for version in (1, 2):
        path = str(tmp_path / f"w{version}.fbin")
        df.orderBy("id").write.format("fbin").option("path", path).option("version", str(version)).mode("append").save()
        found = vector_files.read_header(path)
        assert (found.rows, found.dim) == (20, 2)
        assert [list(r.vec) for r in spark.read.format("fbin").option("path", path).load().orderBy("id").collect()] == [[float(i), 1.0] for i in range(20)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["w1.fbin", "w2.fbin"]


def test_fvecs_and_knn(spark, tmp_path):
    path = str(tmp_path / "v")
    open(path, "wb").write(b"".join(struct.pack("<i3f", 3, i, i + 1, i + 2) for i in range(4)))
    assert [list(r.vec) for r in spark.read.format("fvecs").option("path", path).load().orderBy("id").collect()] == [[i, i + 1, i + 2] for i in range(4)]
    ids, d = np.arange(6, dtype="<u4"), np.arange(6, dtype="<f4") / 2
    for extra in (b"", d.tobytes()):
        open(path, "wb").write(struct.pack("<2i", 3, 2) + ids.tobytes() + extra)
        got = spark.read.format("knn_ids").option("path", path).load().orderBy("id").collect()
        assert [list(r.neighbours) for r in got] == [[0, 1], [2, 3], [4, 5]]
        assert got[1].distances == ([1.0, 1.5] if extra else None)
    open(path, "wb").write(d.tobytes())
    assert [r.value for r in spark.read.format("f32").option("path", path).load().orderBy("id").collect()] == d.tolist()


GOOD = "cluster_num 64\nK 64 # all\nmem_budget 2\nmode disk\ngorder_window 5\n"


def test_config():
    c = config.parse_config(GOOD + "approx_alpha 1.2\nslab_count 0\nvec_dtype int8\n")
    assert (c["approx_alpha"], c["slab_count"], c["vec_dtype"], c["pca_rank"]) == (1.2, 0, "int8", 32)
    assert config.parse_config(GOOD + "partition_objective anisotropic")["unit_normalize_prebuild"] is True
    for bad in (
        "K 1", GOOD + "K 3", GOOD + "nonsense 1", GOOD + "eta", GOOD + "eta 1 2", GOOD + "approx_alpha 0.9", GOOD + "approx_alpha nan", GOOD + "vec_dtype fp16",
        GOOD.replace("disk", "memory"), GOOD + "slab_count 64", GOOD + "fast_path_enabled maybe", GOOD + "fast_path_enabled true\ndata_hnsw_enabled true\nfast_path_nprobe_N 8",
        GOOD + "slow_path_rbq_prefilter_enabled true", GOOD + "target_cell_vecs 1", GOOD + "split_axis_policy dynamic",
        GOOD + "partition_objective anisotropic\nvec_dtype int8",
    ):
        with pytest.raises(ValueError):
            config.parse_config(bad)
    assert config.with_suffix("/a.b/c.txt", "_x") == "/a.b/c_x.txt" and config.with_suffix("/a.b/c", "_x") == "/a.b/c_x"
    assert config.resolve_dtype("int8", "1") == "int8"
    with pytest.raises(ValueError):
        config.resolve_dtype("int8", "uint8")


def test_truth_file(spark, tmp_path):
    path = str(tmp_path / "gt.json")
    stats = {"min": 1, "median": 1.5, "max": 2, "zero_hit_queries": 0}
    json.dump({"metric": "l2", "n_queries": 2, "total_in_range": 3, "per_query_counts": [1, 2], "per_query_count_stats": stats}, open(path, "w"), indent=1)
    from vicinal.operators import metrics

    summary, counts = config.read_truth(spark, path)
    assert [(r.query_id, r.n_hits) for r in counts.orderBy("query_id").collect()] == [(0, 1), (1, 2)]
    assert metrics.check_truth(counts, summary).count() == 0


def test_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "id long, vec array<double>")
    spark.createDataFrame([(7, [0.5]), (8, [9.0])], "query_id long, vec array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, vec array<double>").parquet(str(tmp_path / "in"))
    got = []
    q = range_search_stream(base, stream, 1.0, lambda df, epoch: got.extend((r.query_id, r.base_id) for r in df.collect()), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(60)
    assert got == [(7, 1)]


def test_components_that_round_to_zero_keep_their_sign(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS vec_id, [0.25, -1e-8, 1e-8]::FLOAT[] AS embedding FROM range(120) t(i)) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(catalog.ORACLE_SQL["fbin_roundtrip"]).fetchall()
    assert sorted(repr(tuple(r)) for r in catalog.QUERIES["fbin_roundtrip"](spark, str(tmp_path)).collect()) == sorted(map(repr, want))
