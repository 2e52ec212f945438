"""Vector functions and kernels against NumPy."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinal import catalog
from vicinal.functions import vectors as V
from vicinal.operators import build, codes, kernels


@pytest.fixture(scope="module")
def pairs(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=7).tolist(), r.normal(size=7).tolist()) for i in range(20)] + [(20, [0.0] * 7, [0.0] * 7)]
    return spark.createDataFrame(rows, "id int, a array<double>, b array<double>"), rows


def test_metrics(pairs):
    df, rows = pairs
    out = df.select("id", *[f("a", "b").alias(n) for n, f in V.METRICS.items()], V.norm("a").alias("norm"), V.normalize("a").alias("unit"), V.anisotropic_loss("a", "b", 4.0).alias("loss")).collect()
    for r, (_, a, b) in zip(sorted(out), rows, strict=True):
        a, b = np.array(a), np.array(b)
        d, ip = ((a - b) ** 2).sum(), (a * b).sum()
        assert np.allclose([r.l2_sq, r.neg_l2_sq, r.dot, r.neg_dot, r.abs_dot, r.neg_abs_dot], [d, -d, ip, -ip, abs(ip), -abs(ip)])
        assert np.allclose(r.unit, a / (np.linalg.norm(a) + 1e-12))
        x = a - b
        along = (x @ a) ** 2 / (a @ a + 1e-12)
        assert np.isclose(r.loss, 4 * along + max(0, x @ x - along))


def test_integers_are_exact(spark):
    df = spark.createDataFrame([([0] * 33025, [255] * 33025)], "a array<int>, b array<int>")
    assert df.select(V.int_l2_sq("a", "b")).first()[0] == 33025 * 255 * 255


def test_packed_ids(spark):
    df = spark.createDataFrame([(0, 5), (65535, (1 << 48) - 1), (3, 0)], "g int, i long")
    for r in df.select("g", "i", V.pack_id(F.col("g"), F.col("i")).alias("p")).withColumn("x", V.unpack_group("p")).withColumn("y", V.unpack_local(F.col("p"))).collect():
        assert (r.x, r.y) == (r.g, r.i)


def test_finite(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0])], "id int, v array<double>")
    assert [r[0] for r in df.orderBy("id").select(V.is_finite("v")).collect()] == [True, False, False]


def test_sql_functions(spark):
    V.register(spark)
    r = spark.sql("SELECT l2_sq(array(1d, 2d), array(4d, 6d)), dot(array(1d, 2d), array(4d, 6d)), l2_norm(array(3d, 4d)), l2_normalize(array(3d, 4d))").first()
    assert r[:3] == (25.0, 16.0, 5.0) and np.allclose(r[3], [0.6, 0.8])


def test_projection(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 1.0], [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])], "v array<double>, c array<double>, b array<array<double>>")
    t = V.project(F.col("b"), F.col("v"), F.col("c"))
    r = df.select(t.alias("t"), V.residual(F.col("v"), F.col("c"), t).alias("r")).first()
    assert r.t == [1.0, 2.0] and np.isclose(r.r, 2.0)


@pytest.mark.parametrize("m", [1, 3, 9])
def test_nearest_breaks_ties_by_id(m):
    r = np.random.default_rng(1)
    rows, centers = r.integers(0, 3, (60, 3)).astype(float), r.integers(0, 3, (9, 3)).astype(float)
    c, d = kernels.nearest(rows, centers, m)
    full = ((rows[:, None] - centers[None]) ** 2).sum(axis=2)
    for i in range(60):
        best = sorted(range(9), key=lambda j: (full[i, j], j))[:m]
        assert c[i].tolist() == best and np.allclose(d[i], full[i, best])


def test_rotation_keeps_lengths_and_codes_survive_packing():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 60))
    assert np.allclose(np.linalg.norm(codes.rotate(x), axis=1), np.linalg.norm(x, axis=1))
    one, more = codes.encode(x, np.zeros(60)), codes.encode(x, np.zeros(60), codes.EXTRA_BITS)
    bits = codes.unpack(pa.chunked_array([pa.array([b.tobytes() for b in one["levels"]], pa.binary())]), False)
    assert np.array_equal(bits, np.where(codes.rotate(x) >= 0, 1.0, -1.0))
    assert np.array_equal(codes.unpack(pa.chunked_array([pa.array(codes.pack(more["levels"]), pa.binary())]), True), more["levels"])
    zero = codes.encode(np.zeros((1, 60)), np.zeros(60))
    assert zero["f_add"][0] == zero["f_rescale"][0] == zero["f_error"][0] == 0


def test_quantised_rows():
    whole, scale = build.quantised(np.array([[2.0, -1.0, 0.5, 0.0], [0.0, 0.0, 0.0, 0.0]]))
    assert whole.tolist() == [[127, -64, 32, 0], [0, 0, 0, 0]] and scale.tolist() == [2 / 127, 0]


def test_rounding_keeps_the_sign_of_zero(spark):
    xs = [-1e-9, 1e-9, -0.0, 0.0, -1.5e-6, 0.0000005, -0.0000005, -2.25, float("-inf"), float("nan"), None]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").orderBy("i").select(V.rounded(F.col("x"))).collect()]
    assert list(map(repr, got)) == list(map(repr, want))
    assert repr(got[0]) == "-0.0"


def test_normalised_vectors_as_sql_has_them_to_the_sign(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT 0::BIGINT AS vec_id, [0.6, -1e-8, -0.8, 1e-8]::FLOAT[] AS embedding, 1 AS label) TO '{tmp_path}/embeddings.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(catalog.ORACLE_SQL["l2_normalize"]).fetchall()
    assert [repr(tuple(r)) for r in catalog.QUERIES["l2_normalize"](spark, str(tmp_path)).collect()] == list(map(repr, want))
