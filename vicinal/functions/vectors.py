"""Vector functions as Column expressions over array<double>, and the same as SQL functions.

Sums run in the order of the dimensions, in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Vector = Column | str


def _c(v: Vector) -> Column:
    return F.col(v) if isinstance(v, str) else v


def as_double(v: Vector) -> Column:
    """Byte, small-integer or float components as double."""
    return _c(v).cast("array<double>")


def _sum(terms: Column, kind: str = "double") -> Column:
    return F.aggregate(terms, F.lit(0).cast(kind), lambda s, t: s + t)


def l2_sq(a: Vector, b: Vector) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def neg_l2_sq(a: Vector, b: Vector) -> Column:
    return -l2_sq(a, b)


def l2(a: Vector, b: Vector) -> Column:
    return F.sqrt(l2_sq(a, b))


def dot(a: Vector, b: Vector) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def neg_dot(a: Vector, b: Vector) -> Column:
    return -dot(a, b)


def abs_dot(a: Vector, b: Vector) -> Column:
    """Also the distance of a point to a hyperplane with unit normal."""
    return F.abs(dot(a, b))


def neg_abs_dot(a: Vector, b: Vector) -> Column:
    return -abs_dot(a, b)


def norm_sq(v: Vector) -> Column:
    return _sum(F.transform(_c(v), lambda x: x * x))


def norm(v: Vector) -> Column:
    return F.sqrt(norm_sq(v))


def normalize(v: Vector) -> Column:
    """v over its norm plus 1e-12, so that the zero vector stays zero."""
    n = norm(v) + 1e-12
    return F.transform(_c(v), lambda x: x / n)


def rounded(x: Column, digits: int = 6) -> Column:
    """x to some decimals, halves away from zero, with the sign of x even where nothing but zero is left, as SQL engines
    on IEEE doubles round (Spark's own round gives 0.0 for -1e-9, not -0.0)."""
    return F.when(x == 0, x).when(x < 0, -F.round(-x, digits)).otherwise(F.round(x, digits))


def l2_sq_via_norms(norm_sq_a: Column, norm_sq_b: Column, dot_ab: Column) -> Column:
    return norm_sq_a + norm_sq_b - 2 * dot_ab


def int_l2_sq(a: Vector, b: Vector) -> Column:
    """Squared distance of integer vectors as BIGINT, from norms and the inner product, exactly."""
    x, y = (_c(v).cast("array<bigint>") for v in (a, b))
    own = lambda v: _sum(F.transform(v, lambda t: t * t), "bigint")
    return own(x) + own(y) - 2 * _sum(F.zip_with(x, y, lambda s, t: s * t), "bigint")


def byte_sum(v: Vector) -> Column:
    return _sum(_c(v).cast("array<bigint>"), "bigint")


def byte_norm_sq(v: Vector) -> Column:
    return _sum(F.transform(_c(v).cast("array<bigint>"), lambda x: x * x), "bigint")


def anisotropic_loss(x: Vector, c: Vector, eta: float) -> Column:
    """eta * |r along x|^2 + |r across x|^2 for the residual r = x - c."""
    r = F.zip_with(_c(x), _c(c), lambda s, t: s - t)
    along = F.pow(dot(r, x), F.lit(2.0)) / (norm_sq(x) + 1e-12)
    return F.lit(eta) * along + F.greatest(F.lit(0.0), norm_sq(r) - along)


def is_finite(v: Vector) -> Column:
    return F.forall(_c(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def pack_id(group: Column, local: Column) -> Column:
    """16 bits of group above 48 bits of local id."""
    return F.shiftleft(group.cast("bigint"), 48).bitwiseOR(local.cast("bigint"))


def unpack_group(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 48)


def unpack_local(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << 48) - 1))


def project(basis: Column, v: Column, center: Column) -> Column:
    """Coordinates of v - center along the rows of basis."""
    r = F.zip_with(v, center, lambda x, c: x - c)
    return F.transform(basis, lambda row: dot(row, r))


def residual(v: Column, center: Column, coordinates: Column) -> Column:
    """Length of what the coordinates leave of v - center."""
    return F.sqrt(F.greatest(F.lit(0.0), l2_sq(v, center) - norm_sq(coordinates)))


#: By name, for operators that take a metric.
METRICS = {
    "l2_sq": l2_sq, "neg_l2_sq": neg_l2_sq, "dot": dot, "neg_dot": neg_dot, "abs_dot": abs_dot, "neg_abs_dot": neg_abs_dot,
}


def register(spark: SparkSession) -> None:
    """l2_sq, dot, l2_norm and l2_normalize as temporary SQL functions."""
    two, one = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "a ARRAY<DOUBLE>"
    add = "CAST(0 AS DOUBLE), (s, t) -> s + t"
    for name, args, result, body in (
        ("l2_sq", two, "DOUBLE", f"aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), {add})"),
        ("dot", two, "DOUBLE", f"aggregate(zip_with(a, b, (x, y) -> x * y), {add})"),
        ("l2_norm", one, "DOUBLE", f"sqrt(aggregate(transform(a, x -> x * x), {add}))"),
        ("l2_normalize", one, "ARRAY<DOUBLE>", f"transform(a, x -> x / (sqrt(aggregate(transform(a, y -> y * y), {add})) + 1e-12))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
