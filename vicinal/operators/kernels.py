"""NumPy kernels that run on Arrow batches. A matrix product finds candidates with a margin for its rounding;
distances of candidates are then summed dimension by dimension in double precision, as the SQL functions do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rounding of |q|^2 + |x|^2 - 2qx, as a multiple of the largest norms; pairs that are summed again at a time.
SLACK, PAIRS = 1e-9, 65_536


def matrix(column) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    n = len(column)
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def exact_l2_sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in order of dimensions."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        out += d * d
    return out


def _approximate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    na, nb = (np.einsum("ij,ij->i", x, x) for x in (a, b))
    return na[:, None] + nb[None, :] - 2 * (a @ b.T), SLACK * (1 + na.max(initial=0) + nb.max(initial=0))


def within_radius(queries: np.ndarray, base: np.ndarray, r_sq: float, strict: bool = False, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, squared distance) of pairs within the radius; allowed(query, base): pairs that are compared."""
    if not len(queries) or not len(base):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rough, slack = _approximate(queries, base)
    near = ~(rough > r_sq + slack)
    i, j = np.nonzero(near if allowed is None else near & allowed)
    d = exact_l2_sq(queries[i], base[j])
    ok = d < r_sq if strict else d <= r_sq
    return i[ok], j[ok], d[ok]


def least(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Squared distance of each query to its nearest base row, of which there is one at least."""
    rough, slack = _approximate(queries, base)
    i, j = np.nonzero(rough <= rough.min(axis=1)[:, None] + 2 * slack)
    d = [exact_l2_sq(queries[i[at : at + PAIRS]], base[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.minimum.reduceat(np.concatenate(d), np.searchsorted(i, np.arange(len(queries)))) if d else np.zeros(0)


def nearest(rows: np.ndarray, centers: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(center, squared distance) of the m nearest centers of each row; ties by center."""
    m = min(m, len(centers))
    rough, slack = _approximate(rows, centers)
    take = min(len(centers), m + 4)
    part = np.argpartition(rough, take - 1, axis=1)[:, :take]
    edge = np.take_along_axis(rough, part, 1).max(axis=1)
    kth = np.partition(rough, m - 1, axis=1)[:, m - 1]
    if take < len(centers) and (edge <= kth + 2 * slack).any():  # ties beyond what was taken
        part = np.broadcast_to(np.arange(len(centers)), rough.shape)
    d = np.stack([exact_l2_sq(rows, centers[part[:, k]]) for k in range(part.shape[1])], axis=1)
    order = np.lexsort((part, d), axis=1)[:, :m]
    return np.take_along_axis(part, order, 1), np.take_along_axis(d, order, 1)


def finite(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows without those that have a component that is not finite."""
    ok = np.isfinite(rows).all(axis=1)
    return (keys, rows) if ok.all() else (keys[ok], rows[ok])
