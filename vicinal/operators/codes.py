"""One-bit vector codes with distance bounds, and their refinement to eight bits.

A vector's residual to its center is rotated by a seeded orthogonal transform; the code keeps the signs of
its coordinates. The inner product of a query's residual with the sign vector then estimates its inner
product with the residual itself, with an error that shrinks as 1/sqrt(dim). Bounds from that error (bounds())
hold with high probability, not always; those of a search's filters (sound_bounds()) always do, and are wider.
Codes are made once, with the index; a filter by codes reads them and no vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions import vectors as V
from vicinal.operators import build, kernels, tasks
from vicinal.operators.build import Centers

#: Standard errors that a bound allows for: a normal error passes one side of it once in 8000 rows (the error of
#: a code is nearly normal). Fixed value: magnitude bits beyond the sign.
CONFIDENCE, EXTRA_BITS = 3.66, 7
#: Rounding of a sound bound, as a multiple of the squared lengths.
SLACK = 1e-9


def padded(dim: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, dim))))


def rotate(x: np.ndarray, seed: int = 7, rounds: int = 3) -> np.ndarray:
    """Rows rotated: random signs, then a normalised Hadamard transform, some rounds over; zero-padded to a
    power of two."""
    n = padded(x.shape[1])
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        out = out * rng.choice([-1.0, 1.0], n)
        h = 1
        while h < n:
            pairs = out.reshape(len(out), -1, 2, h)
            out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(out), n)
            h *= 2
        out /= math.sqrt(n)
    return out


def encode(rows: np.ndarray, center: np.ndarray, extra_bits: int = 0) -> dict[str, np.ndarray]:
    """Codes and factors of rows: with levels u in rotated space, f_add = |r|^2, f_rescale = |r|^2 / <u, r>
    and f_error the bound of what the estimate misses for a query residual of length 1. A zero residual has
    factors 0."""
    r = rotate(rows - center)
    own = np.einsum("ij,ij->i", r, r)
    if extra_bits:
        top = np.abs(r).max(axis=1, keepdims=True)
        steps = (1 << extra_bits) - 1
        level = np.floor(np.abs(r) / np.where(top > 0, top, 1) * steps + 0.5) + 0.5
        u = np.where(r >= 0, level, -level)
    else:
        u = np.where(r >= 0, 1.0, -1.0)
    inner = np.einsum("ij,ij->i", u, r)
    length = np.einsum("ij,ij->i", u, u)
    zero = (own == 0) | (inner <= 0)
    safe = np.where(zero, 1, inner)
    cos_sq = np.where(zero, 1, safe * safe / (length * np.where(own > 0, own, 1)))
    spread = np.sqrt(np.maximum(0, (1 - cos_sq) / cos_sq) / max(1, r.shape[1] - 1))
    return {
        "levels": u.astype(np.float32) if extra_bits else np.packbits(r >= 0, axis=1),
        "f_add": np.where(zero, 0, own),
        "f_rescale": np.where(zero, 0, own / safe),
        "f_error": np.where(zero, 0, 2 * CONFIDENCE * np.sqrt(own) * spread),
    }


def pack(levels: np.ndarray) -> list[bytes]:
    """Signed levels k + 1/2 as a byte each: the sign above the 7 bits of k."""
    return [x.tobytes() for x in (np.abs(levels) - 0.5).astype(np.uint8) | (levels < 0).astype(np.uint8) << 7]


def unpack(column: pa.ChunkedArray, extra: bool) -> np.ndarray:
    """Levels of rows of codes; one bit stands for -1 or 1. Rows come padded to the rotation's dimensions."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    if extra:
        return ((raw & 127) + 0.5) * np.where(raw & 128, -1.0, 1.0)
    return np.unpackbits(raw, axis=1) * 2.0 - 1


CODES = (
    "cluster_id int, cell_id long, id long, bits binary, f_add double, f_rescale double, f_error double,"
    " bits8 binary, f_rescale8 double, f_error8 double"
)


def one_bit_codes(members: DataFrame, centers: Centers) -> DataFrame:
    """The codes, of one bit and of eight, of members(cluster_id, cell_id, id, vec), in one pass without a shuffle."""
    shared = members.sparkSession.sparkContext.broadcast(centers.matrix)
    names = [f.strip().split()[0] for f in CODES.split(",")]

    def run(batches):
        for batch in batches:
            c, rows = batch.column(0).to_numpy(), kernels.matrix(batch.column(3))
            if not len(rows):
                continue
            # rotation is linear, so all rows of a batch are coded together
            one, more = encode(rows, shared.value[c]), encode(rows, shared.value[c], EXTRA_BITS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x.tobytes() for x in one["levels"]], pa.binary()), *(pa.array(one[k]) for k in ("f_add", "f_rescale", "f_error")),
                 pa.array(pack(more["levels"]), pa.binary()), *(pa.array(more[k]) for k in ("f_rescale", "f_error"))], names=names,
            )

    return members.select("cluster_id", F.col("cell_id").cast("long"), "id", "vec").mapInArrow(run, CODES)


def bounds(codes: DataFrame, centers: Centers, asked: DataFrame, extra: bool = False) -> DataFrame:
    """(query_id, cluster_id, cell_id, id, lb, ub): bounds of squared distances for the codes that asked(query_id,
    qv, cluster_id and, if it has them, cell_id and id) names. No vector of the base is read."""
    turned = rotate(centers.matrix) if len(centers.matrix) else centers.matrix
    shared = asked.sparkSession.sparkContext.broadcast(turned)
    keys = [k for k in ("cluster_id", "cell_id", "id") if k in asked.columns]
    columns = ["bits8", "f_rescale8", "f_error8"] if extra else ["bits", "f_rescale", "f_error"]
    stored = codes.select("cluster_id", "cell_id", "id", "f_add", *(F.col(c).alias(n) for c, n in zip(columns, ("bits", "f_rescale", "f_error"), strict=True)))
    joined = asked.select("query_id", "qv", *keys).join(stored, keys)
    joined = joined.select("query_id", "qv", "cluster_id", "cell_id", "id", "bits", "f_add", "f_rescale", "f_error")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            q, c = table.column("query_id").to_numpy(), table.column("cluster_id").to_numpy()
            _, first, of = np.unique(q, return_index=True, return_inverse=True)
            r = rotate(kernels.matrix(table.column("qv").take(pa.array(first))))[of] - shared.value[c]
            q_sq = np.einsum("ij,ij->i", r, r)
            add, rescale, error = (table.column(k).to_numpy() for k in ("f_add", "f_rescale", "f_error"))
            u = unpack(table.column("bits"), extra)[:, : r.shape[1]]
            est, err = add + q_sq - 2 * rescale * np.einsum("ij,ij->i", u, r), error * np.sqrt(q_sq)
            # a row at its center has no code; its distance is known
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("query_id", "cluster_id", "cell_id", "id")), pa.array(est - err), pa.array(est + err)], names=["query_id", "cluster_id", "cell_id", "id", "lb", "ub"])

    return joined.mapInArrow(run, "query_id long, cluster_id int, cell_id long, id long, lb double, ub double")


def sound_bounds(r: np.ndarray, u: np.ndarray, f_add: np.ndarray, f_rescale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query): bounds of squared distances that hold without exception. r: rotated residuals of queries; u: levels.

    Of a row's residual x the code tells <u, x> and |x|. What of x is not along u is across it, so its product with the
    query's residual is at most (Cauchy, Schwarz) its length times the length of what of the query is across u."""
    length, q_sq = np.einsum("ij,ij->i", u, u), np.einsum("ij,ij->i", r, r)
    inner = np.divide(f_add, f_rescale, out=np.zeros(len(u)), where=f_rescale > 0)
    p = u @ r.T
    across = np.sqrt(np.maximum(0, f_add - inner * inner / length) + 1e-12 * f_add)
    off = np.sqrt(np.maximum(0, q_sq[None] - p * p / length[:, None]) + 1e-12 * q_sq[None])
    both = f_add[:, None] + q_sq[None]
    near, err = both - 2 * (inner / length)[:, None] * p, 2 * across[:, None] * off + SLACK * both
    return near - err, near + err


def _kept(centers, r_sq: float, form: str):
    """For Dealt.meet, on rows of codes: those that may be within the radius of a query of the task, by one bit and then by
    eight. form: "rows" or "cells" (with a bit for each of the task's queries, in order of id), or "pairs"."""
    names = {"rows": ["cluster_id", "slice", "piece", "chunk", "cell_id", "id", "kept"], "cells": ["cluster_id", "slice", "piece", "chunk", "cell_id", "kept"], "pairs": ["query_id", "cluster_id", "cell_id", "id", "sure"]}[form]

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {n: [np.zeros(0, bool if n == "sure" else object if n == "kept" else np.int64)] for n in names}
        if queries.num_rows and rows.num_rows:
            task = {n: queries.column(n)[0].as_py() for n in tasks.TASK}
            r = rotate(kernels.matrix(queries.column("vec")) - centers.value[task["cluster_id"]])
            may, cell, ids, asked = tasks.mask(queries, rows), rows.column("cell_id").to_numpy(), rows.column("id").to_numpy(), queries.column("id").to_numpy()
            add, one, more = (rows.column(c).to_numpy() for c in ("f_add", "f_rescale", "f_rescale8"))
            for at in range(0, len(ids), tasks.STEP):
                i = np.arange(at, min(len(ids), at + tasks.STEP))
                u = unpack(rows.column("bits").slice(at, len(i)), False)[:, : r.shape[1]]
                keep = may[i] & (sound_bounds(r, u, add[i], one[i])[0] <= r_sq)
                some = keep.any(axis=1)
                i, keep = i[some], keep[some]
                if not len(i):
                    continue
                lb, ub = sound_bounds(r, unpack(rows.column("bits8").take(pa.array(i)), True), add[i], more[i])
                keep &= lb <= r_sq
                if form == "pairs":
                    x, q = np.nonzero(keep)
                    found = {"query_id": asked[q], "cell_id": cell[i[x]], "id": ids[i[x]], "sure": ub[x, q] <= r_sq}
                else:
                    i, keep = i[keep.any(axis=1)], keep[keep.any(axis=1)]
                    bits = np.packbits(keep, axis=1)
                    found = {"cell_id": cell[i], "id": ids[i], "kept": np.fromiter((x.tobytes() for x in bits), object, len(bits))}
                for n in found.keys() & out.keys():
                    out[n].append(found[n])
            held = {n: np.concatenate(x) for n, x in out.items()}
            if form == "cells" and len(held["cell_id"]):
                order = np.argsort(held["cell_id"], kind="stable")
                cells, first = np.unique(held["cell_id"][order], return_index=True)
                bits = np.frombuffer(b"".join(held["kept"][order]), np.uint8).reshape(len(order), -1)
                held |= {"cell_id": cells, "kept": np.fromiter((x.tobytes() for x in np.bitwise_or.reduceat(bits, first, axis=0)), object, len(cells))}
            n = len(held["cell_id"])
            held |= {k: np.full(n, v) for k, v in task.items() if k in held}
        else:
            held = {n: x[0] for n, x in out.items()}
        kind = {"sure": pa.bool_(), "kept": pa.binary()} | dict.fromkeys(tasks.TASK, pa.int32())
        return pa.table({n: pa.array(held[n], kind.get(n, pa.int64())) for n in names})

    kinds = {"sure": "boolean", "kept": "binary"} | dict.fromkeys(tasks.TASK, "int")
    return run, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names)


def filtered(codes: DataFrame, centers: Centers, dealt: tasks.Dealt, r_sq: float, form: str = "pairs") -> DataFrame:
    """What codes cannot reject of the rows that dealt names: (query_id, cluster_id, cell_id, id, sure), where sure means
    that the bounds alone make it a hit, or for each task its rows or cells with the queries that they are kept for. The
    bounds hold without exception, so no hit is lost. No vector of the base is read."""
    run, schema = _kept(codes.sparkSession.sparkContext.broadcast(centers.matrix), r_sq, form)
    rows = dealt.rows(codes.select("cluster_id", "cell_id", "id", "bits", "f_add", "f_rescale", "bits8", "f_rescale8"), dealt.wanted())
    return dealt.meet(rows, run, schema)


def row_filter(found: DataFrame, r_sq: float) -> DataFrame:
    """Rows that a search would still compare, with `sure`: the upper bound alone makes it a hit."""
    return found.where(F.col("lb") <= r_sq).withColumn("sure", F.col("ub") <= r_sq)


def cell_filter(found: DataFrame, r_sq: float) -> DataFrame:
    """(query_id, cluster_id, cell_id, least_lb) of cells with a member that the codes keep."""
    least = found.groupBy("query_id", "cluster_id", "cell_id").agg(F.min("lb").alias("least_lb"))
    return least.where(F.col("least_lb") <= r_sq)


def emptiness(codes: DataFrame, centers: Centers, queries: DataFrame, r_sq: float, nprobe: int) -> DataFrame:
    """(query_id, is_empty) of every query: in its nprobe nearest clusters no eight-bit bound is within the radius
    among the rows whose one-bit bound is. A query that met no row, or is not finite, is never called empty."""
    good = queries.where(F.col("vec").isNotNull() & V.is_finite("vec"))
    near = build.assign(good.select(F.col("query_id").alias("id"), "vec"), centers, nprobe)
    asked = near.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"), "cluster_id")
    one = bounds(codes, centers, asked)
    met = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("met"))
    close = one.where(F.col("lb") <= r_sq).select("query_id", "cluster_id", "id").join(asked, ["query_id", "cluster_id"])
    hit = bounds(codes, centers, close, True).where(F.col("lb") <= r_sq).select("query_id").distinct().withColumn("hit", F.lit(True))
    joined = queries.select("query_id").join(met, "query_id", "left").join(hit, "query_id", "left")
    return joined.select("query_id", (F.col("met").isNotNull() & F.col("hit").isNull()).alias("is_empty"))
