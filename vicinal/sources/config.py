"""Search configuration, and ground-truth files. Both are checked on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("cluster_num", "K", "mem_budget", "mode", "gorder_window")
_TRUE, _FALSE = {"true", "1"}, {"false", "0"}
_TYPES = {"0": "float32", "1": "int8", "2": "uint8", "float32": "float32", "int8": "int8", "uint8": "uint8"}


def _bool(v: str) -> bool:
    if v.lower() not in _TRUE | _FALSE:
        raise ValueError(f"not a truth value: {v}")
    return v.lower() in _TRUE


def _dtype(v: str) -> str:
    if v.lower() in ("3", "fp16", "float16"):
        raise ValueError("half precision is not supported")
    if v.lower() not in _TYPES:
        raise ValueError(f"no such type: {v}")
    return _TYPES[v.lower()]


def _choice(*allowed: str):
    def parse(v: str) -> str:
        if v not in allowed:
            raise ValueError(f"{v}: one of {', '.join(allowed)} is wanted")
        return v

    return parse


#: Key -> (parser, default).
KEYS = {
    "cluster_num": (int, None), "K": (int, None), "mem_budget": (float, None), "mode": (_choice("disk"), None), "gorder_window": (int, None),
    "io_queue_depth": (int, 256), "cell_cache_share_pct": (float, 0.0), "approx_alpha": (float, 1.0), "pca_rank": (int, 32), "slab_count": (int, 128),
    "target_cell_vecs": (int, 24), "split_axis_policy": (_choice("fixed"), "fixed"), "cell_filter_enabled": (_bool, True),
    "pca_cluster_prune_enabled": (_bool, True), "slab_cluster_prune_enabled": (_bool, True), "fast_path_enabled": (_bool, False),
    "fast_path_mode": (_choice("rbq", "exact"), "rbq"), "fast_path_nprobe_N": (int, 128), "slow_path_rbq_prefilter_enabled": (_bool, False),
    "slow_path_rbq_phase_b_enabled": (_bool, False), "data_hnsw_enabled": (_bool, False), "data_hnsw_M": (int, 16),
    "data_hnsw_ef_construction": (int, 100), "data_hnsw_ef": (int, 100), "data_hnsw_margin_delta": (float, 0.0), "sqg_m": (int, 64),
    "sqg_num_iter": (int, 3), "sqg_ef_build": (int, 100), "sqg_ef_search": (int, 300), "sqg_centroid_ef_search": (int, 20),
    "partition_objective": (_choice("standard", "anisotropic"), "standard"), "eta": (float, 1.0), "unit_normalize_prebuild": (_bool, False), "vec_dtype": (_dtype, None),
}


@dataclass
class Config:
    values: dict

    def __getitem__(self, key: str):
        return self.values[key]


def parse_config(text: str) -> Config:
    """`<key> <value>` lines, # comments. Unknown or repeated keys, missing values, further words and missing
    required keys are errors, as are values that don't go together."""
    found: dict = {}
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        if len(words) != 2:
            raise ValueError(f"line {number}: a key and a value are wanted")
        key, value = words
        if key not in KEYS:
            raise ValueError(f"line {number}: no such key: {key}")
        if key in found:
            raise ValueError(f"line {number}: {key} is repeated")
        try:
            found[key] = KEYS[key][0](value)
        except ValueError as e:
            raise ValueError(f"line {number}: {key}: {e}") from None
    if missing := [k for k in REQUIRED if k not in found]:
        raise ValueError(f"missing: {', '.join(missing)}")
    config = {k: d for k, (_, d) in KEYS.items()} | found
    _check(config)
    return Config(config)


def _check(c: dict) -> None:
    rules = [
        (c["cluster_num"] > 0 and c["K"] > 0 and c["mem_budget"] > 0, "cluster_num, K and mem_budget are above 0"),
        (1 <= c["io_queue_depth"] <= 32768, "io_queue_depth is from 1 to 32768"),
        (0 <= c["cell_cache_share_pct"] <= 100, "cell_cache_share_pct is from 0 to 100"),
        (math.isfinite(c["approx_alpha"]) and c["approx_alpha"] >= 1, "approx_alpha is finite and at least 1"),
        (c["pca_rank"] >= 0 and c["target_cell_vecs"] >= 2, "pca_rank is at least 0, target_cell_vecs at least 2"),
        (0 <= c["slab_count"] < c["cluster_num"] or c["slab_count"] == KEYS["slab_count"][1], "slab_count is below cluster_num"),
        (1 <= c["fast_path_nprobe_N"] and (not c["fast_path_enabled"] or c["fast_path_nprobe_N"] <= c["cluster_num"]), "fast_path_nprobe_N is at most cluster_num"),
        (not (c["fast_path_enabled"] and c["data_hnsw_enabled"]), "only one classifier may be on"),
        (not c["fast_path_enabled"] or c["partition_objective"] == "standard", "the fast path takes the standard objective"),
        (not c["slow_path_rbq_prefilter_enabled"] or c["fast_path_enabled"] and c["fast_path_mode"] == "rbq" and c["cell_filter_enabled"], "the code prefilter takes the rbq fast path and the cell filter"),
        (not c["slow_path_rbq_phase_b_enabled"] or c["slow_path_rbq_prefilter_enabled"], "phase B takes the code prefilter"),
        (c["data_hnsw_margin_delta"] >= 0, "data_hnsw_margin_delta is at least 0"),
        (c["sqg_num_iter"] >= 3 and min(c["sqg_m"], c["sqg_ef_build"], c["sqg_ef_search"], c["sqg_centroid_ef_search"]) > 0, "sqg_num_iter is at least 3, other sqg values above 0"),
        (c["eta"] > 0, "eta is above 0"),
        (c["partition_objective"] == "standard" or c["vec_dtype"] in (None, "float32"), "the anisotropic objective takes float32"),
    ]
    for ok, said in rules:
        if not ok:
            raise ValueError(said)
    if c["partition_objective"] == "anisotropic":
        c["unit_normalize_prebuild"] = True


def with_suffix(path: str, suffix: str) -> str:
    """suffix before the extension of a path's last part."""
    head, slash, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return head + slash + (f"{stem}{suffix}.{ext}" if dot and stem else name + suffix)


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary: one row, counts(query_id, n_hits)) of a ground-truth JSON file."""
    raw = spark.read.json(path, multiLine=True)
    counts = raw.select(F.posexplode("per_query_counts").alias("query_id", "n_hits")).select(F.col("query_id").cast("long"), F.col("n_hits").cast("long"))
    stats = "per_query_count_stats"
    summary = raw.select(
        F.col("total_in_range").cast("long"), F.col("n_queries").cast("long"), F.col(f"{stats}.min").cast("long").alias("min_hits"),
        F.col(f"{stats}.median").cast("double").alias("median_hits"), F.col(f"{stats}.max").cast("long").alias("max_hits"),
        F.col(f"{stats}.zero_hit_queries").cast("long").alias("zero_hit_queries"),
    )
    return summary, counts


def resolve_dtype(truth: str | None, config: str | None) -> str:
    """The truth file's type, else the configuration's, else float32; the two must agree."""
    if truth and config and _dtype(truth) != _dtype(config):
        raise ValueError(f"{truth} and {config} don't agree")
    return _dtype(truth or config or "float32")
