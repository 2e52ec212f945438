"""python -m vicinal build|search --config C --index I [--base B] [--gt G --queries Q --no-cell-filter --dump-range-hits P]

Vectors are Parquet tables with id (queries: query_id) and vec, or .fbin files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal import search
from vicinal.functions import vectors as V
from vicinal.operators import cascade, metrics
from vicinal.sources import vector_files
from vicinal.sources.config import parse_config


def vectors(spark: SparkSession, path: str, key: str, dtype: str | None) -> DataFrame:
    if path.endswith(".fbin"):
        vector_files.register(spark)
        found = spark.read.format("fbin").option("path", path).option("dtype", dtype or "float32").load().withColumnRenamed("id", key)
    else:
        found = spark.read.parquet(path)
    return found.select(F.col(key).cast("long").alias(key), V.as_double("vec").alias("vec"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vicinal", description=__doc__)
    parser.add_argument("command", choices=["build", "search"])
    for name in ("--config", "--index"):
        parser.add_argument(name, required=True)
    for name in ("--base", "--gt", "--queries", "--dump-range-hits"):
        parser.add_argument(name)
    parser.add_argument("--no-cell-filter", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("vicinal").getOrCreate()
    config = parse_config("\n".join(r["value"] for r in spark.read.text(a.config).collect()))
    if a.command == "build":
        if not a.base:
            parser.error("build takes --base")
        search.build_from(config, vectors(spark, a.base, "id", config["vec_dtype"]), a.index)
        return
    if not (a.gt and a.queries):
        parser.error("search takes --gt and --queries")
    queries = vectors(spark, a.queries, "query_id", config["vec_dtype"])
    found = search.search_by_truth(spark, config, cascade.load_index(spark, a.index), queries, a.gt, not a.no_cell_filter)
    if a.dump_range_hits:
        metrics.write_hits(found.hits, a.dump_range_hits)
    print(search.figures_json(found.figures))


if __name__ == "__main__":
    main()
