"""Cleaning a corpus: five stages over documents, each written as Parquet and read again.

Every stage but the last takes and returns rows with the columns of documents.

1. language_id: texts without an identified language go; a missing language is filled in.
2. exact_dedup: of equal texts (white space aside) the row with the least id stays.
3. near_dedup: of each component of near duplicates (five-word shingles, similarity 0.8) the row with
   the least id stays.
4. mixing: all rows, in the order of a Pfair schedule of their sources.
5. bpe: the token ids of each text, with digests that show that decoding gives the text back, and each row's
   source and position in the schedule; sorted by position. Spark reads files in an order of its own, so the
   schedule, which follows from the rows alone, is worked out again here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import bpe, exact_dedup, language_id, mixing, simhash
from vicinal.plans.shared import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.placed(docs, "position").select(F.struct("doc_id", "source", "position").alias("row"), "text")
    return bpe.bpe_round_trip(rows, bpe.default_vocabulary(), "row", keep=("ids",)).select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Context trees, SimHash components and byte-pair encoding have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
