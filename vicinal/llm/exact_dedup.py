"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of the partitions name the digests that may be frequent. An exact count
verifies them; the verified ones, at most `counters` of them whatever the input, are broadcast and
their rows are settled on the map side. All other digests go through an ordinary shuffle, in which
no key can hold more than 2 * rows / counters rows. Texts never move: only (id, 32-byte digest) does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.ranges import unused
from vicinal.plans.shared import materialize

#: Counters of a Misra-Gries summary, hence also the most winners that are ever broadcast (64 KB).
COUNTERS = 1024


def normalised(text):
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def misra_gries(keys: Iterable[tuple[bytes, int]], counters: int) -> dict[bytes, int]:
    """A summary that holds every key with more than total / (counters + 1) occurrences.

    Takes (key, occurrences) pairs, so it also merges summaries. Counts are lower bounds.
    """
    held: dict[bytes, int] = {}
    for key, n in keys:
        if key in held:
            held[key] += n
        elif len(held) < counters:
            held[key] = n
        else:
            least = min(n, min(held.values()))
            held = {k: v - least for k, v in held.items() if v > least}
            if n > least:
                held[key] = n - least
    return held


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            # equal digests of a batch first become one entry, so a batch costs one pass
            counted = batch.column(0).value_counts()
            pairs = zip(counted.field(0).to_pylist(), counted.field(1).to_pylist(), strict=True)
            held = misra_gries([*held.items(), *pairs], counters)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "n"]
            )

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, group_size, keep) of digests that occur more than rows / counters times; all that
    occur more than twice as often are among them.

    Summaries of partitions are merged twice (by a hash of the digest, then in one task that gets
    at most 64 * counters entries); the winners' exact counts come from a second look at the digests.
    """
    seen = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
    # a summary falls short of a true count by rows / counters at most, and the sums of all summaries
    # add up to no more than rows: a key above 2 * rows / counters is among the first `counters`
    candidates = seen.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters)
    total = digests.count()
    exact = (
        digests.join(F.broadcast(candidates.select("digest")), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("keep"))
    )
    return exact.where(F.col("group_size") > F.lit(max(1, total // counters)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of rows whose normalised texts are equal the one with the smallest id stays. Null texts count as
    empty and are equal to one another and to white space only after normalisation gives the same
    string. Rows that share one id and text are all kept if that id is the group's smallest; a null id ranks
    after every other, and in a group of null ids only, all rows stay with a null keep_id. An empty
    table gives no rows. Other columns are not read.
    """
    digests = materialize(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")),
        "digests",
    )
    winners = materialize(frequent_digests(digests, counters), "frequent")
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("keep"))
    columns = ["id", "digest", "group_size", "keep"]
    settled = hot.select(columns).unionByName(rest.join(groups, "digest").select(columns))
    return settled.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps; rows repeated with the smallest id of a group all stay."""
    dropped = exact_dedup(docs, id_col, text_col).where(~F.col("kept"))
    key, mark = unused(docs, "_id"), unused(docs, "_digest")
    keys = dropped.select(F.col(id_col).alias(key), F.unhex("text_sha256").alias(mark))
    digest = F.unhex(F.sha2(normalised(docs[text_col]), 256))
    return docs.join(keys, docs[id_col].eqNullSafe(F.col(key)) & (digest == F.col(mark)), "left_anti")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
