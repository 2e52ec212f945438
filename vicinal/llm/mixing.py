"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of a fixed number of rows. Block k of a source of weight w is released
at slot floor(k / w) and due at slot ceil((k + 1) / w); each slot goes to the released block that is due
first. With weights that add up to 1 no block is ever late (Baruah et al., 1996), so at every slot each
source has had w times the slots so far, within less than one block. Weights are exact fractions: nothing
is rounded. Their common denominator is the schedule's period; one period, or as much of it as the rows
reach, is laid out as a table of (source, block, slot), and every row's slot follows from its rank in its
source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from numbers import Rational

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.llm.ranges import range_rows, unused
from vicinal.plans.shared import materialize, new_path

#: Rows of a block; what default weights add up to, about; slots that are laid out at a time; rows of a table
#: that is broadcast at most.
BLOCK_ROWS, PARTS, SLICE, BROADCAST_ROWS = 16, 100_000, 1 << 20, 1 << 18
#: Rows of a range of ids, on average, in which ranks are counted: a RANGES-th of all, between these bounds. A
#: source of any share is thus spread over as many tasks, and no task ranks more than a bounded number.
RANGES, FEWEST_ROWS, MOST_ROWS = 200, 1_000, 50_000


def whole_weights(weights: Mapping[str, float | Rational]) -> dict[str, int]:
    """The weights as whole numbers without a common divisor, in the same proportions. A floating-point weight
    is the decimal that it is written as: 0.1 is a tenth."""
    if not weights:
        raise ValueError("no weights")
    if any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be finite and above 0")
    exact = {x: Fraction(w) if isinstance(w, Rational) else Fraction(repr(float(w))) for x, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {x: int(w * scale) for x, w in exact.items()}
    shared = math.gcd(*whole.values())
    return {x: w // shared for x, w in whole.items()}


def release(k: int, weight: int, total: int) -> int:
    return k * total // weight


def deadline(k: int, weight: int, total: int) -> int:
    return -(-(k + 1) * total // weight)


def pfair(whole: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """(source, its block) for slot 0, 1, ... without end; after sum(whole) slots the pattern repeats."""
    total = sum(whole.values())
    waiting = [(release(0, w, total), deadline(0, w, total), x, 0) for x, w in whole.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, due, x, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, x, k))
        due, x, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError(f"block {k} of {x} is late")
        yield x, k
        heapq.heappush(waiting, (release(k + 1, whole[x], total), deadline(k + 1, whole[x], total), x, k + 1))
        slot += 1


def layout(spark: SparkSession, whole: Mapping[str, int], slots: int) -> DataFrame:
    """(s, k, t): the source and its block at each of the first slots. The driver holds SLICE of them at a
    time; what is more goes to the shared folder slice by slice."""
    plan = pfair(whole)
    schema = "s string, k long, t long"

    def table(first: int) -> DataFrame:
        part = list(islice(plan, min(SLICE, slots - first)))
        columns = [pa.array([x for x, _ in part], pa.string()), pa.array([k for _, k in part], pa.int64()), pa.array(range(first, first + len(part)), pa.int64())]
        return spark.createDataFrame(pa.table(columns, names=["s", "k", "t"]), schema)

    if slots <= SLICE:
        return table(0)
    path = new_path(spark, "schedule")
    for first in range(0, slots, SLICE):
        table(first).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranks(docs: DataFrame, id_col: str, source: str) -> DataFrame:
    """docs with _n, the row's rank from 0 by id within its source.

    A source may hold any share of the rows: ranks are counted within a range of ids of one source, and
    the counts of the source's ranges before it are added. Null ids come first; rows of equal id, however
    many, go to ranges at random and are ranked among themselves in that order.
    """
    n = docs.count()
    rows = range_rows(n, min(max(n // RANGES, FEWEST_ROWS), MOST_ROWS))
    order = [F.col(id_col).asc_nulls_first(), F.col("_tie")]
    cut = docs.withColumn("_tie", F.rand(17)).repartitionByRange(max(1, -(-n // rows)), *order)
    cut = materialize(cut.withColumn("_part", F.spark_partition_id()), "ranges")
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(source, "_part").orderBy(*order)) - 1)
    before = cut.groupBy(source, "_part").count().withColumn(
        "_before", F.coalesce(F.sum("count").over(Window.partitionBy(source).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select(source, "_part", "_before")
    return local.join(before, [source, "_part"]).withColumn("_n", F.col("_local") + F.col("_before")).drop("_part", "_tie", "_local", "_before")


def default_weights(counts: Mapping[str, int], temperature: float = 0.5) -> dict[str, int]:
    """Target weights where none are given: each source's rows to the power of `temperature`, in whole parts of
    some PARTS in all, and one at least."""
    size = {x: n**temperature for x, n in counts.items()}
    total = sum(size.values())
    return {x: max(1, round(s * PARTS / total)) for x, s in size.items()}


def mix(
    docs: DataFrame,
    weights: Mapping[str, float | Rational] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of docs: id_col, source, block, slot, release, deadline, position, backlogged.

    source is the row's source, with null and the empty name as one. block counts the source's blocks
    in order of id; slot is where the schedule puts it; position orders all rows (slot, then the place in
    the block), with gaps where a source has run out. backlogged: no source had run out before this slot,
    so the deviation bound holds up to here. No row is dropped or repeated. Any number of sources may have
    any weights; the driver holds a few numbers for each. A source without a weight is an error. An empty
    table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    named = materialize(named, "sources")
    counts = {r["source"]: r["count"] for r in named.groupBy("source").count().collect()}
    spark = docs.sparkSession
    if not counts:
        return named.select(
            F.col("id").alias(id_col), "source", *(F.lit(0).cast("long").alias(c) for c in ("block", "slot", "release", "deadline", "position")), F.lit(True).alias("backlogged")
        ).limit(0)
    whole = whole_weights(default_weights(counts) if weights is None else weights)
    if missing := sorted(set(counts) - set(whole)):
        raise ValueError(f"no weight for {missing[:5]}")
    total = sum(whole.values())
    blocks = {x: -(-n // block_rows) for x, n in counts.items()}
    last = max(deadline(n - 1, whole[x], total) for x, n in blocks.items())
    if max(last * block_rows, total) >= 10**18:
        raise ValueError("weights so uneven that positions exceed 64 bits")
    slots = min(total, last)
    table = layout(spark, whole, slots)
    # the first slot that some source leaves empty: that of its first block beyond its rows
    ends = spark.createDataFrame([(x, blocks.get(x, 0) // w, blocks.get(x, 0) % w) for x, w in whole.items()], "s string, turn long, k long")
    first = ends.join(table, ["s", "k"]).agg(F.min(F.col("turn") * total + F.col("t"))).first()[0]
    per = spark.createDataFrame(list(whole.items()), "source string, per long")
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    ranked = ranks(named, "id", "source").withColumn("block", F.floor(F.col("_n") / block_rows)).join(small(per, len(whole)), "source")
    ranked = ranked.withColumn("k", F.col("block") % F.col("per")).withColumn("turn", F.floor(F.col("block") / F.col("per")))
    slotted = ranked.join(small(table.withColumnRenamed("s", "source"), slots), ["source", "k"])
    slot = F.col("turn") * total + F.col("t")
    wide = "CAST(block AS DECIMAL(19,0))"
    return slotted.select(
        F.col("id").alias(id_col),
        "source",
        "block",
        slot.alias("slot"),
        F.expr(f"({wide} * {total}BD) div per").alias("release"),
        F.expr(f"(({wide} + 1) * {total}BD + per - 1) div per").alias("deadline"),
        (slot * block_rows + F.col("_n") % block_rows).alias("position"),
        (slot < (last if first is None else first)).alias("backlogged"),
    )


def placed(docs: DataFrame, position: str, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float | Rational] | None = None) -> DataFrame:
    """docs with the schedule's position in a new column, range-partitioned and sorted by it. Rows of equal
    id have the least position of them."""
    key = unused(docs, "_id")
    order = mix(docs, weights, id_col, source_col).groupBy(F.col(id_col).alias(key)).agg(F.min("position").alias(position))
    joined = docs.join(order, docs[id_col].eqNullSafe(F.col(key)))
    return joined.drop(key).orderBy(position)


def in_mixed_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float | Rational] | None = None) -> DataFrame:
    """docs, all rows and columns as they are, range-partitioned and sorted by the schedule's position:
    read part by part, they come in the mix's order."""
    place = unused(docs, "_position")
    return placed(docs, place, id_col, source_col, weights).drop(place)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
