"""Ranges of ids, so that an order by id needs no single task."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled ids to a range, on average; ranges at most (beyond them, ranges grow: at 10^10 rows to 10^5 rows).
SAMPLED, RANGES = 16, 100_000


def range_rows(n: int, rows: int) -> int:
    """Rows of a range where `rows` are wanted and there are n."""
    return max(rows, -(-n // RANGES))


class Ranges:
    """Ascending ranges of ids of about equal numbers of rows, by split points from a sample.

    Ids may be of any type that has an order; null comes first. An id that many rows share has several
    ranges of its own, by `tie` (64 bits): all its rows' ties in one are less than in the next.
    """

    def __init__(self, docs: DataFrame, id_col: str, rows: int, n: int | None = None) -> None:
        n = docs.count() if n is None else n
        self.parts = max(1, -(-n // range_rows(n, rows)))
        share = min(1.0, SAMPLED * self.parts / max(1, n))
        ids = docs.select(F.col(id_col).alias("i"))
        # a bounded number of ids: SAMPLED * RANGES on average
        found = sorted(_order(r["i"]) for r in (ids.sample(share, 17) if share < 1 else ids).collect())
        splits = [found[len(found) * k // self.parts] for k in range(1, self.parts)] if found else []
        self.shared = docs.sparkSession.sparkContext.broadcast(splits)
        #: Whether an id has more than one split point, so that ties matter.
        self.ties = len(set(splits)) < len(splits)

    def number(self, id_col: Column, tie: Column) -> Column:
        """A row's range, from 0. `tie` is only read where some id has several split points: its rows fill the
        ranges from the first to beyond the last of them, evenly if ties are."""
        shared = self.shared

        def place(find):
            def run(ids: pa.Array) -> pa.Array:
                return pa.array([find(shared.value, _order(x)) for x in ids.to_pylist()], pa.int32())

            return F.arrow_udf(run, "int")(id_col)

        above = place(bisect_right)
        if not self.ties:
            return above
        below = place(bisect_left)
        spread = F.floor((tie / F.lit(2.0**64) + 0.5) * (above - below + 1)).cast("int")
        return F.when(above - below > 1, below + F.least(spread, above - below)).otherwise(above)


def _order(x) -> tuple:
    return (x is not None, x)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
