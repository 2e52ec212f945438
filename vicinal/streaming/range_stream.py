"""Range search for a stream of queries against a table at rest. The distance test keeps no state, so there
are no watermarks: each micro-batch of queries is one range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vicinal.operators.range_join import range_join


def range_search_stream(base: DataFrame, queries: DataFrame, r_sq: float, sink, checkpoint: str, **trigger) -> StreamingQuery:
    """queries: a streaming (query_id, vec). sink(pairs, epoch) gets the pairs of a micro-batch; it may see an
    epoch again after a failure, so it should write by epoch."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(range_join(base, df, r_sq), epoch)

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
