"""Joint counts over a stream: sums that merge, kept by Structured Streaming's own aggregation state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from noisemill.functions.codec import encode_table
from noisemill.operators.counts import marginals
from noisemill.spec import Schema


def running_marginals(stream: DataFrame, schema: Schema, workload: list[tuple[str, ...]]) -> DataFrame:
    """(clique, cell, n) so far. A private release of them is made once, from a batch read: every
    release spends budget."""
    return marginals(encode_table(stream, schema), schema, workload)


def start(counts: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hand the counts so far to ``write`` (table, batch number), which replaces the last ones wherever it
    keeps them; give ``availableNow=True`` to stop at the end."""
    writer = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
