"""Streaming ingest into an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from annora.index import VectorIndex


def ingest(stream: DataFrame, index: VectorIndex, checkpoint: str, on_drift: Callable[[VectorIndex], None] | None = None, **trigger) -> StreamingQuery:
    """Inserts each micro-batch of stream as one version, which notes its number: one that is repeated after a failure changes nothing.

    The stream is known by its checkpoint folder, which has the numbers.
    """

    def take(batch: DataFrame, number: int) -> None:
        index.insert(batch, batch=(checkpoint, number))
        if on_drift and index.needs_rebuild():
            on_drift(index)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
