"""Features that arrive as a stream, appended to an index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearword.plans import index


def append_batch(path: str):
    """A foreachBatch function. A batch that is replayed takes the place of what it wrote before."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            index.append(batch.sparkSession, path, batch, f"stream-{number}")

    return apply


def ingest(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start appending a stream of (id, lat, lon, text) to the index at ``path``, all that is there, then stop."""
    return features.writeStream.foreachBatch(append_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
