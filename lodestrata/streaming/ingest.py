"""Bounded and continuous ingest of change streams into a table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestrata.sources.store import KVTable


def ingest(changes: DataFrame, table: KVTable, checkpoint: str, *, available_now: bool = True, compact_every: int = 0, now: int | None = None) -> StreamingQuery:
    """Append each micro-batch of ``changes`` (schema ``LOG``) to ``table`` as one commit.

    The commit names the batch, so one that is replayed after a crash is not
    written again.  ``compact_every`` n: a compaction is tried after every n
    batches, at the time ``now`` (the clock's, unless given).
    """

    def one(batch: DataFrame, number: int) -> None:
        table.write(batch, batch=(checkpoint, number))
        if compact_every and number % compact_every == compact_every - 1:
            table.compact(int(time.time()) if now is None else now)

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_stream(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a change stream to a Parquet log, exactly once through the sink's own log."""
    return (
        changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
