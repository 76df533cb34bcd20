"""Routed ingestion: each micro-batch of a stream is keyed, routed, fanned out and appended."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shardframe.operators.table import ShardedTable
from shardframe.operators.writes import insert
from shardframe.sources.store import ShardStore


def ingest(stream: DataFrame, table: ShardedTable, store: ShardStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the stream's rows to the store. A micro-batch that is run again after a failure replaces what its first run
    left, and merges the same metadata. Streams into one store are told apart by their checkpoints."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def append(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.append(insert(table, batch)[1].select(*store.schema.names), f"{name}-{batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
