"""Streams of operations into a store, and a streaming latest view. Sequence order decides, not arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.collapse import collapse
from tidemark.sources.store import OrderedStore


def ingest(stream: DataFrame, store: OrderedStore, checkpoint: str, name: str = "ingest", available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch once: a batch that is replayed after a failure is known by its id."""

    def commit(rows: DataFrame, batch: int) -> None:
        store.ingest(rows, f"{name}-{batch}")

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(stream: DataFrame, key: str = "k") -> DataFrame:
    """The running latest view as a streaming aggregation (complete or update mode); a late, older entry loses."""
    return collapse(stream, key)
