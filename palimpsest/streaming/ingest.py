"""A stream of documents into an index, each micro-batch once.

Spark may hand a micro-batch over again after a failure. The index remembers
the last batch that it committed, in the same manifest, so a batch that comes
again is passed over, and one that broke off before its commit is taken in.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.engine import Engine


def take_batch(engine: Engine, stream: str, batch: DataFrame, batch_id: int) -> bool:
    """Merges one micro-batch (path, mtime, length, content). False: it was committed before.

    Of several rows of a path in a batch one is taken in; rows with a null
    path are left out; an empty batch only moves the mark on.
    """
    with engine.lock():
        done = engine.store.manifest().get("streams", {}).get(stream, -1)
        if batch_id <= done:
            return False
        engine.take_in(batch, dt.datetime.now(dt.timezone.utc), streams={stream: batch_id})
        return True


def ingest(engine: Engine, documents: DataFrame, stream: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts taking in a streaming DataFrame of documents."""
    writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: take_batch(engine, stream, batch, n) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
