"""Streams into tables: every micro-batch is one append, which the catalog names together with the batch's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.engine import Engine


def append_stream(engine: Engine, name: str, rows: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream's rows to a table, each batch exactly once.

    Rows and number of a batch enter the catalog in one step: a batch that broke
    off before that leaves a folder nobody reads, and one that comes again after
    it is passed over.  The checkpoint folder names the stream.
    """

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            with engine.locks.hold({name: "X"}):
                engine.append(name, batch, (checkpoint, number))

    engine.catalog.get(name)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
