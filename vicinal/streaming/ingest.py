"""Keep an index up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vicinal.operators.index import AnnIndex


def ingest(stream: DataFrame, path: str, *, id_column: str, column: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Insert every micro-batch into the index at ``path``.

    A replayed batch first deletes the ids that it brings, so rows do not double.
    """

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        index = AnnIndex.load(batch.sparkSession, path)
        index.delete(batch, id_column)
        index.insert(batch, id_column=id_column, column=column)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
