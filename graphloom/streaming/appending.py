"""Appending evidence as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.operators.stores import TripleStore


def append_stream(arriving: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append micro-batches of new evidence to the store in ``folder``: a batch writes its new rows, and no others.

    A batch is committed under its number: one that is run again, after a restart, adds nothing twice. Only the batch is
    shuffled; stored rows are compared where they are.
    """

    def one(batch: DataFrame, number: int) -> None:
        TripleStore(batch.sparkSession, folder).append(f"{number:012}", batch)

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
