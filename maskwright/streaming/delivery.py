"""Delivery of restored streams: a batch's rows count as delivered, and its report is made, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def deliver(stream: DataFrame, path: str, checkpoint: str, report: Callable[[DataFrame], None] | None = None, partition: str = "batch", **trigger) -> StreamingQuery:
    """Writes each micro-batch under path/<partition>=<number> and commits it by the checkpoint.

    A batch that is run again after a failure replaces what it wrote before, so readers see every row once. report gets
    a snapshot of the batch before it is written; if it raises, nothing of the batch is delivered. trigger: as for
    DataStreamWriter.trigger(), by default all that is there.
    """

    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if report is not None:
                report(held)
            held.write.mode("overwrite").parquet(f"{path}/{partition}={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
