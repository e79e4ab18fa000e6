"""Micro-batch sink: one folder per batch, rewritten when a batch is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_sink(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start writing ``rows``; without ``every`` it ends when the input is read.

    A restart repeats the last batch under the same id, and overwriting its
    folder makes that harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
