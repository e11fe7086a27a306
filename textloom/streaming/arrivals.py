"""The operators on documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def applied(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the operator's rows for each batch of documents to ``folder`` as Parquet, under ``batch=<number>``.

    Every document must arrive whole in one batch.  A batch that runs again
    writes over its own rows, so each is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
