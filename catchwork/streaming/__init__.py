"""Incremental runs: new files are processed once, results land idempotently by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_files(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Apply ``transform`` to the parquet files of ``source`` that no earlier run has seen, and stop.

    A batch overwrites its own folder of the sink, so a batch that is repeated after a failure leaves no duplicates.
    """

    def land(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
