"""Rows that arrive as files, checked batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.validate import accepted, rejected


def table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files under ``path`` as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def validate_stream(stream: DataFrame, check: Callable[[DataFrame], DataFrame], ok_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Writes accepted and rejected rows of each batch; a batch that is run again replaces its own output.

    ``check`` adds ``errors``; what it looks at together must arrive in one batch (a chunk does).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = check(batch).persist()
        try:
            accepted(checked).write.mode("overwrite").parquet(f"{ok_path}/batch={batch_id}")
            rejected(checked).write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        finally:
            checked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
