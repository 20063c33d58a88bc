"""Message streams: decoding, duplicates, and outcomes to their sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sluice.operators.messages import MAX_ATTEMPTS, decode, delivery

#: Outcome -> name of its sink.
SINKS = {"handled": "handled", "retried": "retry", "dead_lettered": "dead", "rejected": "rejected"}


def dedup_stream(messages: DataFrame, time: str, delay: str) -> DataFrame:
    """The first message of each id; ids are remembered as long as the watermark asks for."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["message_id"])


def deliver_stream(messages: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Decodes each batch, lets ``handle`` add ``error`` (null where handled) and writes by outcome."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = delivery(handle(decode(batch))).persist()
        try:
            for outcome, name in SINKS.items():
                done.where(F.col("outcome") == outcome).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            done.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Handler:
    """What is done with messages: ``handle`` adds ``error`` (null where handled) to a decoded batch; ``failed`` is given
    the messages of a batch whose attempts are used up, and the batch's id. Both may see a batch again after a crash."""

    handle: Callable[[DataFrame], DataFrame]
    failed: Callable[[DataFrame, int], None] | None = None


def deliver_with_retries(messages: DataFrame, handler: Handler, path: str, checkpoint: str, max_attempts: int = MAX_ATTEMPTS) -> StreamingQuery:
    """Delivers new messages, and those that come back: the stream reads its own retry sink beside ``messages``.

    A message (body, and any other columns) that fails is written to the retry sink with the number of its next attempt and
    its error, and arrives again in a later batch; at ``max_attempts`` it goes to the dead sink and to ``handler.failed``,
    once. A batch that runs again replaces its own outputs, those of the retry sink before anything has read them.
    """
    spark = messages.sparkSession
    own = [f for f in messages.schema.fields if f.name not in ("attempt", "last_error")]
    schema = StructType([*own, StructField("attempt", IntegerType()), StructField("last_error", StringType())])
    names = [f.name for f in own]
    back = f"{path}/retry"
    spark.createDataFrame([], schema).write.mode("append").parquet(back)  # a stream's folder has to be there
    beside = [F.col(c).cast(k).alias(c) if c in messages.columns else F.lit(None).cast(k).alias(c) for c, k in (("attempt", "int"), ("last_error", "string"))]
    arriving = messages.select(*names, *beside).unionByName(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(back))

    def write(batch: DataFrame, batch_id: int) -> None:
        done = delivery(handler.handle(decode(batch)), max_attempts).persist()
        try:
            of = lambda outcome: done.where(F.col("outcome") == outcome)
            for outcome in ("handled", "dead_lettered", "rejected"):
                of(outcome).write.mode("overwrite").parquet(f"{path}/{SINKS[outcome]}/batch={batch_id}")
            if handler.failed is not None:
                handler.failed(of("dead_lettered"), batch_id)
            again = of("retried").select(*names, F.col("next_attempt").cast("int").alias("attempt"), "last_error")
            again.write.mode("overwrite").parquet(f"{back}/batch={batch_id}")
        finally:
            done.unpersist()

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_settled(start: Callable[[], StreamingQuery], max_attempts: int = MAX_ATTEMPTS) -> int:
    """Runs a stream with retries until nothing comes back; how often it ran. A message that is there at the beginning needs no more than ``max_attempts`` runs and one that finds nothing."""
    for n in range(1, max_attempts + 2):
        query = start()
        query.awaitTermination()
        if not sum(p["numInputRows"] for p in query.recentProgress):
            return n
    return max_attempts + 1
