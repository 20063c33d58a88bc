"""Chunk counts and row sums per import, kept up by what changes.

A chunk's state changes; the change takes back what the chunk counted for before and adds what it counts for
now. The state before is keyed state (chunks by hash bucket, so a change reads its own bucket alone), and what goes on is a
difference; differences are summed per import in each batch and become the batch's segment of the kept
table. A reader sums the segments, and merging them keeps these few.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sluice.functions.status import CHUNK_TERMINAL
from sluice.streaming.buckets import BUCKETS, bucket_of, packed, unpacked
from sluice.streaming.segments import Segments

#: What an import's chunks are summed up to.
SUMS = ("chunks_total", "chunks_finished", "valid_rows", "rejected_rows")
MOST_SEGMENTS = 16


#: A chunk's state: its last version, and what it counts for.
CHUNKS = pa.schema([("id", pa.string()), ("sequence", pa.string()), *((c, pa.int64()) for c in ("version", *SUMS[1:]))])


def _difference(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the changes of a bucket's chunks add to their imports' sums; changes older than a chunk's last one have no effect."""
    names = CHUNKS.names
    before = pd.DataFrame(dict(zip(names, unpacked(CHUNKS, state.get[0] if state.exists else None), strict=True)), columns=names)
    rows = pd.concat([f[names] for f in frames], ignore_index=True).astype({c: "int64" for c in names[2:]})
    both = pd.concat([before, rows[rows["version"] >= 0]], ignore_index=True)
    now = both.sort_values("version", kind="stable").drop_duplicates(names[:2], keep="last")
    state.update((packed(CHUNKS, *(now[c] for c in names)),))
    signed = pd.concat([now.assign(n=1), before.assign(n=-1)], ignore_index=True)
    signed = signed[["id", "n"]].join(signed[names[3:]].mul(signed["n"], axis=0)).groupby("id", dropna=False, sort=False).sum().reset_index()
    signed = signed[(signed[["n", *names[3:]]] != 0).any(axis=1)]
    if len(signed):
        yield signed.set_axis(["id", *SUMS], axis=1).astype({"id": object})


def differences(changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bulk_import_id and differences of ``SUMS``, for a stream of chunk states (bulk_import_id, sequence, status, valid_rows, invalid_rows, version).

    Versions are whole numbers from 0; of equal ones the last that arrives holds. A null sum counts 0. The state is kept by bucket of chunks
    (see ``buckets``), so the chunks of one import fall into many.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    finished = F.coalesce(F.col("status").isin(*CHUNK_TERMINAL), F.lit(False)).cast("long")
    rows = changes.select(
        bucket_of(F.col("bulk_import_id"), F.col("sequence"), buckets=buckets), F.col("bulk_import_id").cast("string").alias("id"), F.col("sequence").cast("string").alias("sequence"),
        F.col("version").cast("long").alias("version"), finished.alias(SUMS[1]), whole("valid_rows").alias(SUMS[2]), whole("invalid_rows").alias(SUMS[3]),
    )
    out = StructType([StructField("id", StringType()), *(StructField(c, LongType()) for c in SUMS)])
    told = rows.groupBy("bucket").applyInPandasWithState(_difference, out, "chunks binary", "append", GroupStateTimeout.NoTimeout)
    return told.select(F.col("id").cast(changes.schema["bulk_import_id"].dataType).alias("bulk_import_id"), *SUMS)


class KeptCounts:
    """The kept table at a folder."""

    def __init__(self, folder: str, most_segments: int = MOST_SEGMENTS) -> None:
        self.folder, self.most_segments, self.segments = folder.rstrip("/"), most_segments, Segments(folder)

    def _path(self, name: str) -> str:
        return f"{self.folder}/sums/{name}"

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("bulk_import_id").agg(*(F.sum(c).alias(c) for c in SUMS))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """A batch of differences; the same batch again takes its own place."""
        earlier = [s for s in self.segments.current() if s["upto"] < batch_id]
        self._summed(batch).write.mode("overwrite").parquet(self._path(f"batch-{batch_id}"))
        self.segments.commit([*earlier, {"name": f"batch-{batch_id}", "upto": batch_id}])
        if len(earlier) >= self.most_segments:
            self.merge(batch.sparkSession)

    def merge(self, spark: SparkSession) -> None:
        """All segments but the last one, whose batch may run again, as one."""
        *old, last = self.segments.current()
        if len(old) < 2:
            return
        name = f"merged-{uuid.uuid4().hex}"
        self._summed(spark.read.parquet(*(self._path(s["name"]) for s in old))).write.parquet(self._path(name))
        self.segments.commit([{"name": name, "upto": old[-1]["upto"]}, last])

    def read(self, spark: SparkSession) -> DataFrame:
        """bulk_import_id and ``SUMS`` of every import with a chunk."""
        return self._summed(spark.read.parquet(*(self._path(s["name"]) for s in self.segments.current())))

    def of_imports(self, imports: DataFrame) -> DataFrame:
        """``imports`` (id) with ``SUMS``, 0 where an import has no chunks, and chunks_progress."""
        sums = self.read(imports.sparkSession)
        out = imports.join(sums, imports.id == sums.bulk_import_id, "left").drop("bulk_import_id")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in SUMS})
        return out.withColumn("chunks_progress", F.concat_ws(" of ", F.col("chunks_finished").cast("string"), F.col("chunks_total").cast("string")))


def counts_stream(changes: DataFrame, kept: KeptCounts, checkpoint: str) -> StreamingQuery:
    """Keeps the table up with a stream of chunk states; see ``differences``."""
    return differences(changes).writeStream.foreachBatch(kept.add).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
