"""A store of the ids of handled messages, for replays that a watermark has long forgotten.

Ids lie in buckets by hash, a segment of files for each batch that brought some. Beside each bucket of a
segment stands a Bloom filter of its ids. A batch asks the filters first: only the files whose filter may
hold one of its ids are read, and an exact check follows, so a filter's false positive costs a read and
never a message. Ids that weren't there become the batch's own segment.

A batch that runs again replaces its own segment and looks at earlier ones only; so a crash neither
loses an id nor takes a batch for its own replay. Segments are merged once there are many.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.storage import through_table
from sluice.streaming.segments import Segments

BUCKETS = 256
#: Bits of a filter for each of its ids and how many of them an id sets: about one false positive in a hundred.
BITS, PROBES = 10, 7
#: Segments beyond which a batch merges them into one.
MOST_SEGMENTS = 16

ID_SCHEMA, FILTER_SCHEMA = "id string, h long", "bucket int, n long, bits binary"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits that each hash sets in a filter of so many."""
    a = hashes.astype(np.uint64)
    step = (a >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)


def filter_of(hashes: np.ndarray) -> bytes:
    """A Bloom filter of these hashes."""
    size = max(64, BITS * len(hashes))
    bits = np.zeros(size, dtype=bool)
    bits[_places(hashes, size).ravel()] = True
    return size.to_bytes(8, "little") + np.packbits(bits).tobytes()


def may_hold(found: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each of the hashes may be in a filter; none that is in it is ever missed."""
    size = int.from_bytes(found[:8], "little")
    at = _places(hashes, size)
    data = np.frombuffer(found, np.uint8, offset=8)
    return ((data[at >> 3] >> (7 - (at & 7))) & 1).astype(bool).all(axis=1)


def _filters(table: pa.Table) -> pa.Table:
    h = table.column("h").to_numpy()
    return pa.table({"bucket": table.column("bucket").slice(0, 1).combine_chunks(), "n": [len(h)], "bits": pa.array([filter_of(h)], pa.binary())})


def _asked(ids: pa.Table, filters: pa.Table) -> pa.Table:
    """The files that may hold an id of the batch: segment and bucket."""
    h = ids.column("h").to_numpy()
    hit = [(s, b) for s, b, f in zip(*(filters.column(c).to_pylist() for c in ("segment", "bucket", "bits")), strict=True) if len(h) and may_hold(f, h).any()]
    return pa.table([pa.array([x[0] for x in hit], pa.string()), pa.array([x[1] for x in hit], pa.int32())], names=["segment", "bucket"])


@dataclass(frozen=True)
class Checked:
    """new: the rows of a batch whose ids no earlier batch had, each id once; files, read: how many files the store has and how many of them were read."""

    new: DataFrame
    files: int
    read: int


class HandledIds:
    """The store at a folder; ``buckets`` is fixed when it is made."""

    def __init__(self, folder: str, buckets: int = BUCKETS, most_segments: int = MOST_SEGMENTS) -> None:
        self.folder, self.buckets, self.most_segments = folder.rstrip("/"), buckets, most_segments
        self.segments = Segments(self.folder, buckets=buckets)

    def _bucket(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.buckets)).cast("int")

    def _write(self, ids: DataFrame, name: str) -> None:
        """A segment: its ids by bucket, and their filters."""
        dealt = ids.withColumn("bucket", self._bucket(F.col("h"))).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/ids/segment={name}")
        stored = ids.sparkSession.read.schema(f"{ID_SCHEMA}, bucket int").parquet(f"{self.folder}/ids/segment={name}")
        stored.select("bucket", "h").groupBy("bucket").applyInArrow(_filters, FILTER_SCHEMA).write.mode("overwrite").parquet(f"{self.folder}/filters/segment={name}")

    def _read(self, spark: SparkSession, what: str, schema: str, segments: list[dict]) -> DataFrame:
        base = f"{self.folder}/{what}"
        return spark.read.schema(f"{schema}, segment string").option("basePath", base).parquet(*(f"{base}/segment={s['name']}" for s in segments))

    def check(self, batch: DataFrame, batch_id: int, id_: str) -> Checked:
        """Splits a batch by what earlier batches had, and keeps its new ids. Rows without an id are new every one."""
        spark = batch.sparkSession
        rows = batch.withColumn("_h", F.xxhash64(F.col(id_).cast("string")))
        named = rows.where(F.col(id_).isNotNull())
        first = named.groupBy(F.col(id_).cast("string").alias("_id")).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("_row"))
        first = through_table(first)
        ids = first.select(F.col("_id").alias("id"), F.col("_row._h").alias("h"))
        earlier = [s for s in self.segments.current() if s["upto"] < batch_id]
        again, files, read = None, 0, 0
        if earlier:
            filters = self._read(spark, "filters", FILTER_SCHEMA, earlier)
            files = filters.count()
            keyed = ids.withColumn("bucket", self._bucket(F.col("h")))
            asked = through_table(keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_asked, "segment string, bucket int"))
            # at most a file per bucket and segment, both of which are bounded
            parts = [(r["segment"], r["bucket"]) for r in asked.collect()]
            read = len(parts)
            if parts:
                stored = self._read(spark, "ids", f"{ID_SCHEMA}, bucket int", earlier)
                by_segment: dict[str, list[int]] = {}
                for segment, bucket in parts:
                    by_segment.setdefault(segment, []).append(bucket)
                wanted = F.lit(False)
                for segment, own in by_segment.items():
                    wanted = wanted | ((F.col("segment") == segment) & F.col("bucket").isin(*own))
                again = ids.join(stored.where(wanted).select("id", "h"), ["id", "h"], "left_semi").select(F.col("id").alias("_id"))
        new = first if again is None else first.join(again, "_id", "left_anti")
        new = through_table(new)
        name = f"batch-{batch_id}"
        self._write(new.select(F.col("_id").alias("id"), F.col("_row._h").alias("h")), name)
        self.segments.commit([*earlier, {"name": name, "upto": batch_id}])
        if len(earlier) >= self.most_segments:
            self.compact(spark)
        out = new.select("_row.*").drop("_h")
        return Checked(out.unionByName(rows.where(F.col(id_).isNull()).drop("_h")), files, read)

    def compact(self, spark: SparkSession) -> None:
        """Merges all segments but the last one, whose batch may run again, into one."""
        segments = self.segments.current()
        old, last = segments[:-1], segments[-1:]
        if len(old) < 2:
            return
        name = f"merged-{uuid.uuid4().hex}"
        self._write(self._read(spark, "ids", f"{ID_SCHEMA}, bucket int", old).select("id", "h"), name)
        self.segments.commit([{"name": name, "upto": old[-1]["upto"]}, *last])

    def ids(self, spark: SparkSession) -> DataFrame:
        """All ids that are kept."""
        segments = self.segments.current()
        return self._read(spark, "ids", f"{ID_SCHEMA}, bucket int", segments).select("id") if segments else spark.createDataFrame([], "id string")


def once_stream(messages: DataFrame, ids: HandledIds, handle: Callable[[DataFrame, int], None], checkpoint: str, id_: str = "message_id") -> StreamingQuery:
    """Gives ``handle`` each batch without the messages whose id an earlier batch had, however long ago.

    A batch that runs again after a crash is given the same messages: its own segment doesn't count for it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        handle(ids.check(batch, batch_id, id_).new, batch_id)

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
