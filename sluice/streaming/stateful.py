"""Status changes and the completion barrier as keyed state, whatever order things arrive in.

Both keep their state by bucket of keys with ``transformWithStateInPandas`` (the state store is RocksDB): it
is on disk, saved with each batch, and a restart goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from sluice.functions.status import IMPORT_MOVES
from sluice.streaming.barrier import STATE, Imports, chunk_rows
from sluice.streaming.buckets import BUCKETS, bucket_of, numbered, packed, unpacked, widened

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def with_keyed_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs; streams that start later have it."""
    for k, v in STORE.items():
        spark.conf.set(k, v)


#: A key: the status that its settled changes led to, and how many rows it has had.
SETTLED = pa.schema([("key", pa.string()), ("status", pa.string()), ("version", pa.int64())])
#: A change that the watermark hasn't passed: the place of its key among the settled ones, time, tie, and status it leads to.
EARLY = pa.schema([("of", pa.int64()), ("at", pa.int64()), ("tie", pa.int64()), ("to", pa.string())])


class Changes(StatefulProcessor):
    """Folds the changes of keys in the order of their time, as far as the watermark has come, and beyond it provisionally.

    State, by bucket of keys: the status that settled changes led to, and the early ones, which the watermark hasn't passed. One
    timer per bucket, at its earliest change, settles all that the watermark has passed by then; what is settled is forgotten, so
    the state has no more changes than come within the watermark's delay.
    """

    def __init__(self, initial: str, moves: dict[str, tuple[str, ...]]) -> None:
        self.initial, self.moves = initial, moves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("changes", "settled binary, early binary, timer long")

    def _now(self) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        settled, early, timer = self.held.get() if self.held.exists() else (None, None, 0)
        return unpacked(SETTLED, settled), unpacked(EARLY, early), timer

    def _fold(self, status: np.ndarray, early: list[np.ndarray], which: np.ndarray) -> np.ndarray:
        """Where these changes lead each key to; they are in order."""
        now = status.copy()
        for k, to in zip(early[0][which].tolist(), early[3][which], strict=True):
            if now[k] in self.moves.get(to, ()):
                now[k] = to
        return now

    def _keep(self, settled: list[np.ndarray], early: list[np.ndarray], timer: int, passed: bool = False) -> None:
        """Puts the state back and sees to the timer; ``passed``: it has just gone off."""
        due = int(early[1].min()) // 1000 + 1 if len(early[1]) else 0
        if due != timer or passed:
            if timer and not passed:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.held.update((packed(SETTLED, *settled), packed(EARLY, *early), due))

    def _results(self, keys: np.ndarray, now: np.ndarray, early: list[np.ndarray], version: np.ndarray, which: np.ndarray) -> pd.DataFrame:
        open_ = np.bincount(early[0], minlength=len(keys)) > 0
        return pd.DataFrame({"key": pd.Series(keys[which], dtype=object), "status": now[which], "settled": ~open_[which], "version": version[which]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (keys, status, version), early, timer = self._now()
        new = pd.concat(list(rows), ignore_index=True)
        of, keys = numbered(keys, new["key"])
        n = len(keys)
        status, version = widened(status, n, self.initial), widened(version, n, 0)
        own = (of, new["at"].to_numpy().astype(np.int64), new["tie"].to_numpy().astype(np.int64), new["to"].to_numpy(dtype=object))
        early = [np.concatenate(x) for x in zip(early, own, strict=True)]
        order = np.lexsort((early[2], early[1], early[0]))
        early = [x[order] for x in early]
        met = np.zeros(n, dtype=bool)
        met[of] = True
        version = version + met
        self._keep([keys, status, version], early, timer)
        yield self._results(keys, self._fold(status, early, met[early[0]]), early, version, np.flatnonzero(met))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        (keys, status, version), early, timer = self._now()
        passed = early[1] // 1000 < timerValues.getCurrentWatermarkInMs()
        met = np.zeros(len(keys), dtype=bool)
        met[early[0][passed]] = True
        status, version = self._fold(status, early, passed), version + met
        early = [x[~passed] for x in early]
        self._keep([keys, status, version], early, timer, passed=expiredTimerInfo.getExpiryTimeInMs() == timer)
        if met.any():
            yield self._results(keys, self._fold(status, early, met[early[0]]), early, version, np.flatnonzero(met))

    def close(self) -> None:
        pass


def lifecycle_stream(
    changes: DataFrame, key: str, time: str, tie: str, to: str, delay: str, initial: str = "queued", moves: dict[str, tuple[str, ...]] = IMPORT_MOVES,
    buckets: int = BUCKETS,
) -> DataFrame:
    """key, status, settled, version: after each batch, the status that all changes seen so far lead to in the order of
    ``time`` and ``tie``; of a key the row with the highest version holds.

    Changes may be late by ``delay``; those that are later are dropped. A settled row can't be changed any more.
    """
    rows = changes.select(
        F.col(key).cast("string").alias("key"), F.col(time).alias("time"), F.unix_micros(F.col(time)).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(to).alias("to")
    ).withColumn("bucket", bucket_of(F.col("key"), buckets=buckets))
    out = StructType([StructField("key", StringType()), StructField("status", StringType()), StructField("settled", BooleanType()), StructField("version", LongType())])
    told = rows.withWatermark("time", delay).groupBy("bucket").transformWithStateInPandas(Changes(initial, moves), out, "Append", "EventTime")
    return told.select(F.col("key").cast(changes.schema[key].dataType).alias(key), "status", "settled", "version")


class Barrier(StatefulProcessor):
    """One request per import, once it is validating and all its chunks are finished, whichever comes first.

    State, by bucket of imports: each import's status and number of chunks, the sequences that are finished, and whether the request is out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("imports", STATE)

    def _imports(self) -> Imports:
        return Imports(self.held.get() if self.held.exists() else None)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        imports = self._imports()
        imports.begin(*(initialState[c] for c in ("key", "status", "total", "sent", "finished")))
        self.held.update(imports.state())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        imports = self._imports()
        found = [imports.add(frame, guarded=True) for frame in rows]
        self.held.update(imports.state())
        for keys, totals in found:
            if len(keys):
                yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "chunks": totals})

    def close(self) -> None:
        pass


def guarded_barrier(imports: DataFrame, chunks: DataFrame, state: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """bulk_import_id, chunks: a request for each import that is validating once all its chunks are finished.

    imports: a stream of id, status, total (how many chunks it has; may be null); chunks: a stream of bulk_import_id,
    sequence, status, total. state: where a new stream begins (bulk_import_id, status, total, finished: sequences, sent), null without one.
    """
    kind, bucket = chunks.schema["bulk_import_id"].dataType, bucket_of(F.col("key"), buckets=buckets)
    told = imports.select(
        F.col("id").cast(kind).cast("string").alias("key"), F.lit(True).alias("told"), "status", F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("total"), F.lit(0).cast("long").alias("sequence"), F.lit(False).alias("done")
    )
    rows = told.unionByName(chunk_rows(chunks)).withColumn("bucket", bucket)
    begin = None
    if state is not None:
        begun = state.select(F.col("bulk_import_id").cast(kind).cast("string").alias("key"), "status", F.col("total").cast("long").alias("total"), F.col("finished").cast("array<long>").alias("finished"), "sent")
        begin = begun.withColumn("bucket", bucket).groupBy("bucket")
    out = StructType([StructField("key", StringType()), StructField("chunks", LongType())])
    sent = rows.groupBy("bucket").transformWithStateInPandas(Barrier(), out, "Append", "None", begin)
    return sent.select(F.col("key").cast(kind).alias("bulk_import_id"), "chunks")
