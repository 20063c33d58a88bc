"""The completion barrier as a stateful stream: one request when an import's last chunk is finished."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.functions.status import CHUNK_TERMINAL
from sluice.streaming.buckets import BUCKETS, bucket_of, numbered, packed, unpacked, widened

#: An import: how far it has come, how many chunks it has (0: not known), whether its request is out.
KNOWN = pa.schema([("key", pa.string()), ("status", pa.string()), ("total", pa.int64()), ("sent", pa.bool_())])
#: A finished chunk of an import without a request: the import's place among the known ones, and the chunk's number.
FINISHED = pa.schema([("at", pa.int64()), ("sequence", pa.int64())])
STATE = "known binary, finished binary"

#: How far an import has come by its status.
ORDER = {"awaiting_upload": 0, "queued": 1, "parsing": 2, "validating": 3, "assembling": 4, "completed": 5, "completed_with_errors": 5, "failed": 5}


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunk states (bulk_import_id, sequence, status, total) as what ``Imports`` takes; a chunk without a number isn't counted."""
    done = F.coalesce(F.col("status").isin(*CHUNK_TERMINAL) & F.col("sequence").isNotNull(), F.lit(False))
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return chunks.select(
        F.col("bulk_import_id").cast("string").alias("key"), F.lit(False).alias("told"), F.lit(None).cast("string").alias("status"), whole("total"), whole("sequence"), done.alias("done")
    )


class Imports:
    """The imports of a bucket, from its state and back."""

    def __init__(self, state: tuple | None) -> None:
        known, finished = state or (None, None)
        self.keys, self.status, self.total, self.sent = unpacked(KNOWN, known)
        self.at, self.sequence = unpacked(FINISHED, finished)

    def state(self) -> tuple[bytes, bytes]:
        return packed(KNOWN, self.keys, self.status, self.total, self.sent), packed(FINISHED, self.at, self.sequence)

    def _meet(self, keys: pd.Series) -> np.ndarray:
        """Places of keys, new ones behind the others."""
        at, self.keys = numbered(self.keys, keys)
        n = len(self.keys)
        self.status, self.total, self.sent = (widened(x, n, fill) for x, fill in ((self.status, None), (self.total, 0), (self.sent, False)))
        return at

    def _finish(self, at: np.ndarray, sequence: np.ndarray) -> None:
        at, sequence = np.concatenate([self.at, at]), np.concatenate([self.sequence, sequence])
        order = np.lexsort((sequence, at))
        at, sequence = at[order], sequence[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (sequence[1:] != sequence[:-1])
        new &= ~self.sent[at]
        self.at, self.sequence = at[new], sequence[new]

    def begin(self, keys: pd.Series, status: pd.Series, total: pd.Series, sent: pd.Series, finished: pd.Series) -> None:
        """Imports that a new stream begins with."""
        at = self._meet(keys)
        self.status[at], self.total[at], self.sent[at] = [x if isinstance(x, str) else None for x in status], total.fillna(0).to_numpy(np.int64), sent.to_numpy(bool)
        own = [[] if x is None else [int(s) for s in x] for x in finished]
        self._finish(np.repeat(at, [len(x) for x in own]).astype(np.int64), np.array([s for x in own for s in x], np.int64))

    def add(self, rows: pd.DataFrame, guarded: bool) -> tuple[list, np.ndarray]:
        """Takes rows (see ``chunk_rows``; of imports, ``told`` and their status) in: keys and totals of imports that are ready now.

        guarded: an import has to be validating, too.
        """
        at = self._meet(rows["key"])
        told = rows["told"].to_numpy(bool)
        for i, now in zip(at[told].tolist(), rows["status"][told], strict=True):
            # a status that comes late doesn't take the import back
            if self.status[i] is None or ORDER.get(now, -1) >= ORDER.get(self.status[i], -1):
                self.status[i] = now if isinstance(now, str) else None
        np.maximum.at(self.total, at, rows["total"].to_numpy(np.int64))
        done = rows["done"].to_numpy(bool)
        self._finish(at[done], rows["sequence"].to_numpy(np.int64)[done])
        n = len(self.keys)
        ready = np.zeros(n, dtype=bool)
        ready[at] = True
        ready &= ~self.sent & (self.total > 0) & (np.bincount(self.at, minlength=n) >= self.total)
        if guarded:
            ready &= self.status == "validating"
        self.sent |= ready
        open_ = ~self.sent[self.at]
        self.at, self.sequence = self.at[open_], self.sequence[open_]
        return self.keys[ready].tolist(), self.total[ready]


def _finish(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    imports = Imports(state.get if state.exists else None)
    found = [imports.add(rows, guarded=False) for rows in batches]
    state.update(imports.state())
    for keys, totals in found:
        if len(keys):
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "chunks": totals})


def barrier_stream(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A row for each import of ``chunks`` (bulk_import_id, sequence, status, total) once all its chunks are terminal.

    The state holds chunk numbers of unfinished imports only, and one flag afterwards, by bucket of imports (see ``buckets``).
    """
    rows = chunk_rows(chunks).withColumn("bucket", bucket_of(F.col("key"), buckets=buckets))
    sent = rows.groupBy("bucket").applyInPandasWithState(_finish, "key string, chunks long", STATE, "append", GroupStateTimeout.NoTimeout)
    return sent.select(F.col("key").cast(chunks.schema["bulk_import_id"].dataType).alias("bulk_import_id"), "chunks")
