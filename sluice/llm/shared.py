"""What the operators share: written tables, texts as byte arrays, word and shingle hashes.

Texts reach numpy as one flat byte buffer with document offsets. Everything below
is computed for a whole block of documents at once, so the cost per word is some
nanoseconds and a Python object per word never exists.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sluice.storage import no_leftovers, through_table, work_folder

#: Bytes of text that are hashed at once; bounds the size of every intermediate array.
BLOCK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SHINGLE_FACTORS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(SHINGLE_WORDS)], dtype=_U)

#: Space and U+0009 to U+000D, as flags by byte value.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Each byte with A-Z mapped to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a temporary one in local mode; an error on a cluster."""
    return work_folder(spark).rpartition("/")[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks it was running, and
    later branches read just the columns they need. The shuffle files of the write
    are of no use after it and go at its end.
    """
    return through_table(df, name)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` written in buckets of ``key`` and read back: joins on the key of two such tables move no row.

    Tasks write the buckets they have rows of, so writing moves none either.
    """
    spark = df.sparkSession
    path, table = work_folder(spark), f"sluice_{uuid.uuid4().hex}"
    with no_leftovers(spark):
        df.write.bucketBy(buckets, key).option("path", f"{path}/buckets").format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.schema  # the table's files and buckets are known from here on; its name is of no more use
    spark.sql(f"DROP TABLE {table}")
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(data: np.ndarray, bounds: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes: first, last + 1, bytes, offsets."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


class _Powers:
    """Powers of the hash base and of its inverse, as many as the longest block needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                x = np.full(n, base, dtype=_U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=_U))


_POWERS = _Powers()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes give equal hashes."""
    _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1 + salt)) * _POWERS.up[: len(data)], out=total[1:])
    value = (total[end] - total[start]) * _POWERS.down[start]
    return mix(value + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


@dataclass
class Words:
    """The words of a block: byte spans, hashes, and where each document's words begin."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # by document, n + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each document, as they stand in ``data``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, _U), np.zeros(len(bounds), np.int64))
    solid = ~WHITE[data]
    edge = np.ones(len(data) + 1, dtype=bool)  # a document begins here, or white space stands before
    edge[1:] = ~solid
    edge[bounds] = True
    start = np.flatnonzero(solid & edge[:-1])
    after = np.ones(len(data) + 1, dtype=bool)
    after[:-1] = ~solid
    after[bounds] = True
    end = np.flatnonzero(solid & after[1:]) + 1
    return Words(start, end, span_hashes(data, start, end), np.searchsorted(start, bounds))


def shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word windows in order, and their n + 1 bounds by document.

    A document of one to four words gives one hash, of its whole sequence.
    """
    counts = words.counts
    n = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    out = np.zeros(bounds[-1], dtype=_U)
    h = words.hashes
    if len(h) >= SHINGLE_WORDS:
        m = len(h) - SHINGLE_WORDS + 1
        value = np.zeros(m, dtype=_U)
        for k, factor in enumerate(_SHINGLE_FACTORS):
            value += h[k : k + m] * factor
        value = mix(value)
        left = np.repeat(words.bounds[1:], counts) - np.arange(len(h))
        out[np.repeat(counts >= SHINGLE_WORDS, n)] = value[left[:m] >= SHINGLE_WORDS]
    for d in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):
        value = np.full(1, counts[d], dtype=_U)
        for k in range(words.bounds[d], words.bounds[d + 1]):
            value = mix((value ^ h[k : k + 1]) * _U(_BASE))
        out[bounds[d]] = value[0]
    return out, bounds


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, ascending, and their bounds."""
    all_, bounds = shingle_hashes(words)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        all_[a:b].sort()
    keep = np.ones(len(all_), dtype=bool)
    keep[1:] = all_[1:] != all_[:-1]
    keep[bounds[:-1][bounds[:-1] < len(all_)]] = True
    total = np.zeros(len(all_) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return all_[keep], total[bounds]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bounds(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
            last = min(batch.num_rows, max(first + 1, last))
            yield batch.slice(first, last - first)
            first = last
