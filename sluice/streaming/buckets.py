"""Keyed state by the bucket: what a Python state function is called for is a hash bucket of keys, not a key.

A call and its reads and writes of state cost about a millisecond, however little there is to do. So the
state of all keys of a bucket is one table, packed as Arrow's stream format, and a call takes the rows of all of
them at once. Keys travel as text. A batch rewrites the buckets that its rows fall into, and no others; the number
of buckets belongs to a checkpoint and can't be changed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1024


def bucket_of(*keys: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def packed(schema: pa.Schema, *columns: Iterable) -> bytes:
    """Columns as the bytes that a state holds."""
    table = pa.table([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema, strict=True)], schema=schema)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(schema: pa.Schema, data: bytes | None) -> list[np.ndarray]:
    """The columns of a state; without rows where there is none yet. Text is an array of objects."""
    table = schema.empty_table() if data is None else pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()
    text = lambda c: np.array([*c.to_pylist(), None], dtype=object)[:-1]
    return [text(c) if pa.types.is_string(c.type) else c.to_numpy() for c in table.columns]


def numbered(known: np.ndarray, new: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys ``new`` and all keys by place; ``known`` ones, all different, keep theirs. A null key is one, too."""
    both = np.concatenate([known, np.asarray(new, dtype=object)])
    codes, keys = pd.factorize(both, use_na_sentinel=False)
    keys[pd.isna(keys)] = None
    return codes[len(known) :], keys


def widened(values: np.ndarray, n: int, fill: object) -> np.ndarray:
    """``values``, with ``fill`` up to n of them."""
    out = np.full(n, fill, dtype=values.dtype)
    out[: len(values)] = values
    return out
