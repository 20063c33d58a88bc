"""Where chunks begin, by jump pointers over ordered ranges.

A range of rows knows, for each of its rows as a chunk's first, where the next chunk begins: the first row
at which the count or the running sum of bytes is reached, found by a search in prefix sums. Following
such pointers to the range's end, for all rows at once by doubling, says what each of them leads
to: how many chunks begin and how many rows and bytes the last, open one has. A range is entered with
an open chunk of some rows and bytes; its first pointer then follows from the same sums. So
a range condenses to a map from what enters to what leaves, of at most ``chunk_rows``
places, and the maps of neighbours compose to one of the same form.

Ranges are mapped side by side; maps are composed in groups of ``FAN``, level by level, until a scope has
no more groups than that; what enters then goes down the levels again, and
each range numbers its own rows. A task holds one range, or ``FAN`` maps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from sluice.storage import through_table

#: Rows of a range, and maps that are composed in one go.
RANGE_ROWS, FAN = 1 << 18, 64

MAP = "range long, n long, sums binary, rows binary, bytes binary, starts binary"
ENTRY = "range long, rows long, bytes long, starts long"


@dataclass
class Piece:
    """What a stretch of n rows does to an open chunk.

    sums[e]: bytes of its first e rows; rows[e], bytes[e], starts[e]: what leaves if a chunk begins at row e: rows and
    bytes of the open chunk (0 rows: none is open) and how many chunks began. e goes from 0 to min(n, most rows of a chunk).
    """

    n: int
    sums: np.ndarray
    rows: np.ndarray
    bytes: np.ndarray
    starts: np.ndarray

    def leave(self, rows: np.ndarray, size: np.ndarray, starts: np.ndarray, limits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What leaves for each of many states that enter."""
        at = first_start(self.sums, rows, size, limits)
        over = at >= len(self.sums)  # the open chunk goes on behind the stretch
        to = np.minimum(at, len(self.sums) - 1)
        return (
            np.where(over, rows + self.n, self.rows[to]), np.where(over, size + self.sums[-1], self.bytes[to]), starts + np.where(over, 0, self.starts[to])
        )

    def then(self, after: Piece, limits: tuple[int, int]) -> Piece:
        """This stretch and the one behind it as one."""
        rows, size, starts = after.leave(self.rows, self.bytes, self.starts, limits)
        sums = self.sums
        if len(sums) == self.n + 1:  # a chunk that is open before may begin anew as late as in the second one
            more = min(limits[0], self.n + after.n) - self.n
            sums = np.concatenate([sums, sums[-1] + after.sums[1 : more + 1]])
            rows, size, starts = (np.concatenate([x, y[1 : more + 1]]) for x, y in ((rows, after.rows), (size, after.bytes), (starts, after.starts)))
        return Piece(self.n + after.n, sums, rows, size, starts)


def first_start(sums: np.ndarray, rows: np.ndarray, size: np.ndarray, limits: tuple[int, int]) -> np.ndarray:
    """The row at which a chunk begins after an open one of so many rows and bytes; beyond ``sums`` if none does."""
    full = np.minimum(limits[0] - rows, np.maximum(1, np.searchsorted(sums, limits[1] - size, side="left")))
    return np.where(rows == 0, 0, full)


def pointers(sums: np.ndarray, heads: np.ndarray, limits: tuple[int, int]) -> np.ndarray:
    """For each row as a chunk's first, the row behind its last one; len(heads) + 1 if it isn't closed among these rows."""
    at, n = np.arange(len(heads)), len(heads)
    filled = np.searchsorted(sums, sums[:-1] + (limits[1] - heads), side="left")
    closed = np.minimum(at + limits[0], np.maximum(at + 1, filled))
    return np.minimum(closed, n + 1)


def piece_of(sizes: np.ndarray, heads: np.ndarray, limits: tuple[int, int]) -> Piece:
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    to = pointers(sums, heads, limits)
    # open chunks and the end lead to themselves
    to = np.append(np.where(to > n, np.arange(n), to), n)
    began = (to != np.arange(n + 1)).astype(np.int64)
    while True:
        further = to[to]
        if (further == to).all():
            break
        began, to = began + began[to], further
    began += to < n
    most = min(n, limits[0])
    end = to[: most + 1]
    size = np.where(end < n, np.append(heads, 0)[end] + sums[-1] - sums[end], 0)
    return Piece(n, sums[: most + 1], n - end, size, began[: most + 1])


def numbered(sizes: np.ndarray, heads: np.ndarray, entry: tuple[int, int, int], limits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """chunk_seq and row_in_chunk of rows that are entered with (rows, bytes, starts)."""
    n, (rows, size, starts) = len(sizes), entry
    sums = np.concatenate([[0], np.cumsum(sizes)])
    to = pointers(sums, heads, limits).tolist()
    at = int(first_start(sums, np.array([rows]), np.array([size]), limits)[0])
    begins = []
    while at < n:
        begins.append(at)
        at = to[at]
    flag = np.zeros(n, np.int64)
    flag[begins] = 1
    seq = starts + np.cumsum(flag)
    edges = np.array([-rows, *begins], np.int64)  # the open chunk began before
    return seq, np.arange(n) - edges[np.cumsum(flag)] + 1


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _scopes(table: pa.Table) -> list[tuple[int, int]]:
    """First and last + 1 of each scope's rows; the table is sorted by scope."""
    s = table.column("s").combine_chunks()
    new = np.ones(len(s), dtype=bool)
    if len(s) > 1:
        a, b = s.slice(1), s.slice(0, len(s) - 1)
        same = pc.equal(a, b).fill_null(False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
        new[1:] = ~same
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], len(s)], strict=True))


ORDER = [("s", "ascending"), ("o", "ascending"), ("n", "ascending"), ("head", "ascending")]


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=ORDER, null_placement="at_start"))


def _maps(limits: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        table, out = _sorted(table), []
        range_ = table.column("range")[0].as_py()
        spans = _scopes(table)
        for a, b in spans:
            p = piece_of(_column(table, "n")[a:b], _column(table, "head")[a:b], limits)
            out.append([table.column("s")[a].as_py(), range_, p.n, *(x.astype(np.int64).tobytes() for x in (p.sums, p.rows, p.bytes, p.starts))])
        kinds = [table.schema.field("s").type, pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["s", *(x.split()[0] for x in MAP.split(", "))])

    return run


def _pieces(table: pa.Table) -> list[tuple[int, Piece]]:
    """The maps of one scope in order, with their ranges."""
    rows = sorted(table.select(["range", "n", "sums", "rows", "bytes", "starts"]).to_pylist(), key=lambda r: r["range"])
    return [(r["range"], Piece(r["n"], *(np.frombuffer(r[c], np.int64) for c in ("sums", "rows", "bytes", "starts")))) for r in rows]


def _composed(limits: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        pieces = _pieces(table)
        whole = pieces[0][1]
        for _, p in pieces[1:]:
            whole = whole.then(p, limits)
        group = pieces[0][0] // FAN
        columns = [table.column("s").slice(0, 1).combine_chunks(), pa.array([group]), pa.array([whole.n]), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (whole.sums, whole.rows, whole.bytes, whole.starts))]
        return pa.table(columns, names=["s", *(x.split()[0] for x in MAP.split(", "))])

    return run


def _entries(limits: tuple[int, int]):
    def run(maps: pa.Table, above: pa.Table) -> pa.Table:
        """What enters each map of a group, from what enters the group (nothing: no chunk is open)."""
        state = tuple(np.array([above.column(c)[0].as_py() if above.num_rows else 0]) for c in ("rows", "bytes", "starts"))
        out = []
        for range_, piece in _pieces(maps):
            out.append((range_, *(int(x[0]) for x in state)))
            state = piece.leave(*state, limits)
        s = maps.column("s")[0].as_py()
        columns = [pa.array([s] * len(out), maps.schema.field("s").type), *(pa.array(list(x)) for x in zip(*out, strict=True))]
        return pa.table(columns, names=["s", *(x.split()[0] for x in ENTRY.split(", "))])

    return run


def _places(limits: tuple[int, int]):
    def run(table: pa.Table, entries: pa.Table | None = None) -> pa.Table:
        """The places of a range's rows; no chunk is open before a range that is alone."""
        table = _sorted(table)
        of = {} if entries is None else {r["s"]: (r["rows"], r["bytes"], r["starts"]) for r in entries.to_pylist()}
        seqs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _scopes(table):
            seq, place = numbered(_column(table, "n")[a:b], _column(table, "head")[a:b], of[table.column("s")[a].as_py()] if of else (0, 0, 0), limits)
            seqs.append(seq)
            places.append(place)
        # the how many-th of wholly equal rows each one is
        keys = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c, _ in ORDER]
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        at = np.arange(table.num_rows)
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        columns = [*(table.column(c) for c, _ in ORDER), pa.array(nth), pa.array(np.concatenate(seqs).astype(np.int32)), pa.array(np.concatenate(places))]
        return pa.table(columns, names=[*(c for c, _ in ORDER), "nth", "chunk_seq", "row_in_chunk"])

    return run


def places(narrow: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """s, o, n, head, nth, chunk_seq, row_in_chunk of rows (s, o, n, head): scope, order, bytes, and bytes that a chunk they begin has besides."""
    rows = narrow.count()
    limits = (min(chunk_rows, rows + 1), min(chunk_bytes, 1 << 62))
    found = [*(narrow.schema[c] for c, _ in ORDER), StructField("nth", LongType()), StructField("chunk_seq", IntegerType()), StructField("row_in_chunk", LongType())]
    if rows <= RANGE_ROWS:
        whole = narrow.withColumn("range", F.lit(0)).groupBy("range").applyInArrow(lambda table: _places(limits)(table), StructType(found))
        return through_table(whole)
    ranges = max(int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS + 1)
    dealt = narrow.repartitionByRange(ranges, *(c for c, _ in ORDER)).withColumn("range", F.spark_partition_id().cast("long"))
    dealt = through_table(dealt)
    scope = dealt.schema["s"]
    kinds = lambda text: StructType([scope, *(StructField(x.split()[0], LongType()) if x.endswith("long") else StructField(x.split()[0], BinaryType()) for x in text.split(", "))])
    levels = [through_table(dealt.groupBy("range").applyInArrow(_maps(limits), kinds(MAP)))]
    groups = ranges
    while groups > FAN:
        groups = -(-groups // FAN)
        levels.append(through_table(levels[-1].groupBy("s", F.expr(f"range div {FAN}").alias("g")).applyInArrow(_composed(limits), kinds(MAP))))
    entries = dealt.sparkSession.createDataFrame([], kinds(ENTRY))
    for maps in reversed(levels):
        up = maps.withColumn("g", F.expr(f"range div {FAN}"))
        top = entries.withColumnRenamed("range", "g")
        entries = through_table(up.groupBy("s", "g").cogroup(top.groupBy("s", "g")).applyInArrow(_entries(limits), kinds(ENTRY)))
    return through_table(dealt.groupBy("range").cogroup(entries.groupBy("range")).applyInArrow(_places(limits), StructType(found)))
