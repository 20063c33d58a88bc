"""Delimited files as ragged records, read in splits.

A tokenizer of cells is in one of four states: at a cell's start (blanks may have gone by), in a
bare cell, in quotes, or just behind a quote. Only a quote at a cell's start opens quotes;
elsewhere it is a letter like any other, and what follows closing quotes belongs to the cell.
Behind a line end the state is either a cell's start or in quotes, so what a line does is
a map from these two to these two, and maps of lines, of splits and of files compose. A line's
map comes from two patterns, in the JVM.

Two passes over the files. The first one reduces each split to its map, with how many records begin in
it for either state before it; a running composition over the few rows of a file says how
each split is entered and how many records begin before it. In the second one a task enters its
split in that state and puts records together from its own lines. Only a record that goes over
the end of a split travels, as one part per split; no other line is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.cells import BODY, LEAD, is_blank, split_cells
from sluice.storage import shared_tasks, short_listing, through_table

#: What a line does to the two states: exit from a closed one (bit 0) and from quotes (bit 1), set where quotes are open.
SHUT, SWAP, KEEP, OPEN = range(4)

_CELL = f'(?:{LEAD}"{BODY}"[^,]*+|(?!{LEAD}")[^,]*+)'
_OPENED = f'{LEAD}"{BODY}\\z'
FROM_CLOSED = f"^(?:{_CELL},)*+{_OPENED}"
FROM_QUOTED = f'^{BODY}(?:"[^,]*+,(?:{_CELL},)*+{_OPENED})?+\\z'

#: Splits whose facts are broadcast, some 60 bytes each; facts of more are joined by a shuffle of lines.
BROADCAST_SPLITS = 1 << 20

SPLIT_SCHEMA = "file long, block long, from_closed byte, from_quoted byte, starts_closed long, starts_quoted long, n_bytes long"
#: Columns of a record.
RECORD = ("path", "record_no", "n_bytes", "raw", "cells")

PART_SCHEMA = "path string, block long, record_no long, n_bytes long, part binary, whole boolean, unclosed boolean"


def text_lines(spark: SparkSession, paths: str | list[str], wanted: Column | None = None) -> DataFrame:
    """path, block, line (rising inside a block), value, file_bytes of every line of the files; ``wanted``: a condition on ``_metadata`` that files are picked by."""
    with short_listing(spark):
        lines = spark.read.option("lineSep", "\n").text(paths, recursiveFileLookup=True)
    lines = lines if wanted is None else lines.where(wanted)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        "value", F.col("_metadata.file_size").alias("file_bytes"),
    )


def line_map(line: Column) -> Column:
    """What the line does to the tokenizer's state; see ``SHUT`` to ``OPEN``."""
    opens = lambda pattern: line.rlike(pattern).cast("byte")
    return F.when(~F.contains(line, F.lit('"')), F.lit(KEEP)).otherwise(opens(FROM_CLOSED) + 2 * opens(FROM_QUOTED)).cast("byte")


def states(maps: np.ndarray, entered: bool) -> tuple[np.ndarray, bool]:
    """Whether quotes are open before each line, and after the last one."""
    if not len(maps):
        return np.zeros(0, dtype=bool), entered
    fixed = (maps == SHUT) | (maps == OPEN)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(maps)), -1))
    swaps = np.cumsum(maps == SWAP)
    known = np.where(last >= 0, maps[last] == OPEN, entered)
    after = known ^ ((swaps - np.where(last >= 0, swaps[last], 0)) % 2 == 1)
    return np.concatenate([[entered], after[:-1]]), bool(after[-1])


def _stretches(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, int, int]]:
    """Runs of rows with equal values of these columns: the values, first, last + 1."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for c in columns:
        values = c.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(new).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield tuple(c[a].as_py() for c in columns), a, b


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: where either state leads, how many records begin, how many bytes it has."""
    now, open_, starts, size = None, [False, True], [0, 0], 0
    names = [x.split()[0] for x in SPLIT_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.int64(), pa.int64(), pa.int64()]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, int(open_[0]), int(open_[1]), *starts, size), kinds, strict=True)], names=names)

    for batch in batches:
        maps, sizes = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("map", "size"))
        for key, a, b in _stretches(batch, "file", "block"):
            if key != now:
                if now is not None:
                    yield row()
                now, open_, starts, size = key, [False, True], [0, 0], 0
            for k in (0, 1):
                before, open_[k] = states(maps[a:b], open_[k])
                starts[k] += int((~before).sum())
            size += int(sizes[a:b].sum())
    if now is not None:
        yield row()


def split_entries(lines: DataFrame) -> DataFrame:
    """file, block, entered (quotes are open before the split), done (records that begin before it), and tail:
    of a file that ends in open quotes, whether a line end stands last; null elsewhere. lines: see ``text_lines``, with ``file``."""
    narrow = lines.select("file", "block", line_map(F.col("value")).alias("map"), (F.octet_length("value") + 1).cast("long").alias("size"))
    splits = through_table(narrow.mapInArrow(_split_maps, SPLIT_SCHEMA))
    per = Window.partitionBy("file").orderBy("block")
    before = per.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("from_closed") == F.col("from_quoted"), F.col("from_closed"))
    splits = splits.withColumn("fixed", fixed).withColumn("swaps", F.sum(F.when(F.col("from_closed") > F.col("from_quoted"), 1).otherwise(0)).over(per.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps")), ignorenulls=True).over(before)
    swapped = F.coalesce(F.lag("swaps").over(per), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    splits = splits.withColumn("entered", (F.coalesce(last["fixed"], F.lit(0)) + swapped) % 2 == 1)
    starts = F.when(F.col("entered"), F.col("starts_quoted")).otherwise(F.col("starts_closed"))
    left_open = F.when(F.col("entered"), F.col("from_quoted")).otherwise(F.col("from_closed")) == 1
    is_last = F.lead("block").over(per).isNull()
    return splits.select(
        "file", "block", "entered", F.coalesce(F.sum(starts).over(before), F.lit(0)).alias("done"),
        F.when(is_last & left_open, F.sum("n_bytes").over(Window.partitionBy("file"))).alias("bytes_if_ended"),
    )


def _joined(data: np.ndarray, bounds: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a line end after each that isn't the last one of its record, and where each line begins."""
    more = ~last
    at = bounds[:-1] + np.concatenate([[0], np.cumsum(more)[:-1]])
    out = np.full(len(data) + int(more.sum()), 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(at - bounds[:-1], np.diff(bounds))] = data
    return out, at


def _bytes_of(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    part = column.slice(a, b - a)
    wide = pa.types.is_large_binary(part.type)
    _, offsets, data = part.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _records(most: int):
    """Records of a split, and parts of those that it has not the whole of; text beyond ``most`` bytes is left out."""
    names = [x.split()[0] for x in PART_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, open_, number, tail = None, None, False, 0, None
        held: list[bytes] | None = None  # of the record that the next lines may belong to
        size, begun = 0, False

        def add(text: bytes, n: int) -> None:
            nonlocal held, size
            size += n
            held = [*held, text] if size <= most else []

        def ready(whole: bool, end: bytes | None) -> pa.RecordBatch:
            text = b"\n".join(held) + (end or b"") if size <= most else None
            row = (path, now[1], number, size, text, whole and begun, end is not None)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        def left() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield ready(not open_, tail)

        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            maps = column("map").to_numpy()
            for key, a, b in _stretches(batch, "file", "block"):
                if key != now:
                    yield from left()
                    now, path, open_, number = key, column("path")[a].as_py(), column("entered")[a].as_py(), column("done")[a].as_py()
                    tail = {None: None, True: b"\n", False: b""}[column("tail")[a].as_py()]
                    held, size, begun = ([], 0, False) if open_ else (None, 0, False)
                before, open_ = states(maps[a:b], open_)
                starts = np.flatnonzero(~before)
                data, bounds = _bytes_of(column("value"), a, b)
                first = int(starts[0]) if len(starts) else b - a
                if first:
                    text, _ = _joined(data[: bounds[first]], bounds[: first + 1], np.arange(first) == first - 1)
                    add(text.tobytes(), len(text) + 1)
                if not len(starts):
                    continue
                if held is not None:
                    yield ready(True, None)
                if len(starts) > 1:
                    to = int(starts[-1])
                    last = np.zeros(to - first, dtype=bool)
                    last[starts[1:] - 1 - first] = True
                    text, at = _joined(data[bounds[first] : bounds[to]], bounds[first : to + 1] - bounds[first], last)
                    ends = np.append(at[starts[:-1] - first], len(text))
                    n = len(starts) - 1
                    parts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                    sizes = np.diff(ends) + 1
                    if (sizes > most).any():
                        parts = pa.array([p if s <= most else None for p, s in zip(parts.to_pylist(), sizes.tolist(), strict=True)], pa.binary())
                    flags = [pa.array(np.full(n, x)) for x in (True, False)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, now[1])), pa.array(np.arange(number + 1, number + n + 1)), pa.array(sizes), parts, *flags], names=names)
                number += len(starts)
                held, size, begun = [], 0, True
                rest = slice(int(starts[-1]), b - a)
                text, _ = _joined(data[bounds[rest.start] :], bounds[rest.start :] - bounds[rest.start], np.arange(rest.stop - rest.start) == rest.stop - rest.start - 1)
                add(text.tobytes(), len(text) + 1)
        yield from left()

    return run


def record_parts(lines: DataFrame, entries: DataFrame, record_bytes: int) -> DataFrame:
    """Records that their split has the whole of, and parts of the others; see ``PART_SCHEMA``. lines: see ``text_lines``, with ``file``."""
    lines = lines.withColumns({"map": line_map(F.col("value")), "value": F.col("value").cast("binary")})
    if entries.count() <= BROADCAST_SPLITS:
        placed = lines.join(F.broadcast(entries), ["file", "block"])
    else:
        placed = lines.join(entries, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "line")
    # bytes counted with a line end each, against the file's own: one less where the last line has none; Spark leaves a byte order mark of three out
    tail = F.when(F.col("bytes_if_ended").isNotNull(), (F.col("file_bytes") - F.col("bytes_if_ended")).isin(0, 3))
    return placed.select("file", "path", "block", "map", "value", "entered", "done", tail.alias("tail")).mapInArrow(_records(record_bytes), PART_SCHEMA)


def csv_records(
    spark: SparkSession, paths: str | list[str], record_bytes: int = 1 << 31, wanted: Column | None = None, columns: Sequence[str | Column] = RECORD,
) -> DataFrame:
    """path, record_no (the header is 1, blank ones count), n_bytes, raw, cells; a written table. wanted: see ``text_lines``.

    ``columns``: some of these or expressions on them; nothing else of a record is written but where it goes over the end of a split.
    A record of more than ``record_bytes`` (a quote that is never closed takes the rest of
    its file) has its number and size, but neither text nor cells: it is never put together.
    The text of a file's last record, if its quotes are still open, keeps the file's last line end.
    """
    lines = text_lines(spark, paths, wanted).withColumn("file", F.xxhash64("path"))
    # the line end may be \r\n; inside quotes it stays as it is
    text = lambda c: F.when(F.col("unclosed"), c.cast("string")).otherwise(F.regexp_replace(c.cast("string"), "\r\\z", ""))
    only = lambda c: F.when(~F.col("whole"), F.col(c)).alias(c)
    with shared_tasks(spark):  # both passes see the same splits
        parts = record_parts(lines, through_table(split_entries(lines)), record_bytes)
        parts = parts.withColumn("raw", F.when(F.col("whole"), text(F.col("part")))).withColumn("cells", split_cells(F.col("raw")))
        parts = parts.select("whole", F.when(F.col("whole"), F.struct(*columns)).alias("record"), *map(only, ("path", "block", "record_no", "n_bytes", "part", "unclosed")))
        parts = through_table(parts, small=True)
    whole = parts.where("whole").select("record.*")
    split = parts.where("not whole").groupBy("path", "record_no").agg(
        F.sum("n_bytes").alias("n_bytes"), F.max("unclosed").alias("unclosed"), F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("block", "part")))).alias("parts"), F.count("*").alias("n")
    )
    fits = (F.col("n_bytes") <= record_bytes) & (F.size("parts") == F.col("n"))
    joined = F.aggregate("parts", F.lit(None).cast("binary"), lambda out, p: F.when(out.isNull(), p["part"]).otherwise(F.concat(out, F.lit(b"\n"), p["part"])))
    split = split.withColumn("raw", F.when(fits, text(joined))).withColumn("cells", split_cells(F.col("raw"))).select(*columns)
    return whole.unionByName(split)


def without_blanks(records: DataFrame) -> DataFrame:
    """Records with a cell that isn't blank."""
    return records.where(~is_blank(F.col("cells")))
