"""CSV outputs of an import: chunks, rejected rows, results.

Outputs are lines (key, chunk_seq, row_in_chunk, record), the header as the line before
all others, and ``write_files`` makes one file of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.cells import chunk_key, error_key, join_cells, output_key
from sluice.functions.rules import error_text
from sluice.sources.keyed_files import remove_others, write_keyed

#: Columns that an error file has before and after those of the rows; fixed values.
ERROR_COLUMNS = ("Chunk", "Row in chunk", "Errors")


def _lines(rows: DataFrame, key: Column, header: Column, cells: Column, keys: DataFrame | None = None) -> DataFrame:
    """A line per row and, for each key of ``keys`` (import_id, source_object_key, header and chunk_seq; the rows if None), a header."""
    tops = (rows if keys is None else keys).select(key.alias("key"), F.lit(0).alias("chunk_seq"), F.lit(0).cast("long").alias("row_in_chunk"), join_cells(header).alias("record"))
    return tops.dropDuplicates(["key"]).unionByName(rows.select(key.alias("key"), "chunk_seq", "row_in_chunk", join_cells(cells).alias("record")))


def _error_header() -> Column:
    chunk, row, errors = (F.array(F.lit(c)) for c in ERROR_COLUMNS)
    return F.concat(chunk, row, F.col("header"), errors)


def _error_cells() -> Column:
    return F.concat(F.array(F.col("chunk_seq").cast("string"), F.col("row_in_chunk").cast("string")), F.col("cells"), F.array(error_text(F.col("errors"))))


def chunk_lines(rows: DataFrame) -> DataFrame:
    """Chunk files of rows (source_object_key, chunk_seq, row_in_chunk, header, cells)."""
    return _lines(rows, chunk_key(F.col("source_object_key"), F.col("chunk_seq")), F.col("header"), F.col("cells"))


def error_lines(rejected: DataFrame) -> DataFrame:
    """An error file for each chunk with rejected rows: chunk, row in chunk, the cells as they were, all messages."""
    return _lines(rejected, error_key(chunk_key(F.col("source_object_key"), F.col("chunk_seq"))), _error_header(), _error_cells())


def result_lines(accepted: DataFrame, live: DataFrame) -> DataFrame:
    """The result of each import with a chunk in ``live`` (source_object_key, header): accepted rows, or the header alone."""
    return _lines(accepted, output_key(F.col("source_object_key"), "result.csv"), F.col("header"), F.col("cells"), live)


def merged_error_lines(rejected: DataFrame) -> DataFrame:
    """The error files of each import as one, with one header."""
    return _lines(rejected, output_key(F.col("source_object_key"), "errors.csv"), _error_header(), _error_cells())


def rejected_records(rows: DataFrame) -> DataFrame:
    """Rejected rows as records: chunk, row in chunk, the cells as they were, and all messages."""
    return rows.select("import_id", "chunk_seq", "row_in_chunk", join_cells(_error_cells()).alias("record"))


def write_files(lines: DataFrame, folder: str, replace: tuple[str, ...] = ()) -> str:
    """One file per key under ``folder``, lines in the order of chunk and row; returns the run, see ``keyed_files``.

    A task sorts the lines of a key (no file is larger than an import may be), writes them and puts the file
    in its place. In folders of ``replace`` (``chunks``, say) that stand in the path of a key, files of
    other keys go afterwards: a rerun with fewer chunks leaves none behind.
    """
    dealt = lines.repartition("key").sortWithinPartitions("key", "chunk_seq", "row_in_chunk")
    run = write_keyed(dealt, folder)
    if replace:
        keys = lines.select("key").distinct()
        remove_others(keys.where(F.regexp_extract("key", "([^/]*)/[^/]*$", 1).isin(*replace)), folder)
    return run


def write_ordered(records: DataFrame, header: str, path: str, one_file: bool = False) -> None:
    """Records in the order of chunk and row as text files whose names follow that order.

    The header line goes first. Ranges of rows are sorted side by side; one file is
    written only if asked for, as it needs one task.
    """
    spark = records.sparkSession
    top = spark.range(1).select(F.lit(-1).alias("chunk_seq"), F.lit(0).cast("long").alias("row_in_chunk"), F.lit(header).alias("record"))
    lines = top.unionByName(records.select("chunk_seq", "row_in_chunk", "record"))
    ranged = lines.coalesce(1) if one_file else lines.repartitionByRange("chunk_seq", "row_in_chunk")
    ranged.sortWithinPartitions("chunk_seq", "row_in_chunk").select("record").write.mode("overwrite").option("lineSep", "\n").text(path)
