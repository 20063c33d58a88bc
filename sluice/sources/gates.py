"""Verdicts on whole files: the first failing check names the reason."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.config import Limits
from sluice.functions.cells import ascii_lower, extension, file_size, is_blank, limited, trim_cell
from sluice.sources.records import csv_records
from sluice.storage import settings, shared_tasks, short_listing, through_table

#: What stands before a reason, and the reasons below; fixed values.
PREFIX = "The file is not processable: "


#: Files that a sample may read as a whole.
SMALL_BYTES = 1 << 20


def _is_text(sample: bytes, cut: bool) -> bool:
    """Whether the bytes are UTF-8; a character that the end of a cut sample cuts is forgiven."""
    for less in range(4 if cut else 1):
        try:
            sample[: len(sample) - less].decode()
            return True
        except UnicodeDecodeError:
            continue
    return False


def _first_bytes(sample_bytes: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verdicts on the files that a task's rows begin; nothing is asked of the last one beyond its first bytes, unless it is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, size, now = [], 0, None

        def verdict() -> pa.RecordBatch:
            whole = b"\n".join(head)
            sample = whole[:sample_bytes]
            return pa.RecordBatch.from_pydict({"path": [now], "has_nul": [b"\0" in sample], "bad_utf8": [not _is_text(sample, len(whole) > sample_bytes)]})

        for batch in batches:
            if not batch.num_rows:
                continue
            small = batch.column("file_bytes")[0].as_py() <= SMALL_BYTES
            # a task of large files has one split; only a split at its beginning counts
            if not small and batch.column("block")[0].as_py():
                return
            ends = pc.run_end_encode(batch.column("path"))
            first = 0
            for path, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                if path != now:
                    if now is not None:
                        yield verdict()
                    head, size, now = [], 0, None
                if batch.column("block")[first].as_py() == 0:
                    now = path
                    i = first
                    while i < end and size <= sample_bytes:
                        head.append(batch.column("value")[i].as_py())
                        size += len(head[-1]) + 1
                        i += 1
                first = end
            if size > sample_bytes and not small:
                break
        if now is not None:
            yield verdict()

    run.__name__ = name
    return run


def sample_verdicts(spark: SparkSession, folder: str | list[str], sample_bytes: int = Limits().sample_bytes, wanted: Column | None = None) -> DataFrame:
    """path, has_nul, bad_utf8 of the first bytes of each file; ``wanted``: a condition on ``_metadata`` that files are picked by before any is opened.

    Every split of a file of more than ``SMALL_BYTES`` is a task of its own, which stops reading as soon as it knows: behind
    the first bytes of a file, and at once where its split isn't the file's first. Smaller files share tasks and are
    read to their end, as a task that stops early costs its worker, and a worker for each costs more than the file. Written as tables.
    """
    with short_listing(spark):
        lines = spark.read.option("lineSep", "\n").text(folder, recursiveFileLookup=True)
    lines = lines if wanted is None else lines.where(wanted)
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def sampled(which: Column) -> DataFrame:
        rows = lines.where(which).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_size").alias("file_bytes"))
        return through_table(rows.mapInArrow(_first_bytes(sample_bytes, "first_bytes"), "path string, has_nul boolean, bad_utf8 boolean"))

    size = F.col("_metadata.file_size")
    with shared_tasks(spark):
        few = sampled(size <= SMALL_BYTES)
    # no two splits share a task, and a batch is little more than what is asked for
    with settings(spark, {"spark.sql.files.openCostInBytes": most, "spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):
        return few.unionByName(sampled(size > SMALL_BYTES))


def file_gate(imports: DataFrame, files: DataFrame, samples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``imports`` (original_filename, path) with ``reason``: null where the file may be read.

    files: path, length; samples: see ``sample_verdicts``. Spark's readers leave files
    without bytes out, so a file that isn't found counts as empty where the import
    recorded its size (source_size_bytes) as 0, else as missing.
    """
    joined = imports.join(files, "path", "left").join(samples, "path", "left")
    if "source_size_bytes" in imports.columns:
        joined = joined.withColumn("length", F.coalesce("length", F.when(F.col("source_size_bytes") == 0, F.lit(0))))
    reason = (
        F.when(ascii_lower(extension(F.col("original_filename"))) != "csv", F.lit("it is not a .csv file"))
        .when(F.col("length").isNull(), F.lit("the uploaded file is missing"))
        .when(F.col("length") == 0, F.lit("it is empty"))
        .when(F.col("length") > limits.file_bytes, F.concat(F.lit("it is larger than "), file_size(F.lit(limits.file_bytes))))
        .when(F.col("has_nul"), F.lit("it is not a text file"))
        .when(F.col("bad_utf8"), F.lit("it is not UTF-8 text"))
    )
    return joined.select(*imports.columns, "length", reason.alias("reason"))


def header_of(records: DataFrame) -> DataFrame:
    """path, header: the trimmed names of the first record, without a byte order mark."""
    names = F.transform("cells", lambda c: trim_cell(c))
    names = F.transform(names, lambda c, i: F.when(i == 0, trim_cell(F.regexp_replace(c, "^﻿", ""))).otherwise(c))
    return records.where("record_no = 1").select("path", names.alias("header"))


def header_reason(header: Column, required: tuple[str, ...]) -> Column:
    """What is wrong with a header: absent, unnamed, repeated or missing columns; null if nothing."""
    lower = F.transform(header, lambda c: ascii_lower(c))
    unnamed = F.array_position(header, F.lit(""))
    again = F.filter(F.transform(header, lambda c, i: F.when(F.array_position(lower, ascii_lower(c)) <= i, c)), lambda c: c.isNotNull())
    names = F.array(*(F.lit(c) for c in required)) if required else F.array().cast("array<string>")
    missing = F.filter(names, lambda c: ~F.array_contains(lower, ascii_lower(c)))
    # names are checked one by one, so of an unnamed and a repeated one the earlier counts
    first_again = F.array_min(F.filter(F.transform(header, lambda c, i: F.when(F.array_position(lower, ascii_lower(c)) <= i, i + 1)), lambda i: i.isNotNull()))
    return (
        F.when(header.isNull() | is_blank(header), F.lit("it has no header row"))
        .when((unnamed > 0) & (first_again.isNull() | (unnamed <= first_again)), F.concat(F.lit("column "), unnamed.cast("string"), F.lit(" of the header has no name")))
        .when(F.size(again) > 0, F.concat(F.lit("the header has the column ["), F.try_element_at(again, F.lit(1)), F.lit("] twice")))
        .when(F.size(missing) > 0, F.concat(F.lit("the header is missing the column(s) ["), F.array_join(missing, ", "), F.lit("]")))
    )


def content_gate(imports: DataFrame, records: DataFrame, required: tuple[str, ...], limits: Limits = Limits()) -> DataFrame:
    """``imports`` that passed the file gate, with ``reason`` from header, record sizes and blankness.

    The first record that is too large counts only if nothing is wrong before it.
    """
    headers = header_of(records)
    facts = records.groupBy("path").agg(
        F.min(F.when(F.col("n_bytes") > limits.record_bytes, F.col("record_no"))).alias("large"),
        F.count_if((F.col("record_no") > 1) & ~F.coalesce(is_blank(F.col("cells")), F.lit(False))).alias("filled"),
    )
    size_text = F.concat(F.lit("row "), F.col("large").cast("string"), F.lit(" is larger than "), file_size(F.lit(limits.record_bytes)), F.lit(", which usually means a quote is never closed"))
    reason = (
        F.when(F.col("large") == 1, size_text)
        .when(header_reason(F.col("header"), required).isNotNull(), header_reason(F.col("header"), required))
        .when(F.col("large").isNotNull(), size_text)
        .when(F.coalesce("filled", F.lit(0)) == 0, F.lit("it has no data rows"))
    )
    return imports.join(headers, "path", "left").join(facts, "path", "left").select(*imports.columns, "header", reason.alias("content_reason"))


#: Paths that a condition on files lists at most; of more, only what their sizes say is known before they are read.
LISTED_PATHS = 4096


def plain_path(path: Column) -> Column:
    """One spelling for paths of local files."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def gate_files(spark: SparkSession, imports: DataFrame, folder: str | list[str], limits: Limits = Limits()) -> tuple[DataFrame, Column]:
    """``imports`` (path, original_filename) with length and ``reason`` from the file gate, and the condition on
    ``_metadata`` that a scan leaves the refused files out by: none of their bytes is read again.

    Names and sizes come first; only files that pass these are sampled.
    """
    with short_listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(plain_path(F.col("path")).alias("path"), "length")
    imports = imports.withColumn("path", plain_path(F.col("path")))
    size = F.col("_metadata.file_size")
    named = through_table(file_gate(imports, files, spark.createDataFrame([], "path string, has_nul boolean, bad_utf8 boolean"), limits))
    wanted = (size <= limits.file_bytes) & passed(named)
    samples = sample_verdicts(spark, folder, limits.sample_bytes, wanted).withColumn("path", plain_path(F.col("path")))
    gated = through_table(file_gate(imports, files, samples, limits))
    return gated, (size <= limits.file_bytes) & passed(gated)


def passed(gated: DataFrame) -> Column:
    """A condition on ``_metadata`` that holds for files without a reason; refused ones are named as long as these are few."""
    refused = [r["path"] for r in gated.where("reason is not null and path is not null").select("path").limit(LISTED_PATHS + 1).collect()]
    if not refused or len(refused) > LISTED_PATHS:
        return F.lit(True)
    spellings = {s for p in refused for s in (p, re.sub("^file:/+", "file:/", p))}
    return ~F.col("_metadata.file_path").isin(*spellings)


def verdicts(spark: SparkSession, imports: DataFrame, folder: str | list[str], required: tuple[str, ...], limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """``imports`` (path, original_filename) with header, status (queued or failed) and failure_message, and the
    records of the files that passed the gate (see ``csv_records``, without ``raw``), which stands before any of them is decoded."""
    gated, wanted = gate_files(spark, imports, folder, limits)
    records = csv_records(spark, folder, limits.record_bytes, wanted, (plain_path(F.col("path")).alias("path"), "record_no", "n_bytes", "cells"))
    names = imports.columns
    checked = content_gate(gated, records, required, limits)
    reason = F.coalesce("reason", "content_reason")
    message = F.when(reason.isNotNull(), limited(F.concat(F.lit(PREFIX), reason, F.lit(".")), limits.message_chars))
    found = checked.select(*names, "header", F.when(reason.isNull(), F.lit("queued")).otherwise(F.lit("failed")).alias("status"), message.alias("failure_message"), reason.alias("reason"))
    return found, records
