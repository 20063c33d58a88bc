"""Imports that begin when their file arrives.

The stream's source is the folder itself: Spark lists it, keeps the files of each batch in the
checkpoint's log before the batch runs, and names them again after a crash; so a file belongs to one
batch for ever. A batch is a whole import of its files. All that it writes is named by
the batch or by the files' object keys and replaces what an earlier attempt at it left, the
table ``imports`` last: a batch that isn't there hasn't ended. Files without bytes never
show up in Spark's file sources and start no import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.config import Limits
from sluice.functions.rules import RuleSet
from sluice.plans.bulk_import import bulk_import
from sluice.sources.gates import plain_path
from sluice.storage import through_table

#: Tables of an import; the last one is written last.
TABLES = ("rows", "chunks", "requests", "imports")


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """path, length and modificationTime of files as they arrive under ``folder``; their contents aren't read."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = stream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(plain_path(F.col("path")).alias("path"), "length", "modificationTime")


def import_stream(
    files: DataFrame, describe: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, rules: RuleSet | None = None, limits: Limits = Limits(),
    parse_columns: tuple[str, ...] | None = None,
) -> StreamingQuery:
    """Runs the imports of ``files`` (see ``arriving_files``) batch by batch, until all that has arrived is done.

    describe: gives the imports (id, path, original_filename, source_object_key) of a batch's files; files
    that it leaves out start none. Outputs go to ``folder``: files under their object keys in ``files``, and
    the tables ``TABLES``, one folder per batch; read them with ``imported``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        imports = through_table(describe(batch))
        # as many as a batch may have
        paths = [r["path"] for r in imports.select("path").distinct().collect()]
        if not paths:
            return
        done = bulk_import(batch.sparkSession, imports, paths, rules, limits, parse_columns)
        done.write(f"{folder}/files")
        for name in TABLES:
            getattr(done, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def imported(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``TABLES`` over all batches that ended."""
    table = spark.read.parquet(f"{folder}/{name}")
    if name == TABLES[-1]:
        return table
    ended = spark.read.parquet(f"{folder}/{TABLES[-1]}").select("batch").distinct()
    return table.join(F.broadcast(ended), "batch", "left_semi")  # a row per batch
