"""The whole import: files to accepted rows, rejected rows, chunk and import status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.config import Limits
from sluice.functions.cells import error_key, limited
from sluice.functions.rules import RuleSet, consent_rules
from sluice.operators.assemble import import_outcome, merge_errors
from sluice.operators.chunking import assign_chunks, chunk_list, fanout, record_bytes
from sluice.operators.lifecycle import completion
from sluice.operators.validate import accepted, chunk_counts, chunk_failures, project, reject_duplicates, rejected, row_errors
from sluice.sources.gates import verdicts
from sluice.sources.records import without_blanks
from sluice.sources.sinks import chunk_lines, error_lines, merged_error_lines, result_lines, write_files
from sluice.storage import passing, through_table


#: Files that an import makes, by the folder they lie in.
FILE_KINDS = ("chunks", "errors", "output")


@dataclass(frozen=True)
class Imported:
    """imports: id, status, keys, message, completed_at; chunks: status, counts, keys and message; requests: the
    messages that went out; rows: those of all chunks with errors, an empty list if they pass."""

    imports: DataFrame
    chunks: DataFrame
    requests: DataFrame
    rows: DataFrame

    def _state(self) -> DataFrame:
        return self.chunks.select(F.col("bulk_import_id").alias("import_id"), F.col("sequence").alias("chunk_seq"), "status")

    @property
    def accepted(self) -> DataFrame:
        """Rows of the result: those of chunks that didn't fail, without rejected ones."""
        return merge_errors(accepted(self.rows), self._state())

    @property
    def rejected(self) -> DataFrame:
        """Rejected rows of chunks that didn't fail."""
        return merge_errors(rejected(self.rows), self._state())

    def lines(self, kind: str) -> DataFrame:
        """The lines of the files of one of ``FILE_KINDS``, see ``sinks``."""
        if kind == "chunks":
            return chunk_lines(self.rows)
        if kind == "errors":
            return error_lines(self.rejected)
        if kind != "output":
            raise ValueError(f"no such files: {kind}")
        live = self.rows.join(self._state().where("status <> 'failed'").drop("status"), ["import_id", "chunk_seq"], "left_semi")
        return result_lines(self.accepted, live).unionByName(merged_error_lines(self.rejected))

    def write(self, folder: str, kinds: tuple[str, ...] = FILE_KINDS) -> None:
        """Chunk, error and output files under their object keys in ``folder``; a rerun replaces them."""
        for kind in kinds:
            write_files(self.lines(kind), folder, (kind,))


def _checked_rows(rows: DataFrame, rules: RuleSet, limits: Limits) -> DataFrame:
    """Rows (nth: of their import, import_id, source_object_key, record_no, header, cells) with chunk_seq, row_in_chunk and errors."""
    cells = project(F.col("header"), F.col("cells"), rules.columns)
    narrow = rows.select("nth", "import_id", "record_no", record_bytes(F.col("cells")).alias("n"), record_bytes(F.col("header")).alias("head"), row_errors(F.col("header"), F.col("cells"), rules).alias("errors"), rules.key(cells).alias("key"))
    # of rows with errors no key is asked for, and it may be a whole text
    narrow = through_table(narrow.withColumn("key", F.when(F.size("errors") == 0, F.col("key"))))
    placed = assign_chunks(narrow, "import_id", "record_no", "n", limits, header="head")
    placed = reject_duplicates(placed, ["import_id", "chunk_seq"], F.col("key")).select("nth", "record_no", "chunk_seq", "row_in_chunk", "errors")
    whole = rows.select("nth", "import_id", "source_object_key", "record_no", "header", "cells").join(through_table(placed), ["nth", "record_no"])
    return whole.select("import_id", "source_object_key", "chunk_seq", "row_in_chunk", "record_no", "header", "cells", "errors")


def bulk_import(
    spark: SparkSession, imports: DataFrame, folder: str | list[str], rules: RuleSet | None = None, limits: Limits = Limits(),
    parse_columns: tuple[str, ...] | None = None, given_up: DataFrame | None = None, when_read: Callable[[], None] | None = None,
) -> Imported:
    """Runs the imports (id, path, original_filename, source_object_key) whose files lie in ``folder`` (or are the ones listed).

    A file that fails a check gives a failed import and no rows. The others are cut into
    chunks, each chunk is requested, validated and counted, and an import whose chunks are
    all finished is requested to be assembled. A chunk fails if its header lacks a column
    of the rules (``parse_columns``: what parsing asked of the file, the same if None) or if
    ``given_up`` (import_id, chunk_seq, reason) names it, as one whose attempts are used up;
    its rows are in no output. Checked rows are written once; every output reads that table.
    Chunks and errors are told from a narrow table, so whole rows are shuffled once, and tables that
    are used up go before the next step. ``when_read`` is called once no file of ``folder`` is read any more.
    """
    rules = rules or consent_rules(limits)
    asked = rules.columns if parse_columns is None else parse_columns
    with passing(spark) as kept:
        checked, records = verdicts(spark, imports, folder, asked, limits)
        checked = kept(checked.withColumn("nth", F.monotonically_increasing_id()))
        if when_read:
            when_read()
        queued = checked.where("status = 'queued'")
        live = queued.select("nth", F.col("id").alias("import_id"), "path", "header", "source_object_key")
        rows = without_blanks(records.where("record_no > 1")).join(live, "path")
        rows = kept(_checked_rows(rows, rules, limits), small=True)
    pending = chunk_list(rows)
    parsing = queued.select("id", F.lit("parsing").alias("status"))
    requests = fanout(pending, parsing).select("bulk_import_id", "routing_key", "payload")
    failures = chunk_failures(rows.select("import_id", "chunk_seq", "header").dropDuplicates(["import_id", "chunk_seq"]), rules, limits)
    if given_up is not None:
        lost = given_up.select("import_id", F.col("chunk_seq").cast("int").alias("chunk_seq"), F.lit("failed").alias("status"), limited(F.col("reason"), limits.message_chars).alias("failure_message"))
        failures = failures.unionByName(lost).groupBy("import_id", "chunk_seq", "status").agg(F.min("failure_message").alias("failure_message"))
    counts = chunk_counts(rows, ["import_id", "chunk_seq"]).join(failures, ["import_id", "chunk_seq"], "left")
    chunks = pending.drop("status").join(counts, (F.col("bulk_import_id") == F.col("import_id")) & (F.col("sequence") == F.col("chunk_seq"))).drop("import_id", "chunk_seq")
    chunks = chunks.withColumn("status", F.coalesce("status", F.lit("completed")))
    # nothing is known of the rows of a failed chunk
    chunks = chunks.withColumns({c: F.when(F.col("status") == "failed", 0).otherwise(F.col(c)).cast("long") for c in ("valid_rows", "invalid_rows")})
    chunks = through_table(chunks.withColumn("error_object_key", F.when(F.col("invalid_rows") > 0, error_key(F.col("source_object_key")))))
    done = completion(queued.select("id", F.lit("validating").alias("status")), chunks)
    requests = requests.unionByName(done.withColumn("payload", F.to_json(F.struct("bulk_import_id"))).select("bulk_import_id", "routing_key", "payload"))
    state = chunks.select(F.col("bulk_import_id").alias("import_id"), F.col("sequence").alias("chunk_seq"), "status", "invalid_rows")
    ready = queued.select("id", "source_object_key").join(done.select(F.col("bulk_import_id").alias("id")), "id", "left_semi")
    outcome = import_outcome(ready, state, limits)
    failed = checked.where("status = 'failed'").select("id", "status", *(F.lit(None).cast("string").alias(c) for c in ("output_object_key", "error_object_key")), "failure_message", F.lit(None).cast("timestamp").alias("completed_at"))
    return Imported(outcome.unionByName(failed), chunks, requests, rows)
