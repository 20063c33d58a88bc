"""Results of an import: ordered accepted rows, merged errors, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.config import Limits
from sluice.functions.cells import limited, output_key


def rejected_positions(errors: DataFrame) -> DataFrame:
    return errors.select("import_id", "chunk_seq", "row_in_chunk")


def assemble_rows(rows: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of chunks that didn't fail, without rejected positions; order by import, chunk, row.

    chunks: import_id, chunk_seq, status.
    """
    failed = chunks.where("status = 'failed'").select("import_id", "chunk_seq")
    kept = rows.join(failed, ["import_id", "chunk_seq"], "left_anti")
    return kept.join(rejected_positions(errors), ["import_id", "chunk_seq", "row_in_chunk"], "left_anti")


def merge_errors(errors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rejected rows of chunks that didn't fail."""
    failed = chunks.where("status = 'failed'").select("import_id", "chunk_seq")
    return errors.join(failed, ["import_id", "chunk_seq"], "left_anti")


def failed_chunk_text(chunk_seq: str = "chunk_seq", status: str = "status"):
    """Aggregate: the failed chunks of an import in order, as a message; null without any."""
    failed = F.array_sort(F.collect_list(F.when(F.col(status) == "failed", F.col(chunk_seq))))
    return F.when(F.size(failed) > 0, F.concat(F.lit("Chunks that could not be validated: "), F.array_join(failed.cast("array<string>"), ", ")))


def import_outcome(imports: DataFrame, chunks: DataFrame, limits: Limits = Limits(), at: Column | None = None, given_up: DataFrame | None = None) -> DataFrame:
    """Final status, keys, message and completed_at of imports (id, source_object_key) whose chunks are finished.

    chunks: import_id, chunk_seq, status, invalid_rows; at: when, now if None. Imports in
    ``given_up`` (id, reason), whose attempts at assembly are used up, are failed.
    """
    failed, live = F.col("status") == "failed", F.col("status") != "failed"
    facts = chunks.groupBy("import_id").agg(
        F.bool_or(failed | (F.col("invalid_rows") > 0)).alias("bad"), F.bool_or(live).alias("has_result"),
        F.bool_or(live & (F.col("invalid_rows") > 0)).alias("has_errors"), failed_chunk_text().alias("failure_message"),
    )
    joined = imports.join(facts, imports.id == facts.import_id, "left").withColumn("reason", F.lit(None).cast("string"))
    if given_up is not None:
        lost = given_up.groupBy(F.col("id").alias("lost_id")).agg(F.coalesce(F.min("reason"), F.lit("")).alias("why"))
        joined = joined.drop("reason").join(lost, F.col("id") == F.col("lost_id"), "left").withColumnRenamed("why", "reason")
    lost = F.col("reason").isNotNull()
    status = F.when(lost, F.lit("failed")).when(F.coalesce("bad", F.lit(False)), F.lit("completed_with_errors")).otherwise(F.lit("completed"))
    return joined.select(
        "id",
        status.alias("status"),
        F.when(~lost & F.col("has_result"), output_key(F.col("source_object_key"), "result.csv")).alias("output_object_key"),
        F.when(~lost & F.col("has_errors"), output_key(F.col("source_object_key"), "errors.csv")).alias("error_object_key"),
        limited(F.coalesce("reason", "failure_message"), limits.message_chars).alias("failure_message"),
        F.when(~lost, F.current_timestamp() if at is None else at).alias("completed_at"),
    )
