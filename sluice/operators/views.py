"""Lists and summaries of imports and their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.status import CHUNK_TERMINAL, is_terminal


def owned(imports: DataFrame, user_id: int) -> DataFrame:
    return imports.where(F.col("user_id") == user_id)


def with_chunk_counts(imports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds chunks_total and chunks_finished, 0 for an import without chunks."""
    counts = chunks.groupBy(F.col("bulk_import_id").alias("_id")).agg(
        F.count("*").alias("chunks_total"), F.count_if(is_terminal(F.col("status"), CHUNK_TERMINAL)).alias("chunks_finished")
    )
    joined = imports.join(counts, imports.id == counts._id, "left").drop("_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chunks_total", "chunks_finished")})


def search(imports: DataFrame, text: str, page: int | None = None) -> DataFrame:
    """Imports whose file name contains the text in any case, newest first; a page of them if asked."""
    found = imports.where(F.contains(F.lower("original_filename"), F.lower(F.lit(text)))).orderBy(F.desc("created_at"), "id")
    return found.limit(page) if page else found


def chunk_detail(chunks: DataFrame, import_id: object) -> DataFrame:
    return chunks.where(F.col("bulk_import_id") == F.lit(import_id)).orderBy("sequence")


def summary(imports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sums of valid and rejected rows and the text ``x of y`` of each import."""
    sums = chunks.groupBy(F.col("bulk_import_id").alias("_id")).agg(
        F.sum("valid_rows").alias("valid_rows"), F.sum("invalid_rows").alias("rejected_rows"),
        F.count("*").alias("total"), F.count_if(is_terminal(F.col("status"), CHUNK_TERMINAL)).alias("finished"),
    )
    joined = imports.join(sums, imports.id == sums._id, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("valid_rows", "rejected_rows", "total", "finished")})
    text = F.concat_ws(" of ", F.col("finished").cast("string"), F.col("total").cast("string"))
    return joined.select(*imports.columns, "valid_rows", "rejected_rows", text.alias("chunks_progress"))
