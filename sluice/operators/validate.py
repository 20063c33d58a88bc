"""Rows of chunks against a rule set: errors, duplicates, accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.config import Limits
from sluice.functions.cells import ascii_lower, limited, trim_cell
from sluice.functions.rules import RuleSet
from sluice.sources.gates import PREFIX


def project(header: Column, cells: Column, columns: tuple[str, ...]) -> dict[str, Column]:
    """Trimmed cells of the named columns, found in the header in any case."""
    lower = F.transform(header, lambda c: ascii_lower(c))
    return {c: trim_cell(F.try_element_at(cells, F.nullif(F.array_position(lower, ascii_lower(F.lit(c))).cast("int"), F.lit(0)))) for c in columns}


def row_errors(header: Column, cells: Column, rules: RuleSet) -> Column:
    """Messages of a row; a wrong number of cells is the only one it gets."""
    count = F.concat(F.lit("has "), F.size(cells).cast("string"), F.lit(" cells but the header has "), F.size(header).cast("string"))
    return F.when(F.size(cells) != F.size(header), F.array(count)).otherwise(rules.errors(project(header, cells, rules.columns)))


def reject_duplicates(rows: DataFrame, scope: list[str], key: Column, place: str = "row_in_chunk", errors: str = "errors") -> DataFrame:
    """Adds the duplicate message to rows without errors whose key an earlier one of the scope has.

    Rows with errors neither claim a key nor get the message. The window's key is
    scope and record key, so only copies of one record meet.
    """
    clean = F.size(errors) == 0
    first = F.min(F.when(clean, F.col(place))).over(Window.partitionBy(*scope, "_key"))
    text = F.concat(F.lit("is a duplicate of row "), F.col("_first").cast("string"), F.lit(" of this chunk"))
    rows = rows.withColumn("_key", F.when(clean, key)).withColumn("_first", F.when(clean, first))
    repeated = F.col(place) > F.col("_first")
    return rows.withColumn(errors, F.when(F.coalesce(repeated, F.lit(False)), F.array(text)).otherwise(F.col(errors))).drop("_key", "_first")


def validate_rows(rows: DataFrame, rules: RuleSet) -> DataFrame:
    """``rows`` (import_id, chunk_seq, row_in_chunk, header, cells) with errors; none means accepted."""
    rows = rows.withColumn("errors", row_errors(F.col("header"), F.col("cells"), rules))
    key = rules.key(project(F.col("header"), F.col("cells"), rules.columns))
    return reject_duplicates(rows, ["import_id", "chunk_seq"], key)


def chunk_failures(headers: DataFrame, rules: RuleSet, limits: Limits = Limits()) -> DataFrame:
    """Chunks (import_id, chunk_seq, header) whose header lacks a column, with status and message."""
    lower = F.transform("header", lambda c: ascii_lower(c))
    missing = F.filter(F.array(*(F.lit(c) for c in rules.columns)), lambda c: ~F.array_contains(lower, ascii_lower(c)))
    text = F.concat(F.lit(f"{PREFIX}the chunk header is missing the column ["), F.try_element_at(missing, F.lit(1)), F.lit("]."))
    return headers.where(F.size(missing) > 0).select("import_id", "chunk_seq", F.lit("failed").alias("status"), limited(text, limits.message_chars).alias("failure_message"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") == 0)


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") > 0)


def chunk_counts(rows: DataFrame, scope: list[str]) -> DataFrame:
    """valid_rows and invalid_rows of each chunk."""
    return rows.groupBy(*scope).agg(F.count_if(F.size("errors") == 0).alias("valid_rows"), F.count_if(F.size("errors") > 0).alias("invalid_rows"))
