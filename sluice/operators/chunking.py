"""Chunks: ordered slices of an import, bounded by rows and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.config import Limits
from sluice.functions.cells import chunk_key, join_cells
from sluice.operators import jumps
from sluice.storage import through_table


def record_bytes(cells: Column) -> Column:
    """Bytes of a record as a chunk file holds it, its line end included."""
    return (F.octet_length(join_cells(cells)) + 1).cast("long")


def assign_by_rows(rows: DataFrame, scope: list[str], order: list[str], max_rows: int) -> DataFrame:
    """chunk_seq and row_in_chunk where only the number of rows closes a chunk.

    Rows are dealt into ordered ranges and written once; counts per range give each
    range its first number, so no task sees more than one range.
    """
    ranged = through_table(rows.repartitionByRange(*scope, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*scope, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    places = [F.col(x).alias(f"_{i}") for i, x in enumerate(scope)]
    counts = counts.select(*places, F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_begin"))
    own = Window.partitionBy(*scope, "_range").orderBy(*order)
    same = F.col("_range") == F.col("_r")
    for i, x in enumerate(scope):  # a null scope is one, too
        same = same & F.col(x).eqNullSafe(F.col(f"_{i}"))
    numbered = ranged.withColumn("_n", F.row_number().over(own)).join(counts, same).drop("_r", *(f"_{i}" for i in range(len(scope))))
    n = F.col("_begin") + F.col("_n") - 1
    return numbered.withColumn("chunk_seq", F.floor(n / max_rows).cast("int") + 1).withColumn("row_in_chunk", (n % max_rows + 1).cast("long")).drop("_n", "_begin", "_range")


def assign_chunks(rows: DataFrame, scope: str, order: str, size: str, limits: Limits = Limits(), header: str | None = None) -> DataFrame:
    """``rows`` with chunk_seq and row_in_chunk.

    A chunk is closed after the row that brings it to ``chunk_rows`` rows or, header
    included, to ``chunk_bytes`` bytes; so it has one row at least. Where a chunk begins depends on every row
    before it, and yet many tasks cut one scope: see ``jumps``. Only scope, order and the two sizes go
    that way; the rows meet their places in one join. A null scope is one, null orders come
    first, and rows that repeat both are taken by size, equal ones in any order.
    """
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = rows.withColumns({"_n": count(size), "_head": count(header) if header else F.lit(0).cast("long")})
    narrow = rows.select(F.col(scope).alias("s"), F.col(order).alias("o"), F.col("_n").alias("n"), F.col("_head").alias("head"))
    own = ["_place_scope", "_place_order", "_place_n", "_place_head", "_place_nth"]
    places = jumps.places(narrow, limits.chunk_rows, limits.chunk_bytes).toDF(*own, "chunk_seq", "row_in_chunk")
    same = F.col(scope).eqNullSafe(F.col(own[0])) & F.col(order).eqNullSafe(F.col(own[1])) & (F.col("_n") == F.col(own[2])) & (F.col("_head") == F.col(own[3]))
    if places.where(F.col(own[4]) > 0).isEmpty():
        out = rows.join(places, same)
    else:
        nth = F.row_number().over(Window.partitionBy(scope, order, "_n", "_head").orderBy(F.lit(0))) - 1
        out = rows.withColumn("_nth", nth).join(places, same & (F.col("_nth") == F.col(own[4]))).drop("_nth")
    return out.drop(*own, "_n", "_head")


def chunk_list(rows: DataFrame, source_key: str = "source_object_key") -> DataFrame:
    """A pending chunk for each (import_id, chunk_seq), with its object key, in sequence order."""
    chunks = rows.select("import_id", source_key, "chunk_seq").distinct()
    return chunks.select(
        F.sha2(F.concat_ws("|", "import_id", F.col("chunk_seq").cast("string")), 256).alias("id"), F.col("import_id").alias("bulk_import_id"),
        F.col("chunk_seq").alias("sequence"), F.lit("pending").alias("status"), chunk_key(F.col(source_key), F.col("chunk_seq")).alias("source_object_key"),
    )


def fanout(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """A validate request per chunk, for imports that are in the state parsing."""
    live = imports.where("status = 'parsing'").select(F.col("id").alias("bulk_import_id"))
    payload = F.to_json(F.struct("bulk_import_id", F.col("id").alias("chunk_id"), F.col("source_object_key").alias("chunk_object_key")))
    return chunks.join(live, "bulk_import_id", "left_semi").select("bulk_import_id", "sequence", F.lit("consent.chunk.validate").alias("routing_key"), payload.alias("payload"))
