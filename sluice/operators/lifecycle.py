"""Guarded status changes, replays, the completion barrier and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.status import CHUNK_TERMINAL, IMPORT_MOVES, is_terminal, progress_percent
from sluice.storage import through_table

#: Changes of a range.
RANGE_ROWS = 1 << 18


def may_move(now: Column, to: Column, moves: dict[str, tuple[str, ...]]) -> Column:
    """Whether the change is allowed from the current status."""
    out = F.lit(False)
    for target, sources in moves.items():
        out = out | ((to == target) & now.isin(*sources))
    return out


def fold(events: DataFrame, key: str, order: list[str], to: str, initial: str = "queued", moves: dict[str, tuple[str, ...]] = IMPORT_MOVES) -> DataFrame:
    """The status that each key's changes, taken in order, lead to; changes that aren't allowed are ignored.

    The outcome depends on the order of all changes, yet no task needs all of a key's:
    ordered ranges of changes are reduced to a map from the status before a range to the
    one after it, and the few maps of a key are applied one after the other. A null key is a key.
    """
    statuses = sorted({initial, *moves, *(s for sources in moves.values() for s in sources)})
    # so many that a range's changes of one key are a short list
    ranges = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), events.count() // RANGE_ROWS + 1)
    ranged = through_table(events.select(key, *order, F.col(to).alias("_to")).repartitionByRange(ranges, key, *order).withColumn("_range", F.spark_partition_id()))
    steps = F.array_sort(F.collect_list(F.struct(*order, F.col("_to").alias("to"))))
    step = lambda now, e: F.when(F.coalesce(may_move(now, e["to"], moves), F.lit(False)), e["to"]).otherwise(now)
    parts = ranged.groupBy(key, "_range").agg(steps.alias("_steps"))
    after = F.create_map(*(x for s in statuses for x in (F.lit(s), F.aggregate("_steps", F.lit(s), step))))
    parts = parts.select(key, F.struct(F.col("_range"), after.alias("after")).alias("_part"))
    folded = F.aggregate(F.array_sort(F.collect_list("_part"), lambda a, b: a["_range"] - b["_range"]), F.lit(initial), lambda now, p: p["after"][now])
    return parts.groupBy(key).agg(folded.alias("status"))


def once(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first event of each key; replays have no effect.

    A smallest value has partial aggregates, so of a key with many events each task passes on one.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in events.columns))
    first = events.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def completion(imports: DataFrame, chunks: DataFrame) -> DataFrame:
    """An assemble request for each import in the state validating whose chunks are all finished.

    imports: id, status; chunks: bulk_import_id, status.
    """
    done = chunks.groupBy("bulk_import_id").agg(F.bool_and(is_terminal(F.col("status"), CHUNK_TERMINAL)).alias("done")).where("done")
    ready = imports.where("status = 'validating'").join(done, imports.id == done.bulk_import_id, "left_semi")
    return ready.select(F.col("id").alias("bulk_import_id"), F.lit("consent.import.assemble").alias("routing_key"))


def with_progress(imports: DataFrame) -> DataFrame:
    """Adds ``progress`` to imports with status, chunks_finished and chunks_total."""
    return imports.withColumn("progress", progress_percent(F.col("status"), F.col("chunks_finished"), F.col("chunks_total")))
