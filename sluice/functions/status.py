"""Statuses of imports and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status -> label; fixed values.
IMPORT_LABELS = {
    "awaiting_upload": "Awaiting upload",
    "queued": "Queued",
    "parsing": "Splitting file",
    "validating": "Validating",
    "assembling": "Building result",
    "completed": "Completed",
    "completed_with_errors": "Completed with rejected rows",
    "failed": "Failed",
}
IMPORT_TERMINAL = ("completed", "completed_with_errors", "failed")
CHUNK_STATUSES = ("pending", "processing", "completed", "failed")
CHUNK_TERMINAL = ("completed", "failed")

#: Status -> those it may be reached from.
IMPORT_MOVES = {
    "parsing": ("queued",),
    "validating": ("parsing",),
    "assembling": ("validating",),
    "completed": ("assembling",),
    "completed_with_errors": ("assembling",),
    "failed": ("queued", "parsing", "assembling"),
}
CHUNK_MOVES = {"processing": ("pending",), "completed": ("pending", "processing"), "failed": ("pending", "processing")}


def status_label(status: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in IMPORT_LABELS.items() for x in pair))[status]


def is_terminal(status: Column, terminal: tuple[str, ...] = IMPORT_TERMINAL) -> Column:
    return status.isin(*terminal)


def progress_percent(status: Column, finished: Column, total: Column) -> Column:
    """0 to 100: the first tenth for splitting the file, the next eight for its chunks."""
    # whole numbers only: half of the total, rounded up, decides as rounding half up does
    share = F.when(total > 0, F.floor((160 * finished + total) / (2 * total))).otherwise(0)
    return (
        F.when(status.isin("awaiting_upload", "queued"), 0).when(status == "parsing", 5).when(status == "validating", 10 + share)
        .when(status == "assembling", 95).when(is_terminal(status), 100).cast("int")
    )
