"""Fitting on a bounded sample of labelled rows, and scoring all rows with the result.

A fitted model is a table of one weight per feature, a factor and a bias, so it has a fixed size
and may be broadcast. The sample is the distinct labelled texts whose hashed doc_id comes
first, at most ``SAMPLE_ROWS`` of them and as many as have ``SAMPLE_BYTES`` together; training
runs in one task over these, so its memory is bounded by both. A text of any length counts as
``MOST_BYTES`` at most, as its features are a list no longer than the table: a very long text
is learned from as a whole and leaves room for the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.features import BITS, feature_bags
from sluice.llm.shared import small_batches, text_bounds, written

#: The bounds on the labelled rows that a model is fitted on, and on the bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 24 << 20
#: The most that one text counts for: a share of each row, so that a sample has enough of them.
MOST_BYTES = 64 << 10

Bag = tuple[np.ndarray, np.ndarray]
Fit = Callable[[list[Bag], np.ndarray], tuple[np.ndarray, float, float]]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        found = list(feature_bags(*text_bounds(batch.column(batch.schema.get_field_index("text")))))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column(batch.schema.get_field_index("doc_id")), "quality": batch.column(batch.schema.get_field_index("quality")),
            "features": pa.array([x.tobytes() for x, _ in found], pa.binary()), "shares": pa.array([x.tobytes() for _, x in found], pa.binary()),
        })


def _train(fit: Fit):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "quality", "features", "shares")), strict=True))
        bags = [(np.frombuffer(f, np.int32), np.frombuffer(s, np.float32)) for _, _, f, s in rows]
        weights, factor, bias = fit(bags, np.array([r[1] for r in rows], np.float64))
        return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "factor": pa.array([float(factor)]), "bias": pa.array([float(bias)])})

    return run


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit) -> Broadcast:
    """The model fitted on ``labels`` (doc_id, quality 0 or 1) of ``docs``, for all executors.

    Rows with a null or other quality take no part; a doc_id with several labels or
    texts gives each of them, rows that repeat count once. Without labelled rows the
    model says 1 of everything.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    marks = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    marks = marks.distinct().orderBy(*order).limit(SAMPLE_ROWS)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    # narrow rows first: how many rows and texts a doc_id has isn't known
    rows = docs.select("doc_id", "h", size).join(F.broadcast(marks), "doc_id").distinct().orderBy(*order, "h").limit(SAMPLE_ROWS)
    upto = F.sum(F.least("size", F.lit(MOST_BYTES))).over(Window.orderBy(*order, "h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = written(rows.withColumn("upto", upto).select("doc_id", "quality", "h", (F.col("upto") <= SAMPLE_BYTES).alias("taken")), "sample-rows")
    if not rows.isEmpty() and rows.where("taken").isEmpty():
        raise ValueError(f"no labelled text fits into a sample of {SAMPLE_BYTES} bytes")
    rows = rows.where("taken").drop("taken")
    sample = docs.join(F.broadcast(rows), ["doc_id", "h"]).dropDuplicates(["doc_id", "quality", "h"]).select("doc_id", "text", "quality")
    bags = sample.mapInArrow(_bags, "doc_id long, quality int, features binary, shares binary")
    model = written(bags.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_train(fit), "weights binary, factor double, bias double"), "model").first()
    weights = np.frombuffer(bytes(model["weights"]), np.float32) if model else np.zeros(1 << BITS, np.float32)
    return spark.sparkContext.broadcast((weights, model["factor"] if model else 1.0, model["bias"] if model else 1.0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
