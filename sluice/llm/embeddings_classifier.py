"""Quality by supervised subword embeddings.

Every hashed word, word pair and character n-gram has a learned vector; a document
is the mean of its features' vectors, and a linear layer with softmax over the two
labels reads it. Vectors and layer are trained together by stochastic gradient
descent in numpy. With the layer fixed, a feature adds a fixed amount to the
difference of the two logits, so scoring sums one number per feature.

Training uses labelled rows outside the held-out third only, at most
``learn.SAMPLE_ROWS`` of them; only the text is an input. Null and empty texts have
no features and get the score of the bias alone. Repeated rows get equal scores; without
labels every score says 1. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.features import BITS, table_means
from sluice.llm.learn import Bag, fitted, sigmoid
from sluice.llm.shared import small_batches, text_bounds

DIMENSIONS = 8
EPOCHS = 6
RATE = 4.0
HELD_OUT_OF, HELD_OUT = 3, 1


def train(bags: list[Bag], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weight of each feature in the logit of label 1, its factor, and the bias."""
    draw = np.random.default_rng(7)
    vectors = draw.normal(0, 0.5, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps = EPOCHS * len(bags)
    for k in range(EPOCHS):
        for s, i in enumerate(draw.permutation(len(bags)).tolist()):
            features, shares = bags[i]
            rate = np.float32(RATE * (1 - (k * len(bags) + s) / steps))
            mean = shares @ vectors[features]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= np.float32(0.05) * rate * p
            # as large a step for the mean whatever the document's length
            vectors[features] -= (rate / max(1e-6, float(shares @ shares)) ** 0.5) * shares[:, None] * back[None, :]
    return vectors @ (layer[1] - layer[0]), 1.0, float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def _score(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, factor, bias = model.value
        for batch in small_batches(batches, "text"):
            score = sigmoid(factor * table_means(*text_bounds(batch.column(batch.schema.get_field_index("text"))), weights) + bias)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fitted(docs, labels.where(~held_out(F.col("doc_id"))), train)
    scored = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return scored.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
