"""Quality rules: base counts of whole texts, and a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word and character n-grams,
fitted in numpy on labelled quality rows (at most ``learn.SAMPLE_ROWS``). A fifth of
the sample is kept back to calibrate its logit (a factor and a bias fitted by
Newton steps). Arrow batches are then scored against a fixed threshold.

Base rule: too few words, or too large a share of words in five-word windows that
occur twice or more in the same text. Null and empty texts have no words and fail
it. Repeated rows get equal results; labels with null quality take no part, and without
labels the classifier rejects nothing. Other columns are carried along, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from sluice.llm.features import BITS, table_means
from sluice.llm.learn import Bag, fitted, sigmoid
from sluice.llm.shared import SHINGLE_WORDS, WHITE, blocks, shingle_hashes, small_batches, span_hashes, split_words, text_bounds

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: Rows with a calibrated probability of label 1 below this are rejected.
THRESHOLD = 0.3
EPOCHS, RATE = 6, 4.0

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
#: Bytes that begin a code point of a word.
_LETTER = (~WHITE & ((np.arange(256) < 128) | (np.arange(256) >= 192))).astype(np.int64)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def train(bags: list[Bag], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weight of each feature, and the calibrated factor and bias."""
    draw = np.random.default_rng(11)
    order = draw.permutation(len(bags))
    apart, own = order[: len(bags) // 5], order[len(bags) // 5 :]
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    steps, k = max(1, EPOCHS * len(own)), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(own).tolist():
            features, shares = bags[i]
            back = float(sigmoid(np.array(shares @ weights[features] + bias))) - labels[i]
            rate = RATE * (1 - k / steps)
            weights[features] -= np.float32(rate * back / max(1e-6, float(shares @ shares)) ** 0.5) * shares
            bias -= 0.05 * rate * back
            k += 1
    logits = np.array([bags[i][1] @ weights[bags[i][0]] for i in apart.tolist()]) + bias
    return weights, *calibrated(logits, labels[apart], bias)


def calibrated(logits: np.ndarray, labels: np.ndarray, bias: float) -> tuple[float, float]:
    """Factor and bias for means of weights, so that sigmoid(factor * mean + bias) is a probability."""
    a, b = 1.0, 0.0
    if len(labels) and 0 < labels.sum() < len(labels):
        # targets a little inside 0 and 1, so that a perfect split keeps finite logits
        pos, neg = labels.sum(), len(labels) - labels.sum()
        y = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        x = np.stack([logits, np.ones(len(logits))], axis=1)
        for _ in range(50):
            p = sigmoid(x @ [a, b])
            h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (p - y))
            step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
            a, b = a - step[0], b - step[1]
    return float(a), float(a * bias + b)


def _repeated(windows: np.ndarray, n_words: int) -> int:
    """How many words lie in windows that occur twice or more."""
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + SHINGLE_WORDS, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in COUNTS}
    for _, _, part, at in blocks(data, bounds):
        words = split_words(part, at)
        out["n_words"].append(words.counts)
        for name, flags in (("word_chars", _LETTER), ("n_symbols", _SYMBOL)):
            run = np.concatenate([[0], np.cumsum(flags[part])])
            out[name].append(run[at[1:]] - run[at[:-1]])
        # lines, of which those with a word count
        first = np.union1d(at[:-1][at[:-1] < len(part)], np.flatnonzero(part == 10) + 1)
        first = first[first < len(part)]
        last = np.append(first[1:], len(part))
        end = last - (part[last - 1] == 10) if len(first) else last
        solid = np.searchsorted(words.start, end) > np.searchsorted(words.start, first)
        first, end = first[solid], end[solid]
        hashes, doc = span_hashes(part, first, end), np.searchsorted(at, first, "right") - 1
        order = np.lexsort((hashes, doc))
        same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        out["n_dup_lines"].append(np.bincount(doc[order][1:][same], minlength=len(at) - 1))
        windows, ends = shingle_hashes(words)
        n = words.counts.tolist()
        rep = [_repeated(windows[a:b], k) if b - a > 1 else 0 for a, b, k in zip(ends[:-1].tolist(), ends[1:].tolist(), n, strict=True)]
        out["n_repeat_words"].append(np.array(rep, np.int64))
    return {k: np.concatenate(v) for k, v in out.items()}


def _judge(model: Broadcast, threshold: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, factor, bias = model.value
        for batch in small_batches(batches, text):
            data, bounds = text_bounds(batch.column(batch.schema.get_field_index(text)))
            counts = base_counts(data, bounds)
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])
            score = sigmoid(factor * table_means(data, bounds, weights) + bias)
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            columns |= {k: pa.array(counts[k], pa.int64()) for k in COUNTS} | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= threshold)), "probability": pa.array(score)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, others) with base counts, base_failed, kept and probability.

    Columns of these names are replaced.
    """
    docs = docs.drop(*COUNTS, "base_failed", "kept", "probability").withColumn("text", F.col("text").cast("string"))
    model = fitted(docs, labels, train)
    found = [*((c, LongType()) for c in COUNTS), ("base_failed", BooleanType()), ("kept", BooleanType()), ("probability", DoubleType())]
    # numbers for names, as a name may hold a dot
    names = [f"column {i}" for i in range(len(docs.columns))]
    kinds = [StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)] + [StructField(c, kind) for c, kind in found]
    scored = docs.toDF(*names).mapInArrow(_judge(model, threshold, names[docs.columns.index("text")]), StructType(kinds))
    return scored.toDF(*docs.columns, *(c for c, _ in found))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
