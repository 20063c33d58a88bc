"""From raw documents to packed sequences: five stages, each one operator of ``sluice.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's documents. All but the last return the columns of
``documents``. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.jaccard import near_duplicates
from sluice.llm.lines import dedup_lines
from sluice.llm.mixing import materialised, mixed, sized
from sluice.llm.packing import pack
from sluice.llm.quality_rules import judged
from sluice.llm.shared import discard, written
from sluice.storage import settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A fitted model, rolling hashes and dynamic programming decide; SQL can't tell these.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being that of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep, unchanged."""
    kept = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    return kept.select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one; those without a word left go."""
    left = dedup_lines(docs)
    return _columns(left.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id.

    Rows without a doc_id can't be named as copies and stay; rows equal in doc_id
    and text are one document.
    """
    found = near_duplicates(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row as often as it is taken, and the words that are taken of it in part."""
    return _columns(materialised(mixed(written(sized(docs.select(COLUMNS)), "sized")), COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(docs, tokenizer_path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table documents. What stages write on their way, and a stage's documents after it, are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        kept = settled(spark, partial(stage, spark, docs, sf_dir), name)
        if place:
            discard(docs)
        docs = kept
    return docs
