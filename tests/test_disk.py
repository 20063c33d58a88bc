"""Disk of an import: what its steps wrote goes when it is used up."""

import os

import duckdb
from pyspark.sql import functions as F

from sluice.plans.catalogue import documents_import_files
from sluice.sources import sinks
from sluice.sources.records import csv_records
from sluice.storage import work_folder

DATA = "/root/testdata/sf0.001"


def size(folder):
    return sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(folder) for name in names)


def shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in blocks.split() if b.startswith("shuffle_") and b.endswith("_data")}


def test_files_of_an_import_go_kind_by_kind(spark, monkeypatch):
    base = work_folder(spark).rpartition("/")[0].removeprefix("file:")
    before, found, write = set(os.listdir(base)), [], sinks.write_keyed
    sizes = lambda: sum(size(f"{base}/{x}") for x in set(os.listdir(base)) - before)
    blocks = shuffled(spark)

    def noted(lines, folder):
        found.append((sizes(), len(shuffled(spark) - blocks)))
        return write(lines, folder)

    monkeypatch.setattr(sinks, "write_keyed", noted)
    out = documents_import_files(spark, DATA)
    text = duckdb.sql(f"select sum(strlen(text)) from '{DATA}/documents.parquet'").fetchall()[0][0]
    # before files of a kind are written there are the checked rows, compressed, neither their source nor other files
    assert len(found) == 3 and max(x for x, _ in found) < text and {n for _, n in found} == {0}
    assert len(set(os.listdir(base)) - before) == 1 and sizes() < text / 4 and out.count() > 400


def test_records_are_written_by_column(spark, tmp_path):
    base = work_folder(spark).rpartition("/")[0].removeprefix("file:")
    (tmp_path / "a.csv").write_text("".join(f'{i},"{os.urandom(400).hex()}\n"\n' for i in range(3000)))
    before = set(os.listdir(base))
    kept, splits = spark.conf.get("spark.sql.files.maxPartitionBytes"), "300000b"
    spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
    try:
        got = csv_records(spark, str(tmp_path), columns=("record_no", F.col("cells")[0].alias("first")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted(map(tuple, got.collect())) == [(i + 1, str(i)) for i in range(3000)]
    assert sum(size(f"{base}/{x}") for x in set(os.listdir(base)) - before) < 200_000


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.csv").write_text(f"a,b\n{i},2\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = csv_records(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got.count() == 400 and len(got.inputFiles()) < 20
