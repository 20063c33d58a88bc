"""Tables written between steps, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's own removal of an execution's shuffle files at its end.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes that are decoded in the time that opening a file takes.
OPEN_COST = 128 * 1024

#: Folders handed out inside ``passing``.
_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder, noted = f"{base.rstrip('/')}/sluice-{uuid.uuid4().hex}", _FOLDERS.get()
    if noted is not None:
        noted.append(folder)
    return folder


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def no_leftovers(spark: SparkSession):
    """Shuffle files of what runs inside go at its end."""
    return settings(spark, {FILE_CLEANUP: "true"})


def short_listing(spark: SparkSession):
    """Folders that are listed inside are dealt to some tasks a core; Spark's own way is a task for each folder, up to 10,000."""
    return settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism)})


def shared_tasks(spark: SparkSession):
    """Small files that are read inside share tasks by their bytes; Spark's own way counts each as 4 MB at least, which decoding takes much longer for than opening a file."""
    return settings(spark, {"spark.sql.files.openCostInBytes": str(OPEN_COST)})


def through_table(df: DataFrame, name: str = "table", small: bool = False) -> DataFrame:
    """``df`` written as Parquet and read again, so that several outputs share one computation; ``small``: for whole texts, with a codec that takes less disk."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}"
    with no_leftovers(spark):
        (df.write.option("compression", "zstd") if small else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of any store that Spark writes to; one that isn't there is no error."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """All folders that steps inside take are deleted at its end, if it fails as well, but for tables written by the
    function that it gives, a ``through_table`` whose tables stay.

    Calls may stand inside one another: what stays of an inner one is a step of the outer one.
    """
    outer, own, stay = _FOLDERS.get(), [], []

    def kept(df: DataFrame, name: str = "table", small: bool = False) -> DataFrame:
        out = through_table(df, name, small)
        stay.append(_FOLDERS.get().pop())
        return out

    inside = _FOLDERS.set(own)
    try:
        yield kept
    except BaseException:
        own.extend(stay)
        stay.clear()
        raise
    finally:
        _FOLDERS.reset(inside)
        delete(spark, *own)
        if outer is not None:
            outer.extend(stay)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "result") -> DataFrame:
    """``make()`` as a written table; all tables that steps wrote on the way to it are deleted, if it fails as well."""
    with passing(spark) as kept:
        return kept(make(), name)
