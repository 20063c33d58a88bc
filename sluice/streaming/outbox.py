"""The outbox as a table that changes: relays mark rows batch after batch, and old rows go.

Rows lie in ranges of ids, a file each, and a versioned list says which files are the table and what a reader
must know of each: its first unpublished id and its oldest published time. A change writes the
ranges that it touches anew, under new names, and then sets the next version of the list, which fails if
somebody else has set it. So a relay reads the ranges with the oldest unpublished rows and no others,
a prune only those that hold old ones, a run that dies leaves the table as it was, and
of two that run side by side one starts again. The list has an entry per range.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sluice.operators.messages import KEEP_DAYS, prune, relay
from sluice.storage import through_table

RANGE_ROWS = 1 << 20


class Changed(RuntimeError):
    """Another change of the table came first."""


class OutboxTable:
    """Outbox rows (see ``messages.outbox_rows``; other columns go along) at a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, range_rows: int = RANGE_ROWS) -> None:
        self.spark, self.folder, self.schema, self.range_rows = spark, folder.rstrip("/"), schema, range_rows
        self.touched: list[str] = []  # of the last change, the ranges that it read

    # ------------------------------------------------------------ versions

    def _store(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        return path.getFileSystem(conf), lambda name: jvm.org.apache.hadoop.fs.Path(path, name)

    def current(self) -> tuple[int, list[dict]]:
        """The last version and its ranges in the order of ids."""
        store, path = self._store()
        root = path("x").getParent()
        names = sorted(f.getPath().getName() for f in store.listStatus(root)) if store.exists(root) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return 0, []
        text = self.spark.read.text(f"{self.folder}/versions/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1][:-5]), json.loads(text)

    def _set(self, version: int, ranges: list[dict]) -> None:
        """Sets the version after ``version``; an error if it is set."""
        store, path = self._store()
        try:
            out = store.create(path(f"{version + 1:012}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Changed(f"version {version + 1} of {self.folder} is set") from None
            raise
        out.write(bytearray(json.dumps(sorted(ranges, key=lambda r: r["first"])).encode()))
        out.close()

    # ------------------------------------------------------------ ranges

    def _rows(self, ranges: list[dict]) -> DataFrame:
        if not ranges:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/ranges/{r['name']}" for r in ranges))

    def _written(self, rows: DataFrame) -> list[dict]:
        """Writes rows as ranges of ``range_rows`` and says what the list has of each."""
        rows = through_table(rows.select(self.schema.names))
        n = max(1, -(-rows.count() // self.range_rows))
        run = uuid.uuid4().hex
        dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())
        dealt.write.partitionBy("part").parquet(f"{self.folder}/ranges/{run}")
        stored = self.spark.read.schema(StructType([*self.schema.fields, StructField("part", IntegerType())])).parquet(f"{self.folder}/ranges/{run}")
        open_ = F.col("published_at").isNull()
        facts = stored.groupBy("part").agg(
            F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"), F.count_if(open_).alias("unpublished"),
            F.min(F.when(open_, F.col("id"))).alias("first_unpublished"), F.unix_micros(F.min("published_at")).alias("oldest_published"),
        )
        return [{"name": f"{run}/part={r['part']}"} | {k: r[k] for k in ("first", "last", "rows", "unpublished", "first_unpublished", "oldest_published")} for r in facts.collect()]

    def rows(self) -> DataFrame:
        return self._rows(self.current()[1])

    # ------------------------------------------------------------ changes

    def append(self, rows: DataFrame) -> None:
        """Adds rows as ranges of their own."""
        version, ranges = self.current()
        self._set(version, ranges + self._written(rows))

    def _oldest(self, ranges: list[dict], limit: int) -> list[dict]:
        """Ranges that may have one of the ``limit`` oldest unpublished rows."""
        waiting = sorted((r for r in ranges if r["unpublished"]), key=lambda r: r["first_unpublished"])
        found, n = [], 0
        for r in waiting:
            if n >= limit and r["first_unpublished"] > max(x["last"] for x in found):
                break
            found.append(r)
            n += r["unpublished"]
        return found

    def relay(self, fails: Column, limit: int, error: str = "not reachable", at: Column | None = None) -> dict[str, int]:
        """Relays the oldest ``limit`` unpublished rows in order, up to the first that fails; how many rows are in each state.

        What went out is marked in the table by one change; if that change comes too late, nothing of it is kept.
        """
        version, ranges = self.current()
        own = self._oldest(ranges, limit)
        self.touched = [r["name"] for r in own]
        rows = self._rows(own)
        done = through_table(relay(rows, fails, limit, error, at).select("id", "state", *(F.col(c).alias(f"new_{c}") for c in ("published_at", "failed_attempts", "last_error"))))
        found = {r["state"]: r["count"] for r in done.groupBy("state").count().collect()}
        if found.get("published") or found.get("failed"):
            # as many rows as the limit at most
            changed = rows.join(F.broadcast(done.where("state <> 'waiting'")), "id", "left")
            hit = F.col("state").isNotNull()
            changed = changed.withColumns({c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("published_at", "failed_attempts", "last_error")})
            self._set(version, [r for r in ranges if r not in own] + self._written(changed))
        return found

    def prune(self, now: Column, keep_days: int = KEEP_DAYS) -> int:
        """Drops rows that were published more than ``keep_days`` ago; how many ranges were written anew."""
        version, ranges = self.current()
        cutoff = self.spark.range(1).select(F.unix_micros(now - F.make_dt_interval(F.lit(keep_days)))).first()[0]
        old = [r for r in ranges if r["oldest_published"] is not None and r["oldest_published"] < cutoff]
        self.touched = [r["name"] for r in old]
        if old:
            left = through_table(prune(self._rows(old), now, keep_days))
            self._set(version, [r for r in ranges if r not in old] + ([] if left.isEmpty() else self._written(left)))
        return len(old)
