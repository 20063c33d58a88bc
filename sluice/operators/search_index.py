"""Search of file names by an index of letter trigrams.

Each name is listed under all runs of three letters that it has, lower-cased; lists lie in buckets by
trigram, newest first. A pattern's rarest trigrams name its candidates: only their lists are read, from the
place where the last page ended, and candidates that all of them have are checked on the name itself. So
the rows that are read go with the rarest trigrams, not with the table, and a page costs the same
however many stand before it.

Null names are in no list. A pattern of less than three letters has no trigram; it is looked for in all names.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: How many of a pattern's trigrams, the rarest first, are intersected.
MOST_LISTS = 3


def trigrams(text: Column) -> Column:
    """The distinct runs of three letters of a text, lower-cased."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def of_pattern(pattern: str) -> list[str]:
    low = pattern.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


@dataclass(frozen=True)
class Place:
    """Where a page ended: the next one begins behind it."""

    created_at: datetime
    id: object


class NameIndex:
    """The index at a folder."""

    def __init__(self, folder: str, buckets: int = BUCKETS) -> None:
        self.folder, self.buckets = folder.rstrip("/"), buckets

    def build(self, imports: DataFrame) -> None:
        """Writes the lists of ``imports`` (id, original_filename, created_at) and their lengths; a build replaces the last one."""
        listed = imports.select("id", "created_at", F.explode(trigrams(F.col("original_filename"))).alias("gram"))
        listed = listed.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int"))
        # a trigram that many names have is spread over as many ranges as it fills
        dealt = listed.repartitionByRange("bucket", "gram", F.desc("created_at"), "id").sortWithinPartitions("bucket", "gram", F.desc("created_at"), "id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/lists")
        stored = self._lists(imports.sparkSession, imports)
        stored.groupBy("gram").agg(F.count("*").alias("n")).orderBy("gram").write.mode("overwrite").parquet(f"{self.folder}/lengths")

    def _lists(self, spark: SparkSession, imports: DataFrame) -> DataFrame:
        of = {f.name: f.dataType.simpleString() for f in imports.schema.fields}
        return spark.read.schema(f"id {of['id']}, created_at {of['created_at']}, gram string, bucket int").parquet(f"{self.folder}/lists")

    def rarest(self, spark: SparkSession, pattern: str, most: int = MOST_LISTS) -> list[tuple[str, int]]:
        """The pattern's rarest trigrams and in how many names each is; one that no name has stands first, with 0."""
        grams = of_pattern(pattern)
        lengths = spark.read.schema("gram string, n long").parquet(f"{self.folder}/lengths").where(F.col("gram").isin(*grams))
        known = {r["gram"]: r["n"] for r in lengths.collect()}  # as many rows as the pattern has trigrams at most
        return sorted(((g, known.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))[:most]

    def candidates(self, imports: DataFrame, pattern: str, after: Place | None = None) -> tuple[DataFrame, int]:
        """id and created_at of what all the rarest lists have behind a place, and how many rows these lists have in all."""
        spark = imports.sparkSession
        grams = self.rarest(spark, pattern)
        lists = self._lists(spark, imports)
        # the bucket of a trigram, by Spark's own hash
        buckets = spark.createDataFrame([(g,) for g, _ in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int").alias("b"))
        own = sorted({r["b"] for r in buckets.collect()})
        rows = lists.where(F.col("bucket").isin(*own) & F.col("gram").isin(*(g for g, _ in grams)))
        if after is not None:
            rows = rows.where(behind(after, rows))
        found = rows.groupBy("id", "created_at").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id", "created_at")
        return found, sum(n for _, n in grams)

    def page(self, imports: DataFrame, pattern: str, size: int, after: Place | None = None) -> DataFrame:
        """The next ``size`` imports whose name contains the pattern in any case, newest first, equal times by id."""
        holds = F.contains(F.lower("original_filename"), F.lower(F.lit(pattern)))
        if not of_pattern(pattern):
            found = imports.where(holds) if after is None else imports.where(holds & behind(after, imports))
        elif self.rarest(imports.sparkSession, pattern, 1)[0][1] == 0:
            found = imports.limit(0)
        else:
            found = imports.join(self.candidates(imports, pattern, after)[0], ["id", "created_at"], "left_semi").where(holds)
        return found.orderBy(F.desc("created_at"), "id").limit(size)


def behind(place: Place, rows: DataFrame) -> Column:
    """Whether a row of ``rows`` comes after a place."""
    wall = rows.schema["created_at"].dataType.typeName() == "timestamp_ntz"
    at = F.lit(place.created_at.isoformat()).cast("timestamp_ntz") if wall else F.lit(place.created_at)
    return (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > F.lit(place.id)))


def last_place(page: list) -> Place | None:
    """Where a collected page ended; None where it has no rows."""
    return Place(page[-1]["created_at"], page[-1]["id"]) if page else None
