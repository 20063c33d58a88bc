"""Sharding by fixed virtual slots, with a versioned map from slots to shards.

A record's slot is a hash of its doc_id and text among ``SLOTS``. Bytes are summed per slot; a
map gives every slot, largest first, to the shard with the least bytes so far, so
shards come out nearly equal in bytes (the law of this operator is ``bytes``). The map
is a table of versions at a path. A run takes the last version it finds there, or the
one asked for, and makes version 1 where there is no map. A version that isn't there, and
numbers of slots or shards other than the map's, are errors; ``grow`` appends the next
one, in which a new shard takes slots from the fullest ones until it has its share and
every other slot stays where it is. A map has every slot, also those without bytes.

Equal texts (groups of copies) aren't kept together: one group may hold a third of all
rows, and no shard could then be near the others in bytes.

Only sums per slot (``SLOTS`` rows, whatever the input) are gathered in one place, and
the map (as many rows) is what a join broadcasts. Records are numbered inside their
slot and a slot begins where the one before it in its shard ends, so numbering
needs no task that sees a whole shard.

Null text counts 0 bytes and has the checksum of the empty text. Null ids and
repeated rows are hashed like any other value; rows equal in id and text fall into
one slot, and are numbered in any order, which no column tells apart. Other columns are
left out; an empty table gives no rows, and a map in which all slots are empty.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.shared import shared_dir, written

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16
LAW = "bytes"


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    return docs.select("doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32")).withColumn(
        "vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int")
    )


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of each slot; ``slots`` rows."""
    sums = records.groupBy(F.col("vslot").alias("s")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    all_ = records.sparkSession.range(slots, numPartitions=1).select(F.col("id").cast("int").alias("vslot"))
    zero = F.lit(0).cast("long")
    return all_.join(sums, F.col("vslot") == F.col("s"), "left").select("vslot", F.coalesce("rows", zero).alias("rows"), F.coalesce("bytes", zero).alias("bytes"))


def balanced_map(sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """version 1 of the map: (version, vslot, shard), largest slots first to the emptiest shard."""
    empty = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("shard"))

    def give(state: Column, slot: Column) -> Column:
        to = F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1
        # an empty slot counts as one byte, so that these are spread too
        load = F.transform(state["load"], lambda x, i: F.when(i == to, x + F.greatest(slot["bytes"], F.lit(1))).otherwise(x))
        return F.struct(load.alias("load"), F.concat(state["shard"], F.array(to)).alias("shard"))

    # -bytes first: descending by bytes, then ascending by slot
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes")))
    one = sums.agg(order.alias("slots")).withColumn("given", F.aggregate("slots", empty, give))
    pairs = one.select(F.explode(F.arrays_zip(F.col("slots.vslot").alias("vslot"), F.col("given.shard").alias("shard"))).alias("x"))
    return pairs.select(F.lit(1).alias("version"), F.col("x.vslot").alias("vslot"), F.col("x.shard").alias("shard"))


def grown_map(slot_map: DataFrame, sums: DataFrame) -> DataFrame:
    """The next version: one more shard, which takes slots until it has its share of bytes.

    Each old shard gives its smallest slots as far as they fit into the excess over
    the new average; no slot moves between old shards.
    """
    last = slot_map.join(sums, "vslot")
    share = F.sum("bytes").over(Window.partitionBy()) / (F.max("shard").over(Window.partitionBy()) + 2)
    own = Window.partitionBy("shard")
    up = own.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    excess = F.sum("bytes").over(own) - share
    new = F.max("shard").over(Window.partitionBy()) + 1
    return last.select((F.col("version") + 1).alias("version"), "vslot", F.when(F.sum("bytes").over(up) <= excess, new).otherwise(F.col("shard")).cast("int").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version of the map to the table at ``path``."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The last version of the map at ``path``, or the one asked for; None where there is no map. A version that a map hasn't is an error."""
    try:
        versions = spark.read.schema("vslot int, shard int, version int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    known = [r["version"] for r in versions.select("version").distinct().orderBy("version").collect()]
    if version is not None and version not in known:
        raise ValueError(f"the slot map at {path} has versions {known}, not {version}")
    return versions.where(F.col("version") == F.lit(known[-1] if version is None else version))


def map_size(slot_map: DataFrame, slots: int | None = None, shards: int | None = None) -> tuple[int, int]:
    """How many slots and shards a map has; an error if other numbers are asked for."""
    found = slot_map.agg(F.count("*"), F.max("shard") + 1).first()
    for what, asked, has in zip(("slots", "shards"), (slots, shards), found, strict=True):
        if asked is not None and asked != has:
            raise ValueError(f"the slot map has {has} {what}, not {asked}")
    return found[0], found[1]


def grow(docs: DataFrame, map_path: str, slots: int | None = None) -> None:
    """Appends the version after the last one to the map at ``map_path``: one more shard, by the bytes of ``docs``."""
    last = stored_map(docs.sparkSession, map_path)
    if last is None:
        raise ValueError(f"there is no slot map at {map_path}")
    slots, _ = map_size(last, slots)
    sums = written(slot_bytes(with_slots(docs, slots), slots), "slot-bytes")
    store_map(grown_map(last, sums), map_path)


def sharded(docs: DataFrame, shards: int | None = None, slots: int | None = None, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """Every row of ``docs`` with size, text_crc32, law, shard, its place in the shard from 0
    (slot), grown_shard (null under this law) and virtual_slot, by a version of the map at
    ``map_path`` (the last one if None). Without a map there, version 1 is made for ``shards``
    shards (``SHARDS`` if None) of ``slots`` slots (``SLOTS``) and stored; without a path, in a new folder of the shared one."""
    spark = docs.sparkSession
    map_path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    slot_map = stored_map(spark, map_path, version)
    if slot_map is None and version not in (None, 1):
        raise ValueError(f"there is no slot map at {map_path} to have version {version}")
    slots = (slots or SLOTS) if slot_map is None else map_size(slot_map, slots, shards)[0]
    records = with_slots(docs, slots)
    sums = written(slot_bytes(records, slots), "slot-bytes")
    if slot_map is None:
        store_map(balanced_map(sums, shards or SHARDS), map_path)
        slot_map = stored_map(spark, map_path, version)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.join(sums, "vslot").withColumn("begin", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    placed = F.broadcast(placed.select("vslot", "shard", "begin"))  # a row per virtual slot
    within = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    numbered = records.withColumn("nth", F.row_number().over(within)).join(placed, "vslot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("begin") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under version 1 of a new map, and each row's shard under version 2, which has one more (next_shard)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    now = sharded(docs, map_path=path)
    grow(docs, path)
    grown = stored_map(spark, path, 2).select("vslot", F.col("shard").alias("next_shard"))
    return now.join(F.broadcast(grown), F.col("virtual_slot") == F.col("vslot")).drop("vslot")  # a row per virtual slot
