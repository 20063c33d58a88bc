"""Mixing sources to target weights by Sainte-Lague apportionment of token blocks.

Targets: a source's weight is 5, 2 or 1, repeating over sources by code point, null
last; together they share all words. A target stops at ``MOST_TIMES`` the source's
size, and the excess goes to the others by weight until none is above: the water
level is found from running sums over the sources, ordered by cap per weight.

Quotas: all words make blocks of ``BLOCK`` words, given to sources one by one by the
highest quotient target / (2 k + 1). Output shard h gets the seats from h / H to
(h + 1) / H of that sequence, so each shard has integer quotas of its own and they
add up. The seats of a source are counted in closed form near its share; only seats whose
rank could decide are listed.

Selection: a source's documents are laid end to end in a seeded hash order and cut
into blocks, of which a seeded one is the first to be taken; from there on they are
taken one after the other, round and round, until the source's quota of words is full; the last
block of a source is as long as what is left of it, so a source of few words fills its quota too. So the
choice is seeded, nearly all documents are taken whole or not at all, and as many
times as a quota has rounds. The first blocks go to shard 0 up to its quota, the next
ones to shard 1, and so on. What a document contributes is its overlap with the blocks
taken, shard by shard.

Rows are dealt by (source, hash range) with offsets from a prefix sum over the ranges,
so a source that holds a third of all rows is spread like any other. What goes through
one task is a row per source (targets, quotas) and, sorted on disk if need be, the
rows of one hash range, among them all that repeat one doc_id with one size.

Null text and texts without words have size 0 and contribute nothing; a null source is
a source. Repeated rows lie side by side in the order and count one by one. Other
columns are carried along, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.shared import written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK = 32
SHARDS = 8
SEED = 20240229
#: Rows in one of a source's hash ranges, if it had all rows, and the least number of ranges.
RANGE_ROWS, LEAST_RANGES = 1 << 18, 512

WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of words of ``text`` as ``size``."""
    return docs.drop("size").withColumn("size", n_words(F.col("text")))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target of each source of ``sizes`` (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.encode("source", "UTF-8").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_TIMES)
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.encode("source", "UTF-8").asc_nulls_last())
    below, all_ = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # the level if all sources before this one, in the order of cap per weight, stop at their caps
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(below), F.lit(0))
    weights = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    per = per.withColumn("level", left / weights)
    open_ = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_)
    target = F.least(F.col("cap").cast("double"), F.coalesce(open_["level"], F.lit(0.0)) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def quotas(goals: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """source and output shard -> blocks; Sainte-Lague over the whole sequence of seats."""
    all_ = Window.partitionBy()
    goals = goals.where("target > 0")
    goals = goals.withColumn("total", F.sum("target").over(all_)).withColumn("n", F.count("*").over(all_))
    parts = goals.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    parts = parts.withColumn("seats", F.round(F.round(F.col("total") / block) * F.col("h") / shards).cast("long"))
    exact = F.col("target") / F.col("total") * F.col("seats")
    # rounding all shares moves the divisor by at most n / 2 seats in all, this source's part of which is its share
    reach = (F.ceil(F.col("target") / F.col("total") * F.col("n")) + 2).cast("long")
    parts = parts.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(exact) - reach)).withColumn("most", F.floor(exact) + reach)
    near = parts.select("h", "seats", "source", "target", "sure", F.explode(F.sequence("sure", "most")).alias("k"))
    sure = parts.groupBy("h").agg(F.sum("sure").alias("given"))
    ranked = near.join(sure, "h").withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.encode("source", "UTF-8").asc_nulls_last(), "k")))
    upto = ranked.groupBy("h", "source").agg((F.first("sure") + F.count(F.when(F.col("place") <= F.col("seats") - F.col("given"), 1))).alias("upto"))
    per = Window.partitionBy("source").orderBy("h")
    upto = upto.withColumn("quota", F.col("upto") - F.coalesce(F.lag("upto").over(per), F.lit(0)))
    return upto.where("h > 0").select("source", (F.col("h") - 1).alias("shard"), "quota")


def selection(goals: DataFrame, quota: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per source: source_size, target, first (the word from which on they are taken), and upto: how many
    words the shards before each shard take, and all of them."""
    each = quota.groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    out = goals.join(each, goals.source.eqNullSafe(each.s), "left").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long"))
    upto = F.transform(
        F.sequence(F.lit(0), F.lit(shards)),
        lambda h: F.aggregate(F.filter("q", lambda x: x["shard"] < h), F.lit(0).cast("long"), lambda n, x: n + x["quota"]),
    )
    upto = F.coalesce(upto, F.array_repeat(F.lit(0).cast("long"), shards + 1))
    out = out.withColumn("upto", F.transform(upto, lambda n: F.least(F.coalesce(n, F.lit(0)) * block, F.col("source_size") * MOST_TIMES)))
    first = F.pmod(F.xxhash64(F.lit(seed), "source"), F.col("blocks")) * block
    return out.select("source", "source_size", "target", first.alias("first"), "upto")


def taken_parts(begin: Column, size: Column, all_: Column, cut: Column, upto: Column, shards: int = SHARDS) -> Column:
    """The word spans of a row that each shard takes: array of (shard, from, to).

    begin: words before the row in its source; all_: those of the source; cut and upto: ``first`` and ``upto`` of ``selection``.
    """
    # words by their place in the order of taking; the first word may cut the row in two
    ahead = F.struct(F.greatest(begin, cut).alias("at"), (begin + size).alias("to"), (-cut).alias("move"))
    behind = F.struct(begin.alias("at"), F.least(begin + size, cut).alias("to"), (all_ - cut).alias("move"))
    runs = F.filter(F.array(ahead, behind), lambda x: x["to"] > x["at"])

    def part(run: Column, times: int, shard: int) -> Column:
        move = run["move"] + all_ * times
        low, high = F.greatest(run["at"] + move, upto[shard]), F.least(run["to"] + move, upto[shard + 1])
        return F.struct(F.lit(shard).alias("shard"), (low - move - begin).alias("from"), (high - move - begin).alias("to"))

    every = F.transform(runs, lambda run: F.array(*(part(run, times, shard) for times in range(MOST_TIMES) for shard in range(shards))))
    return F.filter(F.flatten(every), lambda x: x["to"] > x["from"])


def mixed(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size and others; see ``sized``) and source_size, target, parts, taken.

    parts: the row's word spans that go to each output shard, a span as often as it is
    taken; taken: words in all. Columns of these names are replaced. ``docs`` is read twice.
    """
    docs = docs.drop("source_size", "target", "parts", "taken")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = rows.select("doc", "doc.source", "doc.size", F.xxhash64(F.lit(seed), "doc.doc_id", "doc.size").alias("place"))
    ranges = max(LEAST_RANGES, 1 << (docs.count() // RANGE_ROWS).bit_length())
    rows = rows.withColumn("range", F.shiftrightunsigned("place", 64 - ranges.bit_length() + 1).cast("int"))
    sums = written(rows.groupBy("source", "range").agg(F.sum("size").alias("size")), "range-sizes")
    goals = written(targets(sums), "targets")
    picked = written(selection(goals, quotas(goals, block, shards), block, shards, seed), "selection")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    keys = written(offsets.join(picked, F.col("s").eqNullSafe(F.col("source"))).drop("source"), "offsets")
    within = Window.partitionBy("source", "range").orderBy("place", "doc.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    laid = laid.join(keys, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    laid = laid.withColumn("begin", F.col("before") + F.col("inside"))
    laid = laid.withColumn("parts", taken_parts(*map(F.col, ("begin", "size", "source_size", "first", "upto")), shards=shards))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return laid.select("doc.*", "source_size", "target", "parts", taken.alias("taken"))


def materialised(mix: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the mix itself, as ``columns`` of ``mix`` and shard: a row for each of its parts, with the part's words."""
    parts = mix.select(*columns, F.col("size").alias("_size"), F.explode("parts").alias("_part"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    some = F.array_join(F.slice(words, F.col("_part.from").cast("int") + 1, (F.col("_part.to") - F.col("_part.from")).cast("int")), " ")
    whole = (F.col("_part.from") == 0) & (F.col("_part.to") == F.col("_size"))
    return parts.withColumn("text", F.when(whole, F.col("text")).otherwise(some)).select(*columns, F.col("_part.shard").alias("shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "size")
    out = mixed(written(docs, "sizes"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "parts")
