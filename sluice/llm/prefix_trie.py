"""The trie of rebuilt conversations, by fingerprints that compose.

A sequence of turns has the fingerprint (n, g): its length and g = sum of t_j r^j modulo a prime,
t_j being a hash of turn j. These form a monoid: (n, g) then (m, s) is (n + m, g + r^n s). A
rebuilt conversation is the head of its base followed by a suffix of its own turns, and a
suffix's element comes from two prefixes of the conversation it was cut from. So the fingerprint
of every prefix of every rebuilt conversation is worked out from prefix sums over the turns as they
are stored; rebuilt texts never exist, a row only refers to its turn. Two primes are used.

Equality is verified, not assumed. All turns with one hash must have one role and text (compared
as they are, one copy of each travels), and all members of a prefix group must
refer to one turn hash and one group before it, so equal groups are equal sequences from the
root on. Where two things collide, everything is done again with another seed.

Sums over a subtree need no walk: the smallest member of a node owns it, so each node is counted
along one conversation, and a node's sum is that over its members of what each owns from there on.

Prefix sums run over ordered ranges of rows with offsets from sums per range, so one
conversation may hold any share of the turns. Nodes with many members are told
from others by their share of the rows; there are at most ``HOT_NODES`` of these, which are broadcast.
Ids that end in one node are joined to texts range by range, and only these run
through the one hash that their SHA-256 is.

Turns are ordered by turn (null first), equal ones by role, the first ``HEAD`` characters of the
text, and a hash; rows that repeat wholly count one by one. Null role and text are
empty. Rows without a conv_id belong to no conversation and are left out, as are other
columns. A table without conversations gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.shared import discard, written

#: Conversations share the head of the first one of so many; the head has less than HEADS turns.
FAMILY, HEADS = 20, 4
PRIMES = (2147483647, 2147483629)
HEAD = 64
HOT_NODES = 4096
#: Rows of a range, and bytes of joined ids in a row.
RANGE_ROWS, JOINED_BYTES = 1 << 18, 1 << 20
ATTEMPTS = 4

WORD = "[^\\x20\\x09-\\x0D]+"


def head_length(conv: Column) -> Column:
    """How many turns of the base a conversation begins with."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def power(r: int, n: Column, prime: int) -> Column:
    """r to the n modulo a prime, for n below 2 to the 32, from one table for each byte of n."""
    out = None
    for byte in range(4):
        table = F.expr(f"array({', '.join(f'{pow(r, k << (8 * byte), prime)}L' for k in range(256))})")
        factor = F.element_at(table, (F.shiftright(n, 8 * byte).bitwiseAND(F.lit(255)) + 1).cast("int"))
        out = factor if out is None else (out * factor) % prime
    return out


class Fingerprints:
    """The two hashes of a seed, and their arithmetic on pairs of columns."""

    def __init__(self, seed: int, primes: tuple[int, int] = PRIMES) -> None:
        self.primes = primes
        self.roots = tuple(2 + int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:8]) % (p - 2) for i, p in enumerate(primes))

    def turn(self, t: Column) -> list[Column]:
        """The two values of a turn with hash t."""
        return [F.pmod(part, F.lit(p)) + 1 for part, p in zip((F.shiftrightunsigned(t, 32), t.bitwiseAND(F.lit(0xFFFFFFFF))), self.primes, strict=True)]

    def at(self, n: Column, values: list[Column]) -> list[Column]:
        """Values moved behind n turns."""
        return [(v % p) * power(r, n, p) % p for v, r, p in zip(values, self.roots, self.primes, strict=True)]

    def back(self, n: Column, values: list[Column]) -> list[Column]:
        """Values moved to the front from behind n turns, n below ``HEADS``."""
        inverse = [F.element_at(F.array(*(F.lit(pow(pow(r, k, p), -1, p)) for k in range(HEADS))), (n + 1).cast("int")) for r, p in zip(self.roots, self.primes, strict=True)]
        return [(v % p) * i % p for v, i, p in zip(values, inverse, self.primes, strict=True)]

    def plus(self, a: list[Column], b: list[Column], sign: int = 1) -> list[Column]:
        return [F.pmod(x + sign * y, F.lit(p)) for x, y, p in zip(a, b, self.primes, strict=True)]

    @staticmethod
    def joined(values: list[Column]) -> Column:
        return F.shiftleft(values[0], 31).bitwiseOR(values[1])


def ranges(rows: DataFrame) -> int:
    """How many ordered ranges rows are dealt into."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)


def running(rows: DataFrame, key: str, order: list[str], sums: list[str], n_ranges: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``range`` and running sums of the columns ``sums`` in the order within each key, and key, range, <sum>_all: the key's whole sums.

    Rows are dealt into ordered ranges and written once; offsets come from a row per key and range.
    """
    ranged = written(rows.repartitionByRange(n_ranges, key, *order).withColumn("range", F.spark_partition_id()), "ranged")
    per = Window.partitionBy(key)
    before = per.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(key, "range").agg(*(F.sum(c).alias(c) for c in sums))
    totals = written(totals.select(key, "range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums), *(F.sum(c).over(per).alias(f"{c}_all") for c in sums)), "range-totals")
    within = Window.partitionBy(key, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({c: F.sum(c).over(within) for c in sums}).join(totals.select(key, "range", *(f"{c}_before" for c in sums)), [key, "range"])
    out = out.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in sums}).drop(*(f"{c}_before" for c in sums))
    return out, totals.select(key, "range", *(f"{c}_all" for c in sums))


def hashed_turns(conversations: DataFrame, seed: int, bits: int) -> DataFrame:
    """conv, turn, role, text, head and the turn's hash t."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    t = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "role", "text"), 64 - bits) if bits < 64 else F.xxhash64(F.lit(seed), "role", "text")
    return rows.withColumn("t", t)


def turns_collide(turns: DataFrame) -> bool:
    """Whether two different turns have one hash; a copy of each turn and task is compared."""
    return not turns.select("t", "role", "text").distinct().groupBy("t").count().where("count > 1").isEmpty()


def prefixes(turns: DataFrame, marks: Fingerprints) -> tuple[DataFrame, DataFrame]:
    """conv, range, i, t, words, a, b: the fingerprint of each stored conversation up to turn i; and conv, range, n."""
    rows = turns.select("conv", "turn", "role", F.substring("text", 1, HEAD).alias("head"), "t", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("i"))
    order = ["turn", "role", "head", "t"]
    placed, lengths = running(rows, "conv", order, ["i"], ranges(rows))
    placed = written(placed.select("conv", "range", "i", "t", "words"), "placed")
    a, b = marks.at(F.col("i") - 1, marks.turn(F.col("t")))
    # the same ranges again, now in the order of i
    within = Window.partitionBy("conv", "range").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = placed.withColumns({"a": a, "b": b})
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = valued.groupBy("conv", "range").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    offsets = offsets.select("conv", "range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ab"))
    out = valued.withColumns({c: F.sum(c).over(within) for c in "ab"}).join(offsets, ["conv", "range"])
    out = out.select("conv", "range", "i", "t", "words", *((F.col(c) + F.col(f"{c}0")) % p for c, p in zip("ab", marks.primes, strict=True)))
    return written(out.toDF("conv", "range", "i", "t", "words", "a", "b"), "prefixes"), lengths.withColumnRenamed("i_all", "n")


def rebuilt(stored: DataFrame, lengths: DataFrame, marks: Fingerprints) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation, as conv, depth, length, mark, before, t, words, and conv, length of each.

    mark, before: fingerprints with and without the last turn; t, words: of that turn, read from where it is stored.
    """
    convs = lengths.select("conv", "n").distinct().withColumns({"h": head_length(F.col("conv")), "base": base_of(F.col("conv"))})
    zero = F.lit(0).cast("long")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least(F.col("h").cast("long"), F.coalesce("base_n", zero)))
    heads = stored.where(F.col("i") < HEADS)
    at_k = heads.select(F.col("conv").alias("base"), F.col("i").alias("k"), F.col("a").alias("head_a"), F.col("b").alias("head_b"))
    at_h = heads.select("conv", F.col("i").cast("int").alias("h"), F.col("a").alias("cut_a"), F.col("b").alias("cut_b"))
    convs = convs.join(at_k, ["base", "k"], "left").join(at_h, ["conv", "h"], "left").fillna(0, ["head_a", "head_b", "cut_a", "cut_b"])
    convs = written(convs.withColumn("length", F.col("k") + F.greatest(zero, F.col("n") - F.col("h"))), "conversations")
    first = convs.select("conv", "k", "length", "base").where("k > 0").join(heads.select(F.col("conv").alias("base"), "i", "t", "words", "a", "b"), "base").where("i <= k")
    first = first.select("conv", F.col("i").alias("depth"), "length", "a", "b", "t", "words")
    # a conversation meets its facts range by range, so a long one is spread
    facts = lengths.select("conv", "range").join(convs.select("conv", "h", "k", "length", "head_a", "head_b", "cut_a", "cut_b"), "conv")
    later = stored.join(facts, ["conv", "range"]).where("i > h")
    own = marks.at(F.col("k"), marks.back(F.col("h"), marks.plus([F.col("a"), F.col("b")], [F.col("cut_a"), F.col("cut_b")], -1)))
    both = marks.plus([F.col("head_a"), F.col("head_b")], own)
    later = later.select("conv", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), "length", both[0].alias("a"), both[1].alias("b"), "t", "words")
    every = first.unionByName(later)
    now = [F.col("a"), F.col("b")]
    last = marks.at(F.col("depth") - 1, marks.turn(F.col("t")))
    return every.select("conv", "depth", "length", marks.joined(now).alias("mark"), marks.joined(marks.plus(now, last, -1)).alias("before"), "t", "words"), convs.select("conv", "length")


def with_owner(rows: DataFrame, nodes: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with owner, n_convs and leaf of their nodes; nodes with many rows are broadcast, at most ``HOT_NODES`` of them."""
    facts = nodes.select("depth", "mark", "owner", "n_convs", "leaf")
    many = F.col("n_convs") >= max(2, n_rows // HOT_NODES + 1)
    hot, cold = F.broadcast(facts.where(many)), facts.where(~many)
    on = ["depth", "mark"]
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of one node after the other, in pieces."""
    node, held, size, part = None, [], 0, TaskContext.get().partitionId() << 32
    names = ["depth", "mark", "part", "ids"]

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*node, part, ",".join(held)), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    for batch in batches:
        for depth, mark, conv in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("depth", "mark", "conv")), strict=True):
            if (depth, mark) != node or size > JOINED_BYTES:
                if node is not None:
                    yield piece()
                    part += 1
                node, held, size = (depth, mark), [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
    if node is not None:
        yield piece()


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None
    names = ["depth", "mark", "ends_sha256"]
    for batch in batches:
        out = []
        for depth, mark, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("depth", "mark", "ids")), strict=True):
            if (depth, mark) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (depth, mark), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=names)


def end_hashes(ends: DataFrame, n_ranges: int) -> DataFrame:
    """depth, mark, ends_sha256 of the ids (conv) that end in a node."""
    pieces = ends.repartitionByRange(n_ranges, "depth", "mark", "conv").sortWithinPartitions("depth", "mark", "conv").mapInArrow(_join_ids, "depth long, mark long, part long, ids string")
    pieces = written(pieces, "joined-ids")
    return pieces.repartition("depth", "mark").sortWithinPartitions("depth", "mark", "part").mapInArrow(_hash_pieces, "depth long, mark long, ends_sha256 string")


def trie(conversations: DataFrame, attempts: tuple[tuple[tuple[int, int], int], ...] = ((PRIMES, 64),) * ATTEMPTS) -> DataFrame:
    """A row per node; see the docstring of the query for its columns. attempts: primes and bits of a turn's hash, one try after the other."""
    spark = conversations.sparkSession
    for seed, (primes, bits) in enumerate(attempts):
        marks = Fingerprints(seed, primes)
        turns = hashed_turns(conversations, seed, bits)
        if turns_collide(turns):
            continue
        stored, lengths = prefixes(turns, marks)
        rows, convs = rebuilt(stored, lengths, marks)
        rows = written(rows, "rebuilt")
        nodes = rows.groupBy("depth", "mark").agg(
            F.min("conv").alias("owner"), F.count("*").alias("n_convs"), (F.max("length") == F.col("depth")).alias("leaf"),
            *(f(c).alias(f"{name}_{c}") for c in ("before", "t") for name, f in (("least", F.min), ("most", F.max))),
        )
        nodes = written(nodes, "nodes")
        if nodes.where("least_before <> most_before or least_t <> most_t").isEmpty():
            break
        discard(stored, rows, nodes)
    else:
        raise RuntimeError(f"fingerprints collide under all {len(attempts)} seeds")
    n_rows = rows.count()
    owned = with_owner(rows, nodes, n_rows).withColumn("own", (F.col("owner") == F.col("conv")).cast("long"))
    owned = owned.withColumns({"saved": F.col("own") * (F.col("n_convs") - 1) * F.col("words"), "leaves": F.col("own") * F.col("leaf").cast("long")})
    owned = owned.withColumns({"saved_here": F.col("saved"), "leaves_here": F.col("leaves")}).select("conv", "depth", "length", "mark", "owner", "own", "saved", "leaves", "saved_here", "leaves_here")
    n_ranges = ranges(rows)
    summed, totals = running(owned.withColumn("owns", F.col("own")), "conv", ["depth"], ["saved", "leaves", "owns"], n_ranges)
    summed = summed.join(totals, ["conv", "range"])
    # a conversation owns the nodes of its path from some depth on
    next_own = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 > F.col("length") - F.col("owns_all"))).cast("long")
    summed = written(summed.select(
        "conv", "depth", "length", "mark", "owner", "own", next_own.alias("next_own"),
        *((F.col(f"{c}_all") - F.col(c) + F.col(f"{c}_here")).alias(c) for c in ("saved", "leaves")),
    ), "subtrees")
    per_node = summed.groupBy("depth", "mark").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("next_own").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    top = summed.where("depth = 1").agg(F.sum("own"), F.sum("leaves"), F.sum("saved")).first()
    smallest, members = convs.agg(F.min("conv"), F.count("*")).first()
    # conv_id, depth, mark, n_convs, n_children, n_leaves, saved_tokens; a root without children is a leaf
    root = [(smallest, 0, 0, members, top[0] or 0, top[1] or 1, top[2] or 0)] if members else []
    root = spark.createDataFrame(root, "conv_id long, depth long, mark long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    # where a conversation's own nodes begin, the parent is another's
    joints = summed.where("own = 0 and next_own = 1").select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    below = per_node.join(joints, ["conv_id", "depth"], "left")
    below = below.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(smallest)).otherwise(F.coalesce("parent", "conv_id")).cast("long")).drop("parent")
    every = below.unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = summed.where("depth = length").select("depth", "mark", "conv").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("mark"), "conv"))
    every = every.join(end_hashes(ends, n_ranges), ["depth", "mark"], "left")
    out = written(every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *(F.col(c).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    ), "trie")
    discard(stored, rows, nodes, summed)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per node: conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves
    and saved_tokens (of its subtree), ends_sha256 (of the members that end there)."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _crc32(text: str) -> str:
    """CRC-32 of a decimal number in SQL, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1)))"
    step = "lambda acc, bit: CASE WHEN xor(acc, bit) & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda x: x::BIGINT)), {step}), 4294967295)"


ORACLE = f"""WITH t AS (
        SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS s
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, list(s ORDER BY i) AS own, {_crc32('c::VARCHAR')} % {HEADS} AS h FROM t GROUP BY c),
    q AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS q FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % {FAMILY}),
    p AS (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM q),
    n AS MATERIALIZED (
        SELECT q[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(q) = d)), sha256('')) AS ends_sha256 FROM p GROUP BY ALL),
    w AS MATERIALIZED (
        SELECT n.*, e.conv_id AS parent_conv_id, coalesce((n_convs - 1) * len(regexp_extract_all(k[d].x, '{WORD}')), 0) AS saved,
            (SELECT count(*) FROM n AS m WHERE m.d = n.d + 1 AND m.k[1:n.d] = n.k) AS n_children
        FROM (SELECT *, k[1:d - 1] AS up FROM n) AS n LEFT JOIN (SELECT k AS up, d + 1 AS d, conv_id FROM n) AS e USING (up, d))
    SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, a.ends_sha256
    FROM w AS a JOIN w AS b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY ALL"""
