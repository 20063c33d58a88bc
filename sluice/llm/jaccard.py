"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds its distinct five-word shingles; two documents link when
100 * |intersection| >= 80 * |union|. If that holds, then under *any* total order
of all tokens the two share a token among their first ``n - ceil(0.8 n) + 1``.
The join uses that under three orders. All put rare tokens first, by document
frequency, by its binary length, and by whether it is small, and each breaks ties by a
seeded hash of its own; so tokens that only one document has come first in all of them,
and what two documents share in a prefix is rare.

Frequencies come without a shuffle of (token, document) rows: documents are dealt
into groups, each group sends its sorted distinct tokens to token ranges as packed
arrays, and a token range answers with one count per token in the same order. Counts
are cut at 255 and a class counts once in each group, which changes what is rare but
no order of it from document to document.

1. Each document enters its prefix tokens of all orders, with the orders as bits.
2. Tokens that few documents have in their prefix of an order pair these up; pairs of
   sizes too far apart are left out at once. A pair stays if all three filters let it
   pass. An order in which both have a token that many share counts as passed.
3. Documents that are connected by tokens that more than ``HOT`` have in their prefix of the
   first order (large groups of near copies, boilerplate) aren't paired up. They are cut
   by size, so that only neighbouring sizes meet, and then into parts; a task compares
   two parts, under the same three filters with orders of its own, pair by pair.
4. The sets of the pairs that are left, and only these, travel to where the pairs are
   verified exactly; many small connected groups share a task, large ones are cut.

Texts with equal sets are one class throughout, so groups of copies never become
pairs. Links count one by one (``n_links``), so the work on a group of different near
copies grows with the square of their number. Nothing of the corpus passes through
the driver but counts.

Nulls, empty texts and texts without words have an empty set: they link with
nothing. Repeated rows are members of one class. Other columns are left out; an empty
table gives no rows. Sets are compared by 64-bit shingle hashes; two different
shingles fall together with a chance of about 2^-64. Documents are dealt into groups by
doc_id and length: rows that repeat both meet in one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.graph import components
from sluice.llm.shared import LOWER, blocks, mix, shingle_sets, split_words, text_bounds, written
from sluice.storage import settled

SIMILARITY_PERCENT = 80
#: Bytes of text in one group of documents, tokens in one token range.
GROUP_BYTES = 6 << 20
RANGE_TOKENS = 2_000_000
#: A token that more classes have in their prefix pairs nobody up.
HOT = 32
#: A part of a large group of near copies, or of connected pairs: so many classes and tokens at most, on average.
PART_CLASSES = 300
PART_TOKENS = 400_000
#: Tokens of the small groups that share a task.
TASK_TOKENS = 100_000

_U = np.uint64
_ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344)
ALL_ORDERS = 7


def prefix_length(n: np.ndarray, percent: int = SIMILARITY_PERCENT) -> np.ndarray:
    """How many tokens of a set of n its prefix has."""
    return n - (n * percent + 99) // 100 + 1


def _group_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All sets of a group's texts, end to end, and their bounds."""
    data, bounds = text_bounds(column)
    found, lengths = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for _, _, part, at in blocks(data, bounds):
        tokens, ends = shingle_sets(split_words(LOWER[part], at))
        found.append(tokens)
        lengths.append(np.diff(ends))
    tokens, n = np.concatenate(found), np.concatenate(lengths)
    return tokens, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _classes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(tokens[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=_U).view(np.int64)


def _distinct(tokens: np.ndarray, bounds: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The first document of each class that has tokens."""
    _, first = np.unique(cls, return_index=True)
    first.sort()
    return first[np.diff(bounds)[first] > 0]


def _keys(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of a token that name its range and its place there."""
    return tokens >> _U(32 - bits)


def _per_class(tokens: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, _U), *(tokens[bounds[i] : bounds[i + 1]] for i in rows)])


def _send(bits: int):
    """Of each group: a row for each token range with the tokens that its classes have there.

    A token stands as often as the group's classes have it, up to 255 times.
    """

    def run(table: pa.Table) -> pa.Table:
        tokens, bounds = _group_sets(table.column("text"))
        rows = _distinct(tokens, bounds, _classes(tokens, bounds))
        keys, counts = np.unique(_keys(_per_class(tokens, bounds, rows), bits), return_counts=True)
        ranges = (keys >> _U(32)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]]) if len(ranges) else np.zeros(1, np.int64)
        low, counts = keys.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
        g = table.column("g")[0].as_py()
        cuts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return pa.table({
            "g": pa.array([g] * len(cuts), pa.int64()), "r": pa.array([int(ranges[a]) for a, _ in cuts], pa.int64()),
            "keys": pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()), "n": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary()),
        })

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of each token range: for each group the frequency of each of its tokens, 255 at most."""
    keys = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("n")]).astype(np.int64)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(place, counts, len(distinct)), 255).astype(np.uint8)[place]
    ends = np.cumsum([len(x) for x in keys])
    df = [total[b - len(x) : b].tobytes() for x, b in zip(keys, ends.tolist(), strict=True)]
    return pa.table({"g": table.column("g"), "r": table.column("r"), "df": pa.array(df, pa.binary())})


def _ranked_prefix(tokens: np.ndarray, bounds: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Flags of the tokens in their document's prefix when ordered by (rank, token hash)."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((mix(tokens), rank, doc))
    flag = np.zeros(len(tokens), dtype=bool)
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], n)
    flag[order[place < np.repeat(prefix_length(n), n)]] = True
    return flag


def _prefixes(tokens: np.ndarray, bounds: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that others have too and that stand in a prefix, and in which orders' prefixes, as bits."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    # tokens that nobody else has come first in every order
    room = prefix_length(n) - np.bincount(doc[df < 2], minlength=len(n))
    at = np.flatnonzero((df > 1) & (room[doc] > 0))
    sub, own, freq = doc[at], tokens[at], df[at].astype(np.int64)
    first = np.searchsorted(sub, sub)
    mask = np.zeros(len(at), np.int8)
    ranks = (freq, np.frexp(freq.astype(np.float64))[1], freq > 16)
    for k, (rank, salt) in enumerate(zip(ranks, (0, *_ORDERS), strict=True)):
        order = np.lexsort((mix(own ^ _U(salt)), rank, sub))
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        mask |= ((place - first < room[sub]).astype(np.int8) << k).astype(np.int8)
    return at[mask > 0], mask[mask > 0]


def _meet(bits: int):
    """Of each group, with the answers to it: a row per document; the first of a class that
    shares a prefix token with another document also carries its set and those tokens."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, bounds = _group_sets(docs.column("text"))
        cls = _classes(tokens, bounds)
        n = np.diff(bounds)
        rows = _distinct(tokens, bounds, cls)
        mine = _per_class(tokens, bounds, rows)
        own = np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int64)
        sets: list = [None] * len(n)
        shared, masks, many = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(len(n), np.int64)
        if len(mine):
            keys = _keys(mine, bits)
            order = np.argsort(np.array(answers.column("r")))
            df = np.concatenate([np.frombuffer(answers.column("df")[i].as_py(), np.uint8) for i in order.tolist()])
            df = df[np.searchsorted(np.unique(keys), keys)]
            at, masks = _prefixes(mine, own, df)
            shared = mine[at].view(np.int64)
            many[rows] = np.diff(np.searchsorted(at, own))
            for k in np.flatnonzero(many[rows]).tolist():
                sets[rows[k]] = mine[own[k] : own[k + 1]].tobytes()
        ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(shared), pa.array(masks)], names=["token", "mask"])
        return pa.table({
            "doc_id": docs.column("doc_id"), "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.int64(), mask=n == 0),
            "tokens": pa.array(sets, pa.binary()), "shared": pa.ListArray.from_arrays(pa.array(ends), entries),
        })

    return run


def _pairs(tokens: np.ndarray, bounds: np.ndarray, cross: np.ndarray | None) -> list[tuple[int, int]]:
    """Linked pairs among the sets; ``cross``: flags of one side if only pairs across count."""
    m, n = len(bounds) - 1, np.diff(bounds)
    doc = np.repeat(np.arange(m), n)
    distinct, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    may = (100 * np.minimum.outer(n, n) >= SIMILARITY_PERCENT * np.maximum.outer(n, n)) & np.tri(m, k=-1, dtype=bool)
    if cross is not None:
        may &= cross[:, None] != cross[None, :]
    for rank in (counts[place], *(mix(tokens ^ _U(x)) for x in _ORDERS)):
        take = np.flatnonzero(_ranked_prefix(tokens, bounds, rank))
        take = take[np.argsort(place[take], kind="stable")]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place[take])) + 1, [len(take)]])
        share = np.zeros((m, m), dtype=bool)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                run = doc[take[a:b]]
                share[run[:, None], run] = True
        may &= share
    linked, flag = [], np.zeros(len(distinct), dtype=bool)
    for i in np.flatnonzero(may.any(axis=1)).tolist():
        flag[place[bounds[i] : bounds[i + 1]]] = True
        for j in np.flatnonzero(may[i]).tolist():
            common = int(np.count_nonzero(flag[place[bounds[j] : bounds[j + 1]]]))
            if 100 * common >= SIMILARITY_PERCENT * (int(n[i]) + int(n[j]) - common):
                linked.append((i, j))
        flag[place[bounds[i] : bounds[i + 1]]] = False
    return linked


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their first rows, their copies, all sets end to end, and their bounds."""
    cls, first = np.unique(np.array(table.column("cls")), return_index=True)
    blobs = table.column("tokens")
    sets = [np.frombuffer(blobs[i].as_py(), _U) for i in first.tolist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return cls, first, np.array(table.column("copies"))[first], np.concatenate([np.zeros(0, _U), *sets]), bounds


def _linked(cls: np.ndarray, copies: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    """For each class with links: a link to its root among these, and how many rows it links with."""
    root, links = list(range(len(cls))), np.zeros(len(cls), np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        links[i] += copies[j]
        links[j] += copies[i]
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    out = np.flatnonzero(links > 0)
    return pa.table({"cls": pa.array(cls[out]), "root": pa.array(cls[[find(i) for i in out.tolist()]] if len(out) else cls[:0]), "links": pa.array(links[out])})


def _verify_pairs(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Which of the pairs link."""
    cls, _, copies, tokens, bounds = _sets(sets)
    n, linked = np.diff(bounds), []
    distinct, place = np.unique(tokens, return_inverse=True)
    one, two = (np.searchsorted(cls, np.array(pairs.column(c))) for c in ("a", "b"))
    flag, last = np.zeros(len(distinct), dtype=bool), -1
    for k in np.argsort(one, kind="stable").tolist():
        i, j = int(one[k]), int(two[k])
        if i != last:
            flag[:] = False
            flag[place[bounds[i] : bounds[i + 1]]] = True
            last = i
        common = int(np.count_nonzero(flag[place[bounds[j] : bounds[j + 1]]]))
        if 100 * common >= SIMILARITY_PERCENT * (int(n[i]) + int(n[j]) - common):
            linked.append((i, j))
    return _linked(cls, copies, linked)


def _verify_parts(table: pa.Table) -> pa.Table:
    """Of two parts of a large group, or of one and itself: which classes link."""
    cls, first, copies, tokens, bounds = _sets(table)
    side = np.array(table.column("side"))[first]
    return _linked(cls, copies, _pairs(tokens, bounds, side == 0 if table.column("across")[0].as_py() else None))


def _count(df: DataFrame, what: str) -> int:
    return df.agg(F.coalesce(F.sum(what), F.lit(0)).alias("n")).first()["n"]


def _candidates(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that pass the size filter and all prefix filters, and the label of each class in a large group.

    entries: cls, n, token, mask (the orders in whose prefix it stands). Pairs inside one large group are left out.
    """
    has = lambda mask, k: F.col(mask).bitwiseAND(F.lit(1 << k)) != 0
    bits = lambda of: sum((F.when(of(k), 1 << k).otherwise(0) for k in range(3)), F.lit(0))
    counts = entries.groupBy("token").agg(*(F.count_if(has("mask", k)).alias(f"m{k}") for k in range(3))).where("greatest(m0, m1, m2) > 1")
    counts = counts.select("token", bits(lambda k: F.col(f"m{k}").between(2, HOT)).alias("few"), bits(lambda k: F.col(f"m{k}") > HOT).alias("many"))
    mask = F.col("mask").cast("int")
    placed = written(entries.join(counts, "token").select("cls", "n", "token", mask.bitwiseAND(F.col("few")).alias("few"), mask.bitwiseAND(F.col("many")).alias("many")).where("few + many > 0"), "placed")
    loud = placed.where(has("many", 0)).select("token", "cls")
    heads = loud.groupBy("token").agg(F.min("cls").alias("head"))
    groups = components(loud.join(heads, "token").select(F.col("head").alias("a"), F.col("cls").alias("b")))
    own = written(placed.where("many > 0").groupBy("cls").agg(F.bit_or("many").alias("own")), "own")
    quiet = placed.where("few > 0").join(own, "cls", "left").select("token", "cls", "n", "few", F.coalesce("own", F.lit(0)).alias("own"))
    one, two = (quiet.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("cls", "n", "few", "own"))) for k in (1, 2))
    near = (F.col("cls1") < F.col("cls2")) & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * SIMILARITY_PERCENT)
    met = one.join(two, "token").where(near & (F.col("few1").bitwiseAND(F.col("few2")) != 0))
    met = met.select(F.col("cls1").alias("a"), F.col("cls2").alias("b"), F.col("few1").bitwiseAND(F.col("few2")).bitwiseOR(F.col("own1").bitwiseAND(F.col("own2"))).alias("passed"))
    pairs = written(met.groupBy("a", "b").agg(F.bit_or("passed").alias("passed")).where(F.col("passed") == ALL_ORDERS).select("a", "b"), "pairs")
    left, right = (groups.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in ("a", "b"))
    apart = pairs.join(left, "a", "left").join(right, "b", "left").where("of_a is null or of_b is null or of_a <> of_b")
    return apart.select("a", "b"), groups


def _verified_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """cls, root, links of the classes that link; sets: cls, n, copies, tokens."""
    pairs = written(pairs, "apart")
    labels = components(pairs)
    sizes = written(labels.join(sets.groupBy("cls").agg(F.first("n").alias("n")), F.col("node") == F.col("cls")).groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("t")), "sizes")
    tasks = max(1, -(-_count(sizes, "t") // TASK_TOKENS))
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / PART_CLASSES), F.ceil(F.col("t") / PART_TOKENS)).cast("int")
    # small groups share a task by a hash of their label, large ones have tasks of their own
    small = F.col("parts") == 1
    where = labels.join(sizes.select("label", parts.alias("parts")), "label")
    where = where.select("node", F.when(small, F.pmod(F.xxhash64("label"), F.lit(tasks))).otherwise(F.col("label")).alias("at"), small.alias("small"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    where = written(where, "where")
    dealt = pairs.join(where, pairs.a == where.node).select("a", "b", "at", "small", F.col("part").alias("p"))
    dealt = dealt.join(where.select(F.col("node").alias("b"), F.col("part").alias("q")), "b")
    dealt = written(dealt.select("a", "b", "at", "small", F.least("p", "q").alias("one"), F.greatest("p", "q").alias("two")), "dealt")
    key = ["at", "small", "one", "two"]
    to = [f"to_{c}" for c in key]
    needed = dealt.select(*(F.col(c).alias(t) for c, t in zip(key, to, strict=True)), F.explode(F.array("a", "b")).alias("cls")).distinct()
    brought = sets.join(needed, "cls").select(*to, "cls", "copies", "tokens")
    return dealt.groupBy(*key).cogroup(brought.groupBy(*to)).applyInArrow(_verify_pairs, "cls long, root long, links long")


def _verified_groups(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """cls, root, links of the classes that link inside large groups (node, label); sets: cls, n, copies, tokens."""
    # sizes that may link are in one step or in adjacent ones
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / SIMILARITY_PERCENT)) - 1e-9).cast("int")
    members = written(sets.join(groups, sets.cls == groups.node).select("label", step.alias("step"), "cls", "n", "copies", "tokens"), "members")
    cut = members.groupBy("label", "step").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    cut = cut.select("label", "step", F.greatest(F.lit(1), F.ceil(F.col("m") / PART_CLASSES), F.ceil(F.col("t") / PART_TOKENS)).cast("int").alias("parts"))
    cut = written(cut, "cuts")
    above = cut.select("label", (F.col("step") - 1).alias("step"), F.col("parts").alias("above"))
    below = cut.select("label", (F.col("step") + 1).alias("step"), F.col("parts").alias("below"))
    cut = written(cut.join(above, ["label", "step"], "left").join(below, ["label", "step"], "left"), "steps")
    placed = members.join(cut, ["label", "step"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    here = lambda step, across, one, two, side: F.struct(step.alias("low"), across.alias("across_steps"), one.alias("one"), two.alias("two"), side.alias("side"))
    part, no, yes, zero, first = F.col("part"), F.lit(False), F.lit(True), F.lit(0), F.lit(1)
    within = F.transform(upto("parts"), lambda q: here(F.col("step"), no, F.least(part, q), F.greatest(part, q), F.when(part <= q, zero).otherwise(first)))
    up = F.transform(upto("above"), lambda q: here(F.col("step"), yes, part, q, zero))
    down = F.transform(upto("below"), lambda q: here(F.col("step") - 1, yes, q, part, first))
    met = placed.select("label", "cls", "copies", "tokens", F.explode(F.concat(within, up, down)).alias("x"))
    met = met.select("label", "x.*", "cls", "copies", "tokens").withColumn("across", F.col("across_steps") | (F.col("one") != F.col("two")))
    return met.groupBy("label", "low", "across_steps", "one", "two").applyInArrow(_verify_parts, "cls long, root long, links long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs`` (doc_id, text).

    component_id: the smallest doc_id reachable by links, itself included. n_links:
    how many other rows it links with, copies included. Rows with an empty set have
    their own doc_id as component and no links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, -(-size // GROUP_BYTES))
    bits = max(0, (size // (5 * RANGE_TOKENS)).bit_length())  # a word has some five bytes
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(tasks)))
    answers = (
        dealt.groupBy("g").applyInArrow(_send(bits), "g long, r long, keys binary, n binary")
        .groupBy("r").applyInArrow(_answer, "g long, r long, df binary")
    )
    met = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_meet(bits), "doc_id long, n long, cls long, tokens binary, shared array<struct<token:bigint,mask:tinyint>>")
    met = written(met, "sets")

    entries = met.where(F.size("shared") > 0).select("cls", "n", F.explode("shared").alias("s")).select("cls", "n", "s.token", "s.mask").distinct()
    pairs, groups = _candidates(entries)
    copies = met.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc"))
    copies = written(copies, "classes")
    sets = met.where("tokens is not null").select("cls", "n", "tokens").join(copies.select("cls", "copies"), "cls")
    found = written(_verified_pairs(pairs, sets).unionByName(_verified_groups(groups, sets)), "found")

    labels = components(found.select(F.col("root").alias("a"), F.col("cls").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = copies.join(labels, copies.cls == labels.node, "left").join(links, "cls", "left")
    known = known.select("cls", "doc", "copies", F.coalesce("label", "cls").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = written(known, "known")
    least = known.groupBy("label").agg(F.min("doc").alias("component_id"))
    classes = written(known.join(written(least, "least"), "label").select("cls", "component_id", "links"), "components")
    return (
        met.select("doc_id", "n", "cls").join(classes, "cls", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return settled(spark, lambda: near_duplicates(docs))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
),
s as (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2
),
l as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.k >= 80 * (x.n + y.n - p.k)
),
r(d, c) as (select doc_id, doc_id from w union select r.d, l.b from r join l on l.a = r.c),
g as (select d, min(c) as component_id from r group by d),
m as (select a, count(*) as n_links from l group by a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, g.component_id, cast(coalesce(m.n_links, 0) as bigint) as n_links
from w left join n on n.doc_id = w.doc_id left join g on g.d = w.doc_id left join m on m.a = w.doc_id
"""
