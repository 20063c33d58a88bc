"""Nearest neighbours by a hierarchical navigable small-world graph per shard.

Rows are dealt to shards of about ``SHARD_ROWS``, fewer where vectors are long: a shard's
vectors have ``SHARD_BYTES`` in double precision. A shard's graph is kept as flat
arrays: vectors, the level of each node, ``LINKS`` neighbours of each node per level
(twice as many on the lowest), -1 where there are fewer. Equal vectors of a shard are
one node, so that a common vector can't fill every neighbour list.

Nodes have a seeded random order and level and are inserted in that order, ``BATCH`` at
a time: all nodes of a batch walk down from the top node side by side, search each of
their levels for the ``BUILD_WIDTH`` nearest, see the earlier nodes of their own batch
too, and are linked, both ways, to those that are no closer to a chosen one than to
them. A neighbour list that runs full is cut by the same rule.

A search walks down the same way and keeps the ``SEARCH_WIDTH`` best on the lowest level;
those get their distance in double precision. Every query meets every shard: one
shuffle brings a shard's graph and then the queries, so a task reads a graph once and
the queries stream past it. The results of the shards are merged by (distance, vec_id).

Vectors that are null, zero, of another length than most, or that hold a null or a
non-finite component take no part, nor do rows with a null vec_id. Rows that repeat
a vec_id are candidates one by one, and one query, by the smallest vector. Other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.shared import written

SHARD_ROWS, SHARD_BYTES = 1 << 17, 64 << 20
LINKS = 32
#: Room in a list of neighbours while the graph is built, beyond what is kept.
SLACK = 16
BATCH = 256
BUILD_WIDTH = 64
SEARCH_WIDTH = 320
NEAREST = 10
QUERY_EVERY = 100
#: Of a full list so many nearest are looked at when it is cut.
MOST_CANDIDATES = 96

GRAPH = {"dim": "int", "wide": "boolean", "ids": "binary", "id_ends": "binary", "vectors": "binary", "levels": "binary", "links": "binary", "entry": "int"}


def _apart(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances between x[nodes] and the rows of q."""
    d = x[nodes] - q
    return np.einsum("ij,ij->i", d, d)


def chosen(x: np.ndarray, own: np.ndarray, near: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1 for none) those that are no closer to a chosen one than to the row's own
    vector, nearest first; filled up with the nearest others to ``most``."""
    keep = min(near.shape[1], MOST_CANDIDATES)
    order = np.argsort(distance, axis=1, kind="stable")[:, :keep]
    near, distance = np.take_along_axis(near, order, 1), np.take_along_axis(distance, order, 1)
    v = x[near] - own[:, None, :]
    sq = np.einsum("ijk,ijk->ij", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    picked, covered = np.zeros(near.shape, dtype=bool), ~np.isfinite(distance)
    for i in range(keep):
        new = ~covered[:, i]
        picked[:, i] = new
        covered |= new[:, None] & (between[:, i, :] < distance)
    order = np.argsort(~picked, axis=1, kind="stable")[:, :most]
    out = np.where(np.isfinite(np.take_along_axis(distance, order, 1)), np.take_along_axis(near, order, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)


class Level:
    """Neighbours of the nodes on one level: ``table[place[node]]``, -1 where there are fewer."""

    def __init__(self, nodes: np.ndarray, n: int, table: np.ndarray) -> None:
        self.nodes, self.table = nodes, table
        self.place = np.full(n, -1, np.int32)
        self.place[nodes] = np.arange(len(nodes), dtype=np.int32)

    def search(self, x: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found from ``start`` for each row of q, nearest first, and their squared distances."""
        rows = np.arange(len(q))
        ids, d = np.full((len(q), width), -1, np.int32), np.full((len(q), width), np.inf, x.dtype)
        ids[:, 0], d[:, 0] = start, _apart(x, start, q)
        seen = np.zeros((len(q), len(x)), dtype=bool)
        seen[rows, start] = True
        open_ = ids >= 0
        while True:
            left = np.where(open_, d, np.inf)
            at = left.argmin(axis=1)
            live = np.flatnonzero(np.isfinite(left[rows, at]))
            if not len(live):
                order = np.argsort(d, axis=1, kind="stable")
                return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            open_[live, at[live]] = False
            near = self.table[self.place[ids[live, at[live]]]]
            r, c = np.nonzero((near >= 0) & ~seen[live[:, None], near])
            if not len(r):
                continue
            found, row = near[r, c], live[r]
            seen[row, found] = True
            distance = _apart(x, found, q[row])
            good = distance < d.max(axis=1)[row]
            r, found, distance = r[good], found[good], distance[good]
            if not len(r):
                continue
            # the new ones stand beside the kept ones, and the best of both stay
            some, first, n = np.unique(r, return_index=True, return_counts=True)
            k = np.arange(len(r)) - np.repeat(first, n)
            more, more_d = np.full((len(some), int(n.max())), -1, np.int32), np.full((len(some), int(n.max())), np.inf, x.dtype)
            slot = np.repeat(np.arange(len(some)), n)
            more[slot, k], more_d[slot, k] = found, distance
            to = live[some]
            all_ids, all_d = np.concatenate([ids[to], more], axis=1), np.concatenate([d[to], more_d], axis=1)
            all_open = np.concatenate([open_[to], more >= 0], axis=1)
            best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            ids[to], d[to], open_[to] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_d, all_open))


class Graph:
    """A graph over the rows of ``x``, and the ids of its nodes."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, tables: list[np.ndarray], entry: int) -> None:
        self.x, self.levels, self.entry = x, levels, entry
        self.layers = [Level(np.flatnonzero(levels >= k), len(x), t) for k, t in enumerate(tables)]

    def search(self, q: np.ndarray, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes found for each row of q, nearest first; -1 where there are fewer."""
        now = np.full(len(q), self.entry, np.int32)
        for layer in self.layers[:0:-1]:
            now = layer.search(self.x, q, now, 1)[0][:, 0]
        return self.layers[0].search(self.x, q, now, width)


def width_of(level: int, links: int) -> int:
    return links * 2 if level == 0 else links


def _link_back(x: np.ndarray, layer: Level, filled: np.ndarray, new: np.ndarray, links: np.ndarray, most: int) -> None:
    """Enters the new nodes into the lists of those they are linked to; full lists are cut."""
    r, c = np.nonzero(links >= 0)
    to, of = layer.place[links[r, c]], new[r]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    some, first, n = np.unique(to, return_index=True, return_counts=True)
    room = layer.table.shape[1]
    fits = filled[some] + n <= room
    k = filled[to] + np.arange(len(to)) - np.repeat(first, n)
    take = np.repeat(fits, n)
    layer.table[to[take], k[take]] = of[take]
    filled[some[fits]] += n[fits].astype(filled.dtype)
    full = np.flatnonzero(~fits)
    full = full[np.argsort(n[full], kind="stable")]
    for a in range(0, len(full), BATCH):
        part = full[a : a + BATCH]
        near = np.full((len(part), room + int(n[part].max())), -1, np.int32)
        near[:, :room] = layer.table[some[part]]
        for i, p in enumerate(part.tolist()):
            near[i, room : room + n[p]] = of[first[p] : first[p] + n[p]]
        layer.table[some[part]] = _cut(x, layer.nodes[some[part]], near, most, room)
        filled[some[part]] = (layer.table[some[part]] >= 0).sum(axis=1)


def _cut(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int, room: int) -> np.ndarray:
    r, c = np.nonzero(near >= 0)
    distance = np.full(near.shape, np.inf, x.dtype)
    distance[r, c] = _apart(x, near[r, c], x[nodes[r]])
    return np.pad(chosen(x, x[nodes], near, distance, most), ((0, 0), (0, room - most)), constant_values=-1)


def build(x: np.ndarray, links: int = LINKS, seed: int = 5) -> Graph:
    """The graph over the rows of ``x`` (one at least)."""
    n, draw = len(x), np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - draw.random(n)) / np.log(links)).astype(np.int64), 12).astype(np.int8)
    order = draw.permutation(n).astype(np.int32)
    entry = int(levels.argmax())
    order = order[order != entry]
    tables = [np.full((int((levels >= k).sum()), width_of(k, links) + SLACK), -1, np.int32) for k in range(int(levels.max()) + 1)]
    graph = Graph(x, levels, tables, entry)
    filled = [np.zeros(len(t), np.int32) for t in tables]
    for a in range(0, len(order), BATCH):
        new = order[a : a + BATCH]
        now = np.full(len(new), entry, np.int32)
        for k in range(len(tables) - 1, -1, -1):
            layer, here = graph.layers[k], np.flatnonzero(levels[new] >= k)
            above = np.flatnonzero(levels[new] < k)
            if len(above):
                now[above] = layer.search(x, x[new[above]], now[above], 1)[0][:, 0]
            if not len(here):
                continue
            own = new[here]
            near, distance = layer.search(x, x[own], now[here], BUILD_WIDTH)
            now[here] = near[:, 0]
            # earlier nodes of the batch
            v = x[own] - x[own[:1]]
            sq = np.einsum("ij,ij->i", v, v)
            beside = np.maximum(sq[:, None] + sq[None, :] - 2 * v @ v.T, 0)
            beside[np.triu_indices(len(own))] = np.inf
            few = min(BUILD_WIDTH, len(own))
            best = np.argpartition(beside, few - 1, axis=1)[:, :few]
            near, distance = np.concatenate([near, own[best]], axis=1), np.concatenate([distance, np.take_along_axis(beside, best, 1)], axis=1)
            picked = chosen(x, x[own], near, distance, links)
            at = layer.place[own]
            layer.table[at, :links] = picked
            filled[k][at] = (picked >= 0).sum(axis=1)
            _link_back(x, layer, filled[k], own, picked, width_of(k, links))
    for k, layer in enumerate(graph.layers):
        most = width_of(k, links)
        over = np.flatnonzero(filled[k] > most)
        for a in range(0, len(over), BATCH):
            part = over[a : a + BATCH]
            layer.table[part] = _cut(x, layer.nodes[part], layer.table[part], most, layer.table.shape[1])
        layer.table = np.ascontiguousarray(layer.table[:, :most])
    return graph


class Shard:
    """A graph with the ids of its nodes, as a row of flat arrays."""

    def __init__(self, graph: Graph, ids: np.ndarray, id_ends: np.ndarray) -> None:
        self.graph, self.ids, self.id_ends = graph, ids, id_ends

    @staticmethod
    def of(x: np.ndarray, ids: np.ndarray) -> Shard:
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, node.ravel()))
        ends = np.cumsum(np.bincount(node.ravel(), minlength=len(distinct)))
        narrow = distinct.astype(np.float32)
        return Shard(build(narrow if (narrow == distinct).all() else distinct), ids[order].astype(np.int64), ends.astype(np.int64))

    def row(self) -> dict:
        g = self.graph
        links = np.concatenate([layer.table.ravel() for layer in g.layers])
        blobs = {"ids": self.ids, "id_ends": self.id_ends, "vectors": g.x, "levels": g.levels, "links": links}
        return {"dim": g.x.shape[1], "wide": g.x.dtype == np.float64, "entry": g.entry} | {k: v.tobytes() for k, v in blobs.items()}

    @staticmethod
    def read(row: dict) -> Shard:
        x = np.frombuffer(row["vectors"], np.float64 if row["wide"] else np.float32).reshape(-1, row["dim"])
        levels, links = np.frombuffer(row["levels"], np.int8), np.frombuffer(row["links"], np.int32)
        at, tables = 0, []
        for k in range(int(levels.max()) + 1):
            size = int((levels >= k).sum()) * width_of(k, LINKS)
            tables.append(links[at : at + size].reshape(-1, width_of(k, LINKS)))
            at += size
        return Shard(Graph(x, levels, tables, row["entry"]), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64))

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list[int], list[float], list[int]]:
        """query_id, distance, vec_id of the k nearest rows found for each query, without its own; ties to smaller ids."""
        out: list[tuple[int, float, int]] = []
        for a in range(0, len(q), BATCH):
            part = q[a : a + BATCH]
            found, _ = self.graph.search(part.astype(self.graph.x.dtype), max(SEARCH_WIDTH, k + 1))
            r, c = np.nonzero(found >= 0)
            distance = np.full(found.shape, np.inf)
            distance[r, c] = np.sqrt(_apart(self.graph.x, found[r, c], part[r]))
            for i, query in enumerate(query_ids[a : a + BATCH].tolist()):
                near: list[tuple[float, int]] = []
                for j in np.argsort(distance[i], kind="stable").tolist():
                    score, node = float(distance[i, j]), int(found[i, j])
                    if node < 0 or len(near) >= k and score > near[k - 1][0]:
                        break
                    ids = self.ids[self.id_ends[node - 1] if node else 0 : self.id_ends[node]]
                    near += [(score, x) for x in ids[ids != query][:k].tolist()]
                    near.sort()
                out += [(query, *x) for x in near[:k]]
        return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _index(dim: int):
    def run(table: pa.Table) -> pa.Table:
        row = Shard.of(_matrix(table.column("v"), dim), np.asarray(table.column("vec_id")).astype(np.int64)).row()
        kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        return pa.table({"shard": table.column("shard")[:1]} | {k: pa.array([row[k]], kinds[t]) for k, t in GRAPH.items()})

    return run


def _search(k: int):
    """Over rows sorted by shard, in each the graph before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            graphs = np.flatnonzero(~np.asarray(column("asked").to_numpy(zero_copy_only=False), dtype=bool))
            first = 0
            for g in [*graphs.tolist(), batch.num_rows]:
                if g > first and shard is not None:
                    ids = np.asarray(column("query_id").slice(first, g - first)).astype(np.int64)
                    found = shard.nearest(ids, _matrix(column("v").slice(first, g - first), shard.graph.x.shape[1]), k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "score", "vec_id"])
                if g < batch.num_rows:
                    shard = Shard.read({name: column(name)[g].as_py() for name in GRAPH})
                first = g + 1

    return run


def usable(vectors: DataFrame, dim: int) -> Column:
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.col("vec_id").isNotNull() & (F.size("v") == dim) & finite & F.exists("v", lambda c: c != 0)


def shard_size(dim: int, shard_rows: int = SHARD_ROWS) -> int:
    """Rows of a shard whose vectors have ``dim`` components."""
    return max(1, min(shard_rows, SHARD_BYTES // (8 * dim)))


def build_index(vectors: DataFrame, dim: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The graphs of usable ``vectors`` (vec_id, v), a row per shard, and the number of shards.

    The input partition is part of what deals rows, so that a vec_id that many rows repeat is spread.
    """
    shards = max(1, -(-vectors.count() // shard_size(dim, shard_rows)))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(_index(dim), "shard int, " + ", ".join(f"{k} {t}" for k, t in GRAPH.items())), "graphs"), shards


def nearest(rows: DataFrame, is_query: Column, k: int = NEAREST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``rows``
    (vec_id, embedding) that ``is_query`` (on vec_id) holds for."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = rows.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes and sizes["dim"] > 0 else 1
    good = rows.where(usable(rows, dim))
    graphs, shards = build_index(good, dim, shard_rows)
    asked = written(good.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asked", F.lit(True))
    both = graphs.withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    found = both.repartition("shard").sortWithinPartitions("shard", "asked").mapInArrow(_search(k), "query_id long, score double, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)
