"""Exact k-means on integer vectors with heap-ordered bounds.

A vector's gap is a lower bound of its distance to the second nearest centroid less an upper
bound of that to its own. When centroids move, the gap of every vector of cluster a
shrinks by at most the way of centroid a plus the longest way of another one. So each
cluster keeps this drift as one running sum, and a heap of its vectors keyed by gap plus the
sum at the time of entry: while a key is above today's sum, its vector can't have changed
its cluster, nor have those below it in the heap. What expires is popped, measured
against all centroids exactly, in integers, and pushed onto the heap of its cluster again.

Vectors lie in shards of at most ``SHARD_ROWS``, written once as flat arrays, and heaps are
flat arrays in a narrow table of one row per shard. Both tables are bucketed by shard,
so a round reads them side by side, moves no vector and writes narrow rows alone. Of a
shard's heaps only the expired part and the ways to it are touched: expired entries
are the top of a heap, found level by level, and the heap order is restored from the
deepest place that changed upwards. Sums per cluster are kept by changes. The driver
gathers k centroids and counts a round, whatever the input.

Kept are vectors of exactly ``DIMENSIONS`` components, none null, NaN or infinite; others
(null and empty ones, too) are left out. Components become floor(1024 x). A kept component beyond
``LARGEST`` has no squared distance in a long, and is an error. Equal distances go to the smaller
number. Repeated rows count one by one, and take places among the first centroids one by
one; a null vec_id comes last there. With fewer than k kept vectors there are as many
clusters. Other columns are left out; a table without kept vectors gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import bucketed, discard, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: A seed that stands before ids when the first centroids are drawn.
SEED = 3
SHARD_ROWS = 1 << 15
#: Squared distances of vectors within this range are longs.
LARGEST = 1 << 27
#: Of float bounds; far above their rounding.
SLACK = 1e-9

SHARD_SCHEMA = "shard long, n int, ids binary, no_id binary, vectors binary"
STATE_SCHEMA = "shard long, cluster binary, keys binary, members binary, heap_sizes array<int>, totals array<long>, rescanned long"

# ---------------------------------------------------------------- heaps in flat arrays


def expired(keys: np.ndarray, bound: float) -> np.ndarray:
    """Places of the heap whose keys are at most ``bound``; they are its top, so nothing else is looked at."""
    found, level = [np.zeros(0, np.int64)], np.zeros(min(1, len(keys)), np.int64)
    while len(level):
        level = level[keys[level] <= bound]
        found.append(level)
        level = np.concatenate([2 * level + 1, 2 * level + 2])
        level = level[level < len(keys)]
    return np.concatenate(found)


def _sift(keys: np.ndarray, members: np.ndarray, at: np.ndarray) -> None:
    """Moves entries at places of one level down to where they belong."""
    while True:
        at = at[2 * at + 1 < len(keys)]
        if not len(at):
            return
        left = 2 * at + 1
        right = np.minimum(left + 1, len(keys) - 1)
        child = np.where(keys[right] < keys[left], right, left)
        lower = keys[child] < keys[at]
        at, child = at[lower], child[lower]
        for x in (keys, members):
            x[at], x[child] = x[child], x[at]
        at = child


def restored(keys: np.ndarray, members: np.ndarray, changed: np.ndarray) -> None:
    """Restores the order of a heap in which only the entries at ``changed`` are out of place."""
    level_of = lambda at: np.frexp(at + 1.0)[1] - 1
    changed = np.unique(changed)
    levels = level_of(changed)
    up = np.zeros(0, np.int64)
    for level in range(int(levels.max()) if len(levels) else -1, -1, -1):
        at = np.union1d(changed[levels == level], up)
        _sift(keys, members, at)
        up = np.unique((at[at > 0] - 1) // 2)


def exchanged(keys: np.ndarray, members: np.ndarray, gone: np.ndarray, new_keys: np.ndarray, new_members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The heap without the entries at ``gone`` and with new ones."""
    size = len(keys) - len(gone) + len(new_keys)
    keys, members = np.concatenate([keys, new_keys]), np.concatenate([members, new_members])
    holes = np.sort(gone[gone < size])
    tail = np.ones(len(keys) - size, dtype=bool)
    tail[gone[gone >= size] - size] = False
    movers = size + np.flatnonzero(tail)
    keys[holes], members[holes] = keys[movers], members[movers]
    keys, members = keys[:size].copy(), members[:size].copy()
    added = np.arange(len(keys) - max(0, len(new_keys) - len(gone)), len(keys))
    restored(keys, members, np.concatenate([holes, added]))
    return keys, members


# ---------------------------------------------------------------- a shard in a round


@dataclass
class Model:
    """Centroids as integers, and the drift that each cluster has gathered."""

    centroids: np.ndarray
    drift: np.ndarray

    def moved(self, centroids: np.ndarray) -> Model:
        way = [math.sqrt(sum(x * x for x in (a - b).tolist())) * (1 + SLACK) for a, b in zip(centroids, self.centroids, strict=True)]
        other = [max([w for j, w in enumerate(way) if j != a], default=0.0) for a in range(len(way))]
        return Model(centroids, self.drift + np.array(way) + np.array(other))


def squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", away, away)


def nearest(vectors: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, exactly, and its key in the heap."""
    every = np.stack([squares(vectors, c) for c in model.centroids], axis=1)
    own = every.argmin(axis=1)  # the smaller number of equal ones
    rows = np.arange(len(own))
    first = np.sqrt(every[rows, own].astype(np.float64))
    if every.shape[1] == 1:
        return own, np.full(len(own), np.inf)
    every[rows, own] = np.iinfo(np.int64).max
    second = np.sqrt(every.min(axis=1).astype(np.float64))
    drift = model.drift[own]
    return own, second - first + drift - SLACK * (1 + first + second + drift)


def _sums(vectors: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """k x (DIMENSIONS + 1): sums of components, and counts."""
    out = np.zeros((k, DIMENSIONS + 1), np.int64)
    for j in range(k):
        own = vectors[cluster == j]
        out[j, :-1], out[j, -1] = own.sum(axis=0, dtype=np.int64), len(own)
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _array(batch: pa.RecordBatch, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(_column(batch, name)[row].as_buffer(), kind)


def _vectors(batch: pa.RecordBatch, row: int) -> np.ndarray:
    return _array(batch, "vectors", row, np.int32).reshape(-1, DIMENSIONS)


def _state(shard: int, cluster: np.ndarray, heaps: list, totals: np.ndarray, rescanned: int) -> pa.RecordBatch:
    columns = {
        "shard": pa.array([shard]), "cluster": pa.array([cluster.astype(np.uint8).tobytes()], pa.binary()), "keys": pa.array([np.concatenate([h[0] for h in heaps]).tobytes()], pa.binary()),
        "members": pa.array([np.concatenate([h[1] for h in heaps]).astype(np.int32).tobytes()], pa.binary()), "heap_sizes": pa.array([[len(h[0]) for h in heaps]], pa.list_(pa.int32())),
        "totals": pa.array([totals.ravel().tolist()], pa.list_(pa.int64())), "rescanned": pa.array([rescanned]),
    }
    return pa.RecordBatch.from_pydict(columns)


def _begin(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                vectors, k = _vectors(batch, row), len(model.centroids)
                cluster, keys = nearest(vectors, model)
                heaps = []
                for j in range(k):
                    members = np.flatnonzero(cluster == j)
                    members = members[np.argsort(keys[members], kind="stable")]  # ascending keys are a heap
                    heaps.append((keys[members], members))
                yield _state(_column(batch, "shard")[row].as_py(), cluster, heaps, _sums(vectors, cluster, k), len(vectors))

    return run


def _round(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.centroids)
        for batch in batches:
            for row in range(batch.num_rows):
                vectors, cluster = _vectors(batch, row), _array(batch, "cluster", row, np.uint8).astype(np.int64)
                ends = np.cumsum(_column(batch, "heap_sizes")[row].as_py())[:-1]
                heaps = list(zip(np.split(_array(batch, "keys", row, np.float64), ends), np.split(_array(batch, "members", row, np.int32), ends), strict=True))
                totals = np.array(_column(batch, "totals")[row].as_py(), np.int64).reshape(k, -1)
                gone = [expired(keys, drift) for (keys, _), drift in zip(heaps, model.drift.tolist(), strict=True)]
                popped = np.concatenate([members[at] for (_, members), at in zip(heaps, gone, strict=True)]).astype(np.int64)
                own, keys = nearest(vectors[popped], model)
                new = [own == j for j in range(k)]
                heaps = [exchanged(*heap, at, keys[to], popped[to].astype(np.int32)) if len(at) or to.any() else heap for heap, at, to in zip(heaps, gone, new, strict=True)]
                changed = own != cluster[popped]
                moved = vectors[popped[changed]]
                totals = totals + _sums(moved, own[changed], k) - _sums(moved, cluster[popped[changed]], k)
                cluster[popped] = own
                yield _state(_column(batch, "shard")[row].as_py(), cluster, heaps, totals, len(popped))

    return run


def _finish(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                vectors, cluster = _vectors(batch, row), _array(batch, "cluster", row, np.uint8)
                distance = np.zeros(len(vectors), np.int64)
                for j, c in enumerate(model.centroids):
                    distance[cluster == j] = squares(vectors[cluster == j], c)
                ids = pa.array(_array(batch, "ids", row, np.int64), mask=_array(batch, "no_id", row, np.bool_))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


# ---------------------------------------------------------------- the operator


def _to_shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, size = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            ids, none, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
            columns = {"shard": pa.array([shard]), "n": pa.array([len(ids)], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in (("ids", ids), ("no_id", none), ("vectors", vectors))}
            return pa.RecordBatch.from_pydict(columns)

        for whole in batches:
            for first in range(0, whole.num_rows, most):
                batch = whole.slice(first, most)
                ids = _column(batch, "vec_id")
                scaled = np.floor(SCALE * _column(batch, "embedding").flatten().to_numpy(zero_copy_only=False)).reshape(-1, DIMENSIONS)
                if len(scaled) and np.abs(scaled).max() > LARGEST:
                    raise ValueError(f"a component beyond {LARGEST // SCALE} has no squared distance in 64 bits")
                parts.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), scaled.astype(np.int32)))
                size += len(scaled)
                if size >= most:
                    yield made()
                    shard, parts, size = shard + 1, [], 0
        if size:
            yield made()

    return run


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows whose vectors take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where((F.size("embedding") == DIMENSIONS) & finite)


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    scaled = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("long"))
    drawn = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vec_id", scaled.alias("x"))
    rows = drawn.orderBy(F.col("h").asc_nulls_last(), "vec_id", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, DIMENSIONS)


def _centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Componentwise floors of the means; a centroid without vectors stays."""
    places = state.select(F.posexplode("totals")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()
    totals = np.zeros(now.size + len(now), dtype=object)
    for row in places:
        totals[row["pos"]] = int(row["total"])
    totals = totals.reshape(len(now), -1)
    return np.array([[int(x) // int(t[-1]) for x in t[:-1]] if t[-1] else c.tolist() for t, c in zip(totals, now, strict=True)], np.int64)


@dataclass(frozen=True)
class Clustered:
    """rows: vec_id, cluster, distance; centroids: the final ones; rescanned: how many vectors each assignment measured."""

    rows: DataFrame
    centroids: np.ndarray
    rescanned: list[int]


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> Clustered:
    """Every kept row of ``vectors`` (vec_id, embedding) with its cluster and squared distance."""
    kept = kept_vectors(vectors)
    model = Model(first_centroids(kept, k, seed), np.zeros(0))
    if not len(model.centroids):
        return Clustered(vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), model.centroids, [])
    model = Model(model.centroids, np.zeros(len(model.centroids)))
    # a bucket has some shards; a task reads one bucket
    buckets = max(8, vectors.count() // (4 * shard_rows) + 1)
    shards = bucketed(kept.mapInArrow(_to_shards(shard_rows), SHARD_SCHEMA), "shard", buckets)
    state = bucketed(shards.mapInArrow(_begin(model), STATE_SCHEMA), "shard", buckets)
    rescanned = [state.agg(F.sum("rescanned")).first()[0]]
    side_by_side = lambda now: shards.join(now.drop("rescanned").hint("shuffle_hash"), "shard")
    for _ in range(rounds):
        model = model.moved(_centroids(state, model.centroids))
        last, state = state, bucketed(side_by_side(state).mapInArrow(_round(model), STATE_SCHEMA), "shard", buckets)
        discard(last)
        rescanned.append(state.agg(F.sum("rescanned")).first()[0])
    rows = written(side_by_side(state).mapInArrow(_finish(model), "vec_id long, cluster int, distance long"), "clustered")
    discard(shards, state)
    return Clustered(rows, model.centroids, rescanned)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: r["s"] for r in out.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), F.col("cluster") + 1) if values else F.lit(None)
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in out.centroids]
    inertia = [sums.get(j, 0) for j in range(len(out.centroids))]
    return out.rows.select(
        "vec_id", "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(hashes).cast("string").alias("centroid_sha256")
    )


def _oracle() -> str:
    """The same in SQL, a common table for each step of each round."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), vec_id, x) - 1)::INTEGER AS j, x FROM v QUALIFY j < {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT v.r, c.j, {square} AS d FROM v, c{k} c), a{k} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{k} GROUP BY r)")
        if k < ROUNDS:
            steps.append(
                f"""m{k} AS (SELECT a.j, g.i, sum(v.x[g.i])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN v USING (r), range(1, {DIMENSIONS + 1}) g(i) GROUP BY ALL),
                n{k} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{k} GROUP BY j),
                c{k + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN n{k} n USING (j))"""
            )
    return f"""WITH {', '.join(steps)}
        SELECT v.vec_id, a.j AS "cluster", a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c.x, lambda e: e::VARCHAR), ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c USING (j)"""


ORACLE = _oracle()
