import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import COLUMNS, documents, frame

from sluice.llm import hnsw, mixing, sharding


# --- shards


def test_a_map_is_kept_and_edited(spark, tmp_path):
    rows, path = documents(), f"file://{tmp_path}/map"
    docs = frame(spark, rows)
    where = lambda found: {r["virtual_slot"]: r["shard"] for r in found}
    one = sharding.sharded(docs, shards=3, slots=256, map_path=path).collect()
    assert len(one) == len(rows) and set(where(one).values()) == {0, 1, 2}
    # a second run, of other rows, finds the map
    other = sharding.sharded(frame(spark, documents(5)), shards=3, map_path=path).collect()
    assert {r["shard"] for r in other} <= {0, 1, 2} and all(where(one).get(s, k) == k for s, k in where(other).items())
    sharding.grow(docs, path, slots=256)
    two = sharding.sharded(docs, slots=256, map_path=path).collect()
    assert all(where(two)[s] in (k, 3) for s, k in where(one).items())
    moved = sum(r["size"] for r in two if r["shard"] == 3)
    assert 0 < moved <= sum(r["size"] for r in two) / 4
    by = {}
    for r in two:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert where(sharding.sharded(docs, slots=256, map_path=path, version=1).collect()) == where(one)
    assert sharding.stored_map(spark, path).count() == sharding.stored_map(spark, path, 1).count() == 256


def test_shards_are_even_and_numbered(spark):
    rows = documents()
    got = sharding.sharded(frame(spark, rows, clashes=True), shards=7).collect()
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(7))
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)


def plain_map(sums, shards):
    load, out = [0] * shards, {}
    for slot, size in sorted(sums.items(), key=lambda x: (-x[1], x[0])):
        to = load.index(min(load))
        load[to] += max(size, 1)
        out[slot] = to
    return out


def test_map_versions(spark, tmp_path):
    rows = [(i, "t" * (37 * i % 400), "en", "s", 1) for i in range(3000)]
    sums = sharding.slot_bytes(sharding.with_slots(frame(spark, rows), 256), 256).persist()
    size = {r["vslot"]: r["bytes"] for r in sums.collect()}
    one = sharding.balanced_map(sums, 8)
    first = {r["vslot"]: r["shard"] for r in one.collect()}
    assert first == plain_map(size, 8)
    load = [sum(size[s] for s in first if first[s] == k) for k in range(8)]
    assert max(load) - min(load) <= max(size.values())
    two = {r["vslot"]: r["shard"] for r in sharding.grown_map(one, sums).collect()}
    moved = {s for s in two if two[s] != first[s]}
    assert {two[s] for s in moved} == {8} and set(two) == set(first)
    took = sum(size[s] for s in moved)
    assert 0.7 * sum(size.values()) / 9 < took <= sum(size.values()) / 9 + 1
    sharding.store_map(one, str(tmp_path / "map"))
    sharding.store_map(sharding.grown_map(one, sums), str(tmp_path / "map"))
    both = spark.read.parquet(str(tmp_path / "map"))
    assert {(r["version"], r["n"]) for r in both.groupBy("version").agg(F.count("*").alias("n")).collect()} == {(1, len(first)), (2, len(first))}


def test_a_map_gives_all_rows_or_an_error(spark, tmp_path):
    docs, path = frame(spark, [(i, "t" * (37 * i % 400), "en", "s", 1) for i in range(2000)]), f"file://{tmp_path}/map"
    for missing in (lambda: sharding.grow(docs, path), lambda: sharding.sharded(docs, map_path=path, version=2)):
        with pytest.raises(ValueError, match="no slot map"):
            missing()
    n = sharding.sharded(docs, shards=4, slots=128, map_path=path).count()
    assert n == docs.count() == sharding.sharded(docs, map_path=path, version=1).count() == sharding.sharded(docs, slots=128, shards=4, map_path=path).count()
    wrong = {"versions": {"version": 7}, "slots": {"slots": 4096}, "shards": {"shards": 10}}
    for what, asked in wrong.items():
        with pytest.raises(ValueError, match=what):
            sharding.sharded(docs, map_path=path, **asked)
    with pytest.raises(ValueError, match="slots"):
        sharding.grow(docs, path, slots=256)
    sharding.grow(docs, path)
    with pytest.raises(ValueError, match="shards"):  # five by now
        sharding.sharded(docs, shards=4, map_path=path)
    assert sharding.sharded(docs, shards=4, map_path=path, version=1).count() == n


def test_no_rows_to_shard(spark):
    assert sharding.sharded(spark.createDataFrame([], COLUMNS)).count() == 0


# --- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(ch) for ch in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
    return out


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_comes_near_its_targets(spark, seed):
    rows = documents(seed)
    names = ("offset", "blocks", "s", "r", "shift", "extra", "range", "place", "begin", "doc", "first", "upto")
    docs = frame(spark, rows, clashes=True).withColumns({c: F.lit(c) for c in names})
    got = mixing.mixed(mixing.sized(docs), block=8, shards=3).collect()
    assert all(r[c] == c for r in got for c in names) and {r["text"] for r in got} == {r[1] for r in rows}
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), size_of(t)) for d, t, *_ in rows)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    goals = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goals[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["to"] - p["from"] for p in r["parts"])
        assert all(0 <= p["from"] < p["to"] <= r["size"] and 0 <= p["shard"] < 3 for p in r["parts"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goals[s]) <= 8 * 4 for s in sizes)
    # each shard has its own quota of each source's blocks, but for what the source's last block lacks
    goal = spark.createDataFrame([(s, goals[s]) for s in goals], "source string, target double")
    quota = {(r["source"], r["shard"]): 8 * r["quota"] for r in mixing.quotas(goal, block=8, shards=3).collect()}
    for s in sizes:
        for h in range(3):
            words = sum(p["to"] - p["from"] for r in got if r["source"] == s for p in r["parts"] if p["shard"] == h)
            assert quota.get((s, h), 0) - 8 * 3 <= words <= quota.get((s, h), 0)
    again = mixing.mixed(mixing.sized(frame(spark, rows, parts=2)), block=8, shards=3).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)


def test_sources_of_few_words_meet_their_targets(spark):
    draw = np.random.default_rng(4)
    rows, sizes = [], {}
    for k in range(60):
        words = int(draw.integers(1, 201))
        sizes[f"s{k:02}"] = words
        while words:
            n = min(words, int(draw.integers(1, 40)))
            rows.append((len(rows), " ".join(["w"] * n), "en", f"s{k:02}", 1))
            words -= n
    rows += [(len(rows) + i, " ".join(["w"] * 50), "en", "t", 1) for i in range(60)]
    goals, taken = plain_targets(sizes | {"t": 3000}), {}
    for r in mixing.mixed(mixing.sized(frame(spark, rows))).collect():
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - goals[s]) < mixing.BLOCK for s in sizes)
    capped = [s for s in sizes if goals[s] == 3 * sizes[s]]
    assert capped and all(goals[s] - taken[s] < mixing.BLOCK for s in capped)


def test_a_source_of_ten_words_is_taken_three_times(spark):
    rows = [(1, "a b c d e f g h i j", "en", "a", 1), (2, " ".join(["w"] * 40), "en", "b", 1)] + [(3 + i, " ".join(["w"] * 100), "en", "c", 1) for i in range(100)]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(mixing.sized(frame(spark, rows))).collect()}
    assert taken[1] == 30 and taken[2] == 120


def test_quotas_are_highest_quotients(spark):
    goals = {"a": 530.0, "b": 240.0, "c": 140.0, "d": 66.0, "e": 0.0, None: 24.0}
    df = spark.createDataFrame([(s, t) for s, t in goals.items()], "source string, target double")
    got = {(r["source"], r["shard"]): r["quota"] for r in mixing.quotas(df, block=10, shards=4).collect()}
    seats = []
    for _ in range(100):
        won = {s: sum(x == s for x in seats) for s in goals}
        seats.append(max((s for s in goals if goals[s] > 0), key=lambda s: goals[s] / (2 * won[s] + 1)))
    for h in range(4):
        part = seats[25 * h : 25 * h + 25]
        assert {s: got.get((s, h), 0) for s in goals} == {s: part.count(s) for s in goals}


def test_materialised_mix_has_the_words_taken(spark):
    rows = documents(2)
    mix = mixing.mixed(mixing.sized(frame(spark, rows)), block=8).persist()
    got = mix.collect()
    out = mixing.materialised(mix, ["doc_id", "text", "source"]).collect()
    assert sum(size_of(r["text"]) for r in out) == sum(r["taken"] for r in got)
    by = {}
    for r in out:
        by.setdefault((r["doc_id"], r["source"]), []).append(r["text"].split())
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert all([w for w in words[p["from"] : p["to"]]] in [[w for w in x if w] for x in by[r["doc_id"], r["source"]]] or "\x1c" in (r["text"] or "") for p in r["parts"])
    # nearly all are taken whole or not at all
    assert sum(any(p["to"] - p["from"] < r["size"] for p in r["parts"]) for r in got) < 60
    assert mixing.mixed(mixing.sized(spark.createDataFrame([], COLUMNS))).count() == 0


# --- nearest neighbours


def test_shards_of_long_vectors_have_fewer_rows():
    assert hnsw.shard_size(64) == hnsw.SHARD_ROWS == hnsw.shard_size(1)
    assert hnsw.shard_size(768) * 768 * 8 <= hnsw.SHARD_BYTES and hnsw.shard_size(1 << 30) == 1 and hnsw.shard_size(64, 500) == 500



def vectors(n=900, seed=1, dim=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 3, (9, dim))
    x = (centres[draw.integers(0, 9, n)] + draw.normal(0, 1, (n, dim))).astype(np.float32)
    x[100:300] = x[7]  # a common vector
    rows = [(i, x[i].tolist(), 1) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None, *[1.0] * (dim - 1)], 1), (n + 4, [1.0], 1), (n + 5, [float("inf"), *[1.0] * (dim - 1)], 1), (None, x[3].tolist(), 1), (n + 6, [], 1)]
    return rows, x


def test_neighbours(spark):
    rows, x = vectors()
    df = spark.createDataFrame([(*r, "s", 5) for r in rows], "vec_id long, embedding array<float>, label int, shard string, v int").repartition(4)
    got = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hit, wide = 0, x.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(900), d))
        best = order[order != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in {v for _, v, _ in found}
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hit >= 0.95 * 10 * len(got)


def test_a_graph_is_whole_and_found_by_its_search():
    draw = np.random.default_rng(3)
    x = draw.normal(0, 1, (3000, 16))
    shard = hnsw.Shard.read(hnsw.Shard.of(x, np.arange(3000)).row())
    assert not (shard.graph.x.dtype == np.float32) and len(shard.graph.x) == 3000
    for k, layer in enumerate(shard.graph.layers):
        links = layer.table
        assert links.shape == (int((shard.graph.levels >= k).sum()), hnsw.width_of(k, hnsw.LINKS))
        assert ((links < 0) | (shard.graph.levels[links] >= k)).all() and not (links == layer.nodes[:, None]).any()
        assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in links)
    q = draw.normal(0, 1, (100, 16))
    ids, _, found = shard.nearest(np.full(100, -1) - np.arange(100), q, 10)
    best = np.argsort(((q[:, None, :] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    hit = sum(v in set(best[-1 - i].tolist()) for i, v in zip(ids, found, strict=True))
    assert len(found) == 1000 and hit >= 980


def test_a_repeated_id_is_spread_over_shards(spark):
    df = spark.range(4000, numPartitions=8).selectExpr("if(id < 3000, 100L, id) as vec_id", "array(double(1 + id % 7), double(2)) as v")
    graphs, shards = hnsw.build_index(df, 2, shard_rows=1000)
    sizes = [len(r["ids"]) // 8 for r in graphs.collect()]
    assert shards == 4 and sum(sizes) == 4000 and max(sizes) < 2500


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [0.0, 2.0]), (7, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in hnsw.nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 7, 5**0.5), (0, 3, 7, 5**0.5), (100, 1, 0, 0.0), (100, 2, 7, 5**0.5), (100, 3, 7, 5**0.5)]
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hnsw.nearest(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert hnsw.nearest(df.where("vec_id = 7"), F.col("vec_id") % 100 == 0).count() == 0
