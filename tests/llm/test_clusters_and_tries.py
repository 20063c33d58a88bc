"""Clusters, context trees and prefix tries against plain versions."""

import hashlib
import heapq
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sluice.llm import centroids, context_trees, prefix_trie

FOLDER = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- op11


def test_heaps_keep_their_order():
    draw = np.random.default_rng(1)
    keys, members = np.zeros(0), np.zeros(0, np.int32)
    plain: list = []
    for k in range(200):
        bound = float(draw.random())
        gone = centroids.expired(keys, bound)
        assert sorted(members[gone].tolist()) == sorted(m for x, m in plain if x <= bound)
        new = draw.random(int(draw.integers(0, 60))) + draw.choice([0.0, 0.3])
        names = np.arange(1000 * k, 1000 * k + len(new)).astype(np.int32)
        keys, members = centroids.exchanged(keys, members, gone, new, names)
        plain = [x for x in plain if x[0] > bound] + list(zip(new.tolist(), names.tolist(), strict=True))
        heapq.heapify(plain)
        assert sorted(zip(keys.tolist(), members.tolist(), strict=True)) == sorted(plain)
        at = np.arange(1, len(keys))
        assert (keys[(at - 1) // 2] <= keys[at]).all()


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in start[:k]]
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in now] for _, v in kept]
        own = [d.index(min(d)) for d in far]
        if step < rounds:
            groups = defaultdict(list)
            for (_, v), j in zip(kept, own, strict=True):
                groups[j].append(v)
            now = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(now)]
    return sorted([(i, j, d[j]) for (i, _), j, d in zip(kept, own, far, strict=True)], key=str), now


@pytest.mark.parametrize("n, wide", [(0, 1), (5, 1), (300, 1), (300, 1000)])
def test_clusters_equal_plain_ones(spark, n, wide):
    draw = np.random.default_rng(n + wide)
    rows = [(i, (draw.normal(0, 0.1, 64) + (i % 5 == 0) * wide).tolist()) for i in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (7, rows[2][1])] if n else []
    rows += [(90001, None), (90002, []), (90003, [0.5] * 63), (90004, [0.5] * 63 + [None]), (90005, [float("nan")] * 64), (90006, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    out = centroids.clustered(df, shard_rows=40)
    want, now = plain_clusters(rows)
    assert sorted([tuple(r) for r in out.rows.collect()], key=str) == want
    assert out.centroids.tolist() == now


def test_far_apart_groups_are_seldom_measured_again(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(0, 0.01, 64) + 3 * (i % 8)).tolist()) for i in range(800)]
    out = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.rescanned[0] == 800
    assert sum(out.rescanned[-4:]) < 800


def test_a_component_without_a_distance_is_an_error(spark):
    with pytest.raises(Exception, match="squared distance"):
        centroids.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def test_rounds_move_no_vectors(spark):
    shards = centroids.bucketed(spark.range(100).selectExpr("id as shard", "id as vectors"), "shard", 4)
    state = centroids.bucketed(spark.range(100).selectExpr("id as shard", "id as keys"), "shard", 4)
    plan = shards.join(state.hint("shuffle_hash"), "shard")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and shards.join(state, "shard").count() == 100


# ---------------------------------------------------------------- op12


def plain_scores(rows):
    learn = [(t or "") for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    words = lambda s: re.findall("[^\x20\x09-\x0d]+", lower(s))
    count = defaultdict(int)
    for t in learn:
        for w in [*words(t), None]:
            count[w] += 1
    total, kinds = sum(count.values()), len(count)
    nodes: dict = defaultdict(lambda: [0, 0])
    depth = context_trees.DEPTH

    def choices(text):
        data = bytes([context_trees.START] * depth) + lower(text).encode() + bytes([context_trees.END])
        for at in range(depth, len(data)):
            for i in range(8):
                yield data[at - depth : at][::-1], (1 << i) | (data[at] >> (8 - i)), (data[at] >> (7 - i)) & 1

    for t in learn:
        for context, choice, bit in choices(t):
            for d in range(depth + 1):
                nodes[context[:d], choice][bit] += 1
    children = defaultdict(list)
    for context, choice in nodes:
        if context:
            children[context[:-1], choice].append(context)
    weighted: dict = {}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    share: dict = {}
    for (context, choice), (a, b) in sorted(nodes.items(), key=lambda x: -len(x[0][0])):
        own = kt(a, b)
        if len(context) == depth:
            weighted[context, choice] = own
            continue
        below = sum(weighted[c, choice] for c in children[context, choice])
        share[context, choice] = 1 / (1 + math.exp(min(700, below - own)))
        weighted[context, choice] = np.logaddexp(own, below) - math.log(2)
    out = []
    for i, t in rows:
        t = t or ""
        tokens = [*words(t), None]
        score = 0.0
        for context, choice, bit in choices(t):
            p = 0.5
            for d in range(depth, -1, -1):
                a = nodes.get((context[:d], choice), [0, 0])
                own = (a[bit] + 0.5) / (sum(a) + 1)
                w = 1.0 if d == depth else share.get((context[:d], choice), 0.5)
                p = w * own + (1 - w) * p
            score += math.log10(p)
        base = sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        apart = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        out.append((i, apart, len(tokens), sum(count.get(w, 0) > 0 for w in tokens), total, base, score))
    return out


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[2], r[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:7] for r in got], [r[5:7] for r in want], rtol=1e-9, atol=1e-9)


def test_scores_equal_plain_context_trees(spark):
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(draw.choice(["The", "cat", "sat", "naïve", "東京", "of\tx", "on\n"], int(draw.integers(0, 30))))) for i in range(60)]
    rows += [(None, "the cat"), (None, None), (61, None), (62, ""), (63, " \n\t"), (64, "zq" * 3000), rows[5], rows[5], (5, rows[6][1])]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, score string, base_score double").repartition(3)
    want = plain_scores(rows)
    same_scores([tuple(r)[:7] for r in context_trees.scored(df, text_bytes=500).collect()], want)
    same_scores([tuple(r)[:7] for r in context_trees.scored(df.coalesce(1)).collect()], want)


def test_scores_of_whole_documents_are_probabilities(spark):
    rows = context_trees.query(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.score < 0 for r in rows)
    apart = [r for r in rows if r.held_out]
    assert sum(-r.score for r in apart) / sum(r.n_bytes + 1 for r in apart) / math.log10(2) < 3  # of 8


def test_choices_of_a_context_sum_to_one():
    keys = np.array([(97 << 32) | b for b in range(256)], np.int64)
    _, p = context_trees.Trees(keys, np.arange(256), top=0).predicted()
    assert np.isclose(p.reshape(8, -1).prod(axis=0).sum(), 1)


def test_scores_without_learning_rows_and_of_empty_tables(spark):
    schema = "doc_id long, text string"
    assert context_trees.scored(spark.createDataFrame([], schema)).count() == 0
    row = context_trees.scored(spark.createDataFrame([(None, "ab c")], schema)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (False, 3, 0, 0, 0.0)
    assert np.isclose(row.score, 8 * 5 * math.log10(0.5))


# ---------------------------------------------------------------- op13


def plain_trie(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in of.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, q in whole.items():
        for d in range(len(q) + 1):
            members[tuple(q[:d])].append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaf = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        up = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), up, len(m), sum(len(x) == len(k) + 1 for x in below), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth string, mark int"


def tried(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in prefix_trie.trie(df, **more).collect()], key=str)


def talks():
    draw = np.random.default_rng(9)
    texts = ["hello there", "a b c", "", " \n", "x " * 400, "hello  there", None]
    rows = [(int(c), t, ["user", "bot", None][t % 3], texts[int(draw.integers(0, 2 if c % 3 else 7))]) for c in [*range(-25, 45), 100, 119, 1005] for t in range(int(draw.integers(1, 7)))]
    rows += [(3, None, "user", "null first"), (3, 2, "bot", "tie"), (3, 2, "bot", "tie"), (3, 2, "ann", "tie"), (None, 1, "user", "nobody"), (41, 0, None, None)]
    return rows + [(500, t, "user", f"turn {t % 5}") for t in range(60)] + [(501, t, "user", f"turn {t % 5}") for t in range(60)]


def test_tries_equal_plain_ones(spark):
    assert tried(spark, talks()) == plain_trie(talks())


def test_tries_whose_fingerprints_collide_are_made_again(spark):
    weak = ((3, 5), 64), (prefix_trie.PRIMES, 3), (prefix_trie.PRIMES, 64)
    assert tried(spark, talks(), attempts=weak) == plain_trie(talks())
    with pytest.raises(RuntimeError, match="collide"):
        tried(spark, talks(), attempts=weak[:2])


def test_tries_of_nothing_and_of_turnless_conversations(spark):
    assert tried(spark, []) == []
    assert tried(spark, [(None, 0, "user", "a")]) == []
    short = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(short, 0, "user", "gone")]
    assert tried(spark, rows) == plain_trie(rows) and len(plain_trie(rows)) == 1


def test_one_conversation_of_many_turns_is_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_ROWS", 50)
    monkeypatch.setattr(prefix_trie, "HOT_NODES", 8)
    monkeypatch.setattr(prefix_trie, "JOINED_BYTES", 20)
    rows = [(1, t, "user", f"t {t}") for t in range(300)] + [(c, 0, "user", "same") for c in range(2, 150)]
    assert tried(spark, rows) == plain_trie(rows)
