import os
import re

import public_tokenizers
import pytest
from samples import COLUMNS, documents, frame
from test_jaccard import brute as all_pairs
from test_lines import brute as plain_lines
from test_tables import plain_targets

import __spark_entry__
import corpus_pipeline
from sluice.llm.catalogue import ORACLES, QUERIES
from sluice.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = docs.count()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name in ("quality_rules", "ngram_jaccard"):
            assert all(before[r["doc_id"]] == r["text"] for r in rows) and len(rows) <= count
        docs = spark.createDataFrame(rows, docs.schema)
        before, count = {r["doc_id"]: r["text"] for r in rows}, len(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_awkward_documents(spark):
    docs = frame(spark, documents(), clashes=True)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() > 0
        assert stage(spark, spark.createDataFrame([], COLUMNS), SF).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_against_plain_versions(spark, tmp_path):
    """Every stage on what the one before it kept: the first three row by row, the mix and the sequences by what they must hold."""
    rows = [(i, t, "en", s, n) for i, (_, t, _, s, n) in enumerate(documents(7, 40)) if n is None or n < 10_000]
    short = "a short text of which copies are no passage that is long enough to go"
    rows += [(900 + i, f"{short} {'at all' if i else 'at any rate'}", "en", "src1", 80) for i in range(3)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # the classifier keeps all
    stages, sf = dict(corpus_pipeline.STAGES), f"file://{tmp_path}"
    run = lambda name, docs: stages[name](spark, spark.createDataFrame(docs, COLUMNS).repartition(3), sf)
    kept = []
    for row in rows:
        w = words_of(row[1])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w):
            kept.append(row)
    assert sorted(map(tuple, run("quality_rules", rows).collect())) == sorted(kept) and len(kept) < len(rows)
    left = plain_lines([(r[0], r[1]) for r in kept])
    lines = [(r[0], left[r[0], r[1]], *r[2:4], len(left[r[0], r[1]])) for r in kept if words_of(left[r[0], r[1]])]
    assert sorted(map(tuple, run("line_dedup", kept).collect())) == sorted(lines) and lines != kept
    component = {d: c for d, _, c, _ in all_pairs([(r[0], r[1]) for r in lines])}
    first = [r for r in lines if component[r[0]] == r[0]]
    assert sorted(map(tuple, run("ngram_jaccard", lines).collect())) == sorted(first) and len(first) < len(lines)
    mix = [tuple(r) for r in run("mixing", first).collect()]
    sizes, text = {}, {r[0]: words_of(r[1]) for r in first}
    for r in first:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words_of(r[1]))
    goals, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for d, t, _, source, n in mix:
        w = words_of(t)
        assert n == len(t) and any(text[d][i : i + len(w)] == w for i in range(len(text[d]))) and w
        taken[source] += len(w)
    assert all(abs(taken[s] - goals[s]) <= 32 * 4 for s in sizes)
    pieces = run("packing", mix).collect()
    from tokenizers import Tokenizer

    own, per, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for d, t, *_ in mix:
        ids[d] = ids.get(d, 0) + len(own.encode(t, add_special_tokens=False).ids) + 1
    for p in pieces:
        per.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        ids[p["doc_id"]] -= p["length"]
    assert set(ids.values()) == {0}
    for x in per.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 1024


def test_run(spark):
    base = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    assert corpus_pipeline.run(spark, SF).count() > 50 and corpus_pipeline.ORACLE_SQL is None
    left = [f"{base}/{x}" for x in set(os.listdir(base)) - before]
    assert [x for x in left if any(files for _, _, files in os.walk(x))] == [x for x in left if os.path.isdir(f"{x}/packing")]


def test_catalogue():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from oracle import compare

    compare(spark, SF, QUERIES[name], ORACLES[name])


def test_no_folder_of_its_own_on_a_cluster():
    from types import SimpleNamespace

    from sluice.llm.shared import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    for master in ("yarn", "k8s://x", "spark://h:1", "local-cluster[2,1,512]"):
        session.sparkContext.master = master
        with pytest.raises(RuntimeError):
            shared_dir(session)
