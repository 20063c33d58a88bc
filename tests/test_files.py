import csv
import io
import json
import os
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.config import Limits
from sluice.functions import cells as c
from sluice.functions.rules import RuleSet, consent_rules, required
from sluice.operators import jumps
from sluice.operators.chunking import assign_by_rows, assign_chunks
from sluice.plans.bulk_import import bulk_import
from sluice.sources import gates, keyed_files, records
from sluice.sources.gates import verdicts
from sluice.sources.records import csv_records, without_blanks
from sluice.sources.sinks import rejected_records, write_ordered
from sluice.storage import settled, through_table, work_folder

CELL = st.text(st.sampled_from('ab ,"\n\té😀;\''), max_size=6)


def written(records):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(records)
    return out.getvalue()


def test_records_equal_the_csv_module(spark, tmp_path):
    draw = random.Random(3)
    pieces = ["a", "", "x,y", 'say "hi"', "two\nlines", " lead", "é😀", '"', "\n\n", ","]
    for k in range(3):
        records = [[draw.choice(pieces) for _ in range(draw.randint(1, 4))] for _ in range(200)]
        (tmp_path / f"f{k}.csv").write_text(written(records))
    want = {}
    for k in range(3):
        for n, cells in enumerate(csv.reader(io.StringIO((tmp_path / f"f{k}.csv").read_text())), 1):
            want[f"f{k}.csv", n] = cells or [""]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = {(r["path"].rpartition("/")[2], r["record_no"]): r["cells"] for r in csv_records(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def plain_records(text):
    """Records by a tokenizer that goes over the letters: at a cell's start, bare, in quotes, behind a quote."""
    out, record, cell, raw, state = [], [], "", "", "start"
    lead = ""

    def close():
        nonlocal cell, lead, state
        record.append(cell if state in ("behind", "after") else lead + cell)
        cell, lead, state = "", "", "start"

    for ch in text:
        if state == "quoted":
            cell, state = (cell, "behind") if ch == '"' else (cell + ch, state)
            continue
        if state == "behind" and ch == '"':
            cell, state = cell + ch, "quoted"
            continue
        if ch == "\n":
            if state != "behind" and (cell or lead).endswith("\r"):
                cell, lead = (cell[:-1], lead) if cell else (cell, lead[:-1])
            close()
            out.append(record)
            record = []
        elif ch == ",":
            close()
        elif state == "start" and ch in " \t\x0b\f\r":
            lead += ch
        elif state == "start" and ch == '"':
            state, lead = "quoted", ""
        elif state == "start":
            cell, state = ch, "bare"
        else:
            cell, state = cell + ch, "after" if state in ("behind", "after") else "bare"
    if record or cell or lead or state != "start":
        if state not in ("quoted", "behind") and (cell or lead).endswith("\r"):
            cell, lead = (cell[:-1], lead) if cell else (cell, lead[:-1])
        if state == "quoted":
            state = "behind"
        close()
        out.append(record)
    return out


def read_in_splits(spark, folder, split="1000b", **more):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        return {(r["path"].rpartition("/")[2], r["record_no"]): r["cells"] for r in csv_records(spark, str(folder), **more).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("letters", ['a,"\n', 'ab, "\n\t', 'a,"\r\n é', 'aaaaaaaaaaaaaaaaa,"\n', 'aaaaaaaa,,\n\n""'])
def test_records_equal_a_plain_tokenizer(spark, tmp_path, letters):
    draw, want = random.Random(len(letters)), {}
    for k in range(6):
        text = "".join(draw.choice(letters) for _ in range(draw.choice([7, 300, 9000])))
        if k == 0:
            text = text.replace('"', "")[:-1] + ',"open'  # quotes that never close, with no line end behind
        elif k == 1:
            text = text.replace('"', "") + '\n,"open\n'
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        want |= {(f"{k}.csv", n): cells for n, cells in enumerate(plain_records(text), 1)}
    assert read_in_splits(spark, tmp_path) == want


def test_records_with_bare_quotes_equal_the_csv_module(spark, tmp_path):
    draw = random.Random(11)
    lines = ['1,5" pipe', "2,plain", '3,7" pipe', "4,end", '1,"a"b', '"a""b"c,"', 'x"y","z', '""', 'a,"', '"q" "r",s', '"a"b"c,d"', "", '","']
    text = "".join(draw.choice(lines) + "\n" for _ in range(2000))
    (tmp_path / "a.csv").write_text(text)
    want = {("a.csv", n): cells or [""] for n, cells in enumerate(csv.reader(io.StringIO(text, newline="")), 1)}
    assert read_in_splits(spark, tmp_path) == want
    (tmp_path / "a.csv").write_text('id,name\n1,5" pipe\n2,plain\n3,7" pipe\n4, "end"\n5,"a"\n')
    assert read_in_splits(spark, tmp_path) == {("a.csv", n + 1): c for n, c in enumerate([["id", "name"], ["1", '5" pipe'], ["2", "plain"], ["3", '7" pipe'], ["4", "end"], ["5", "a"]])}


def test_no_line_is_shuffled_but_those_of_records_over_splits(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("".join(f'{i},"two\nlines"\n' for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        lines = records.text_lines(spark, str(tmp_path)).withColumn("file", F.xxhash64("path"))
        entries = through_table(records.split_entries(lines))
        parts = records.record_parts(lines, entries, 1 << 20)
        plan = parts._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        n = entries.count()
        assert n > 20 and parts.where("not whole").count() <= 2 * n
        want = sorted(map(tuple, parts.collect()))
        monkeypatch.setattr(records, "BROADCAST_SPLITS", 0)
        assert sorted(map(tuple, records.record_parts(lines, entries, 1 << 20).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_record_that_is_too_large_is_never_put_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"' + "x\n" * 5000 + '",2\n3,"open\n' + "y\n" * 5000)
    rows = {r["record_no"]: r for r in read_all(spark, tmp_path, 200)}
    assert [rows[n]["cells"] for n in (1, 2, 3)] == [["a", "b"], None, None]
    assert [rows[n]["n_bytes"] for n in (1, 2, 3)] == [4, 10007, 10008] and len(rows) == 3


def read_all(spark, folder, record_bytes):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        return csv_records(spark, str(folder), record_bytes).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(CELL, min_size=1, max_size=4), min_size=1, max_size=12))
def test_cells_survive_joining_and_splitting(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, cells array<string>")
    back = df.select("i", c.split_cells(c.join_cells(F.col("cells"))).alias("cells")).collect()
    assert {r["i"]: r["cells"] for r in back} == dict(enumerate(records))


def test_long_quoted_cell(spark):
    df = spark.createDataFrame([('"' + 'x""' * 50_000 + '",b',)], "raw string")
    assert [len(x) for x in df.select(c.split_cells(F.col("raw")).alias("c")).first()["c"]] == [100_000, 1]


def test_byte_order_mark_line_ends_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfName,Code\r\n\r\n"a\r\nb",1\r\n , \r\nlast,2')
    rows = csv_records(spark, str(tmp_path)).orderBy("record_no").collect()
    assert [r["cells"] for r in rows] == [["Name", "Code"], [""], ["a\r\nb", "1"], [" ", " "], ["last", "2"]]
    assert [r["record_no"] for r in without_blanks(csv_records(spark, str(tmp_path))).orderBy("record_no").collect()] == [1, 3, 5]


BAD = {
    "empty": (b"", "x.csv", "it is empty"),
    "ext": (b"A,B\n1,2\n", "x.txt", "it is not a .csv file"),
    "nul": (b"A,B\n1,\x002\n", "x.csv", "it is not a text file"),
    "bytes": (b"A,B\n1,\xff\xfe\n", "x.csv", "it is not UTF-8 text"),
    "blankhead": (b"\nA,B\n1,2\n", "x.csv", "it has no header row"),
    "headonly": (b"A,B\n", "x.csv", "it has no data rows"),
    "blankrows": (b"A,B\n\n , \n", "x.csv", "it has no data rows"),
    "missing": (b"A,C\n1,2\n", "x.csv", "the header is missing the column(s) [B]"),
    "twice": (b"A,B,a\n1,2,3\n", "x.csv", "the header has the column [a] twice"),
    "unnamed": (b"A,,B\n1,2,3\n", "x.csv", "column 2 of the header has no name"),
    "large": (b"A,B\n" + b"1,2\n" * 400, "x.csv", "it is larger than 1 KB"),
    "row": (b'A,B\n1,"' + b"z" * 250 + b'"\n', "x.csv", "row 2 is larger than 200 B, which usually means a quote is never closed"),
    "cut": ("A,B\n".encode() + b"1,2\n" * 14 + "12345,é".encode() + b"\n", "x.CSV", None),
    "good": (b"b, A ,extra\n1,2,3\n", "x.csv", None),
}


def test_file_verdicts(spark, tmp_path):
    for name, (content, _, _) in BAD.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    rows = [(f"file://{tmp_path}/{n}.csv", n, f, len(b)) for n, (b, f, _) in BAD.items()] + [(f"file://{tmp_path}/gone.csv", "gone", "x.csv", 5)]
    imports = spark.createDataFrame(rows, "path string, id string, original_filename string, source_size_bytes long").withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    limits = Limits(file_bytes=1024, record_bytes=200, sample_bytes=68)
    found = verdicts(spark, imports, str(tmp_path), ("A", "B"), limits)[0]
    got = {r["id"]: r["reason"] for r in found.collect()}
    assert got == {n: w for n, (_, _, w) in BAD.items()} | {"gone": "the uploaded file is missing"}
    message = found.where("id = 'gone'").first()
    assert (message["status"], message["failure_message"]) == ("failed", "The file is not processable: the uploaded file is missing.")


def bytes_read(spark, run):
    """What run() gives, and the bytes that the scans of text files inside it read by their metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList().size()
    out = run()
    found = store.executionsList()
    total = 0
    for i in range(seen, found.size()):
        e = found.apply(i)
        values, metrics = store.executionMetrics(e.executionId()), e.metrics()
        for j in range(metrics.size()):
            if metrics.apply(j).name() == "size of files read":
                text = values.get(metrics.apply(j).accumulatorId())
                total += sum(float(x) * 1024 ** "B KiB MiB GiB".split().index(u) for x, u in re.findall(r"^(?:total.*\n)?([0-9.]+) ([KMG]?i?B)", text.get() if text.isDefined() else ""))
    return out, total


def test_refused_files_are_not_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.csv").write_text("A,B\n" + "1,2\n" * 1000)
    (tmp_path / "in/nul.csv").write_bytes(b"A,B\n1,\x002\n" + b"1,2\n" * 500_000)
    (tmp_path / "in/large.csv").write_bytes(b"A,B\n" + b"1,2\n" * 1_000_000)
    (tmp_path / "in/ext.csv").write_bytes(b"A,B\n" + b"1,2\n" * 600_000)
    names = {"good": "x.csv", "nul": "x.csv", "large": "x.csv", "ext": "x.pdf"}
    imports = spark.createDataFrame([(f"file://{tmp_path}/in/{k}.csv", k, v) for k, v in names.items()], "path string, id string, original_filename string")
    limits = Limits(file_bytes=3_000_000)
    gated, wanted = gates.gate_files(spark, imports, str(tmp_path / "in"), limits)
    assert {r["id"]: r["reason"] for r in gated.collect()} == {"good": None, "nul": "it is not a text file", "large": "it is larger than 3 MB", "ext": "it is not a .csv file"}
    found, total = bytes_read(spark, lambda: csv_records(spark, str(tmp_path / "in"), wanted=wanted).count())
    assert found == 1001 and 4004 <= total < 500_000  # of the good file twice, and of small tables


def test_a_sample_takes_little_more_than_the_first_bytes(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(b"A,B\n" + b"1,2\n" * 1_000_000 + (b"\0" if k else b""))
    (tmp_path / "3.csv").write_bytes(b"A,B\n" + b"\0" * (k + 1) + b"1,2\n" * 1_000_000)
    found = {r["path"][-5:]: (r["has_nul"], r["bad_utf8"]) for r in gates.sample_verdicts(spark, str(tmp_path)).collect()}
    assert found == {f"{k}.csv": (k == 3, False) for k in range(4)}


def chunk_loop(rows, limits, head):
    out, now, full = [], None, True
    for key, order, n in sorted(rows):
        if key != now:
            now, seq, full = key, 0, True
        if full:
            seq, count, size = seq + 1, 0, head
        count, size = count + 1, size + n
        out.append((key, order, seq, count))
        full = count >= limits.chunk_rows or size >= limits.chunk_bytes
    return out


def test_chunks_equal_a_plain_loop(spark):
    draw = random.Random(5)
    rows = [(draw.choice("abc"), i, draw.randint(0, 30)) for i in range(300)]
    limits = Limits(chunk_rows=7, chunk_bytes=100)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "k string, i long, n long").repartition(parts).withColumn("head", F.lit(9))
        got = assign_chunks(df, "k", "i", "n", limits, header="head").select("k", "i", "chunk_seq", "row_in_chunk").collect()
        assert sorted(map(tuple, got)) == chunk_loop(rows, limits, 9)
    by_rows = assign_by_rows(spark.createDataFrame(rows, "k string, i long, n long"), ["k"], ["i"], 7)
    assert sorted(tuple(r) for r in by_rows.select("k", "i", "chunk_seq", "row_in_chunk").collect()) == chunk_loop(rows, Limits(chunk_rows=7, chunk_bytes=1 << 40), 0)


def test_pieces_compose_to_what_a_loop_gives():
    draw = np.random.default_rng(2)
    for _ in range(150):
        n, most = int(draw.integers(1, 60)), int(draw.integers(1, 12))
        limits = (most, int(draw.integers(1, 80)))
        sizes, heads = draw.integers(0, 15, n), draw.integers(0, 6, n)
        rows = [("a", i, int(x)) for i, x in enumerate(sizes)]
        seq, count, size, want = 0, 0, 0, []
        for i in range(n):
            if not want or count >= limits[0] or size >= limits[1]:
                seq, count, size = seq + 1, 0, int(heads[i])
            count, size = count + 1, size + int(sizes[i])
            want.append((seq, count))
        cuts = np.unique(np.concatenate([[0, n], draw.integers(0, n + 1, 4)])).tolist()
        pieces = [jumps.piece_of(sizes[a:b], heads[a:b], limits) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        state, got = tuple(np.array([0]) for _ in range(3)), []
        for (a, b), p in zip(zip(cuts[:-1], cuts[1:], strict=True), pieces, strict=True):
            got += list(zip(*(x.tolist() for x in jumps.numbered(sizes[a:b], heads[a:b], tuple(int(x[0]) for x in state), limits)), strict=True))
            state = p.leave(*state, limits)
        assert got == want and len(rows) == n
        whole = pieces[0]
        for p in pieces[1:]:
            whole = whole.then(p, limits)
        first = tuple(np.array([0]) for _ in range(3))
        assert [x.tolist() for x in whole.leave(*first, limits)] == [x.tolist() for x in state]
        own = jumps.piece_of(sizes, heads, limits)
        assert all((a == b).all() for a, b in ((own.sums, whole.sums), (own.rows, whole.rows), (own.bytes, whole.bytes), (own.starts, whole.starts)))


def test_one_scope_is_cut_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jumps, "RANGE_ROWS", 40)
    monkeypatch.setattr(jumps, "FAN", 4)
    draw = random.Random(7)
    rows = [("a", i, draw.randint(0, 30)) for i in range(3000)] + [(draw.choice(["b", "c"]), i, draw.randint(0, 300)) for i in range(300)]
    for limits in (Limits(chunk_rows=7, chunk_bytes=100), Limits(chunk_rows=500, chunk_bytes=3000), Limits(chunk_rows=1, chunk_bytes=1 << 50), Limits(chunk_rows=1 << 50, chunk_bytes=1 << 50)):
        df = spark.createDataFrame(rows, "k string, i long, n long").repartition(3).withColumn("head", F.lit(9))
        got = assign_chunks(df, "k", "i", "n", limits, header="head").select("k", "i", "chunk_seq", "row_in_chunk").collect()
        assert sorted(map(tuple, got)) == chunk_loop(rows, limits, 9)


def test_chunks_of_null_scopes_and_repeated_orders(spark):
    rows = [(None, i % 3, 5, f"{i}") for i in range(30)] + [("a", None, 5, "x")] * 4 + [("a", 1, None, "y"), ("a", 1, 7, "z")]
    df = spark.createDataFrame(rows, "k string, i long, n long, other string").repartition(3)
    got = assign_chunks(df, "k", "i", "n", Limits(chunk_rows=4, chunk_bytes=1000)).collect()
    assert sorted((str(r["k"]), r["other"]) for r in got) == sorted((str(k), o) for k, _, _, o in rows)
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["i"] is not None, r["i"] or 0, r["chunk_seq"], r["row_in_chunk"]))
    for found in by.values():
        places = sorted((s, p) for _, _, s, p in found)
        assert places == [(i // 4 + 1, i % 4 + 1) for i in range(len(found))]
        assert [x[:2] for x in sorted(found, key=lambda x: x[2:])] == sorted(x[:2] for x in found)
    assert assign_chunks(df.limit(0), "k", "i", "n").count() == 0


def test_import_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = ",".join(consent_rules().columns)
    lines = [head, "c1,n,,p,1,Active", "c2,n,,p,1,Active", ",n,,p,1,Active", "c2,n,,p,2,inactive", "c3,n,,p,1,Active"]
    (tmp_path / "in/a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "in/b.csv").write_text("nothing,here\n")
    rows = [("a", f"file://{tmp_path}/in/a.csv", "up.csv", "consent/import-a/source/source.csv"), ("b", f"file://{tmp_path}/in/b.csv", "up.csv", "consent/import-b/source/source.csv")]
    done = bulk_import(spark, spark.createDataFrame(rows, "id string, path string, original_filename string, source_object_key string"), str(tmp_path / "in"), limits=Limits(chunk_rows=2))
    got = {r["id"]: r.asDict() for r in done.imports.collect()}
    assert got["a"]["status"] == "completed_with_errors" and got["a"]["error_object_key"] == "consent/import-a/output/errors.csv"
    assert got["b"]["status"] == "failed" and "missing the column(s)" in got["b"]["failure_message"]
    kept = done.accepted.orderBy("chunk_seq", "row_in_chunk").collect()
    assert [r["cells"][0] for r in kept] == ["c1", "c2", "c2", "c3"]
    assert sorted((r["sequence"], r["valid_rows"], r["invalid_rows"]) for r in done.chunks.collect()) == [(1, 2, 0), (2, 1, 1), (3, 1, 0)]
    lost = rejected_records(done.rejected)
    assert [r["record"] for r in lost.collect()] == ['2,1,,n,,p,1,Active,"Consent code is required"']
    (tmp_path / "out/consent/import-a/chunks").mkdir(parents=True)
    (tmp_path / "out/consent/import-a/chunks/chunk-000009.csv").write_text("left by an earlier run")
    for _ in range(2):  # a rerun gives the same
        done.write(f"file://{tmp_path}/out")
    written = {str(p.relative_to(tmp_path / "out/consent")): p.read_text() for p in (tmp_path / "out").rglob("*.csv")}
    assert not list((tmp_path / "out").rglob("._*"))
    head = '"Consent code","Consent name",Description,Purpose,Version,Status\n'
    errors = f'Chunk,"Row in chunk",{head[:-1]},Errors\n2,1,,n,,p,1,Active,"Consent code is required"\n'
    assert written == {
        "import-a/chunks/chunk-000001.csv": head + "c1,n,,p,1,Active\nc2,n,,p,1,Active\n", "import-a/chunks/chunk-000002.csv": head + ",n,,p,1,Active\nc2,n,,p,2,inactive\n",
        "import-a/chunks/chunk-000003.csv": head + "c3,n,,p,1,Active\n", "import-a/errors/chunk-000002.csv": errors, "import-a/output/errors.csv": errors,
        "import-a/output/result.csv": head + "c1,n,,p,1,Active\nc2,n,,p,1,Active\nc2,n,,p,2,inactive\nc3,n,,p,1,Active\n",
    }
    write_ordered(lost, "Chunk,Row", str(tmp_path / "errors"), one_file=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "errors")).collect()] == ["Chunk,Row", '2,1,,n,,p,1,Active,"Consent code is required"']


def test_another_rule_set(spark):
    rules = RuleSet(("x",), (required("x"),), lambda cells: F.struct(cells["x"]))
    assert rules.columns == ("x",)


def awkward_documents(spark, folder):
    """Documents with null sources and texts, leading and inner blanks, and long texts."""
    name = 'a "quoted", long\r\nname '
    texts = [None, "", "ok", " " * 300 + "ok", "\n" * 300 + "x" * 256, "x" * 250 + " " * 100 + "y", " \t" * 200, name * 3000, "z" * 255 + " " * 400, "é" * 256]
    rows = [(i, texts[i % 10], "en" if i % 3 else None, (None, "src1", "src5")[i // 10 % 3], i) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_bulk_import_of_whole_texts_and_null_sources(spark, tmp_path):
    from sluice.plans.catalogue import documents_bulk_import

    rows, want, seen, nth = awkward_documents(spark, tmp_path), {}, {}, {}
    for doc, text, lang, source, n_chars in rows:
        file = f"{source or ''}-0"
        n = nth[file] = nth.get(file, -1) + 1
        chunk, row, name = n // 20 + 1, n % 20 + 1, (text or "").strip(" \t\n\r\0\x0b")
        errors = [m for bad, m in ((not name, "Consent name is required"), (len(name) > 255, "Consent name is longer than 255 characters"), (not lang, "Purpose is required"), (n_chars % 3 < 1, "Version must be a positive whole number"), (doc % 4 == 3, "Status must be one of: Active, Inactive")) if bad]
        if not errors:
            first = seen.setdefault((file, chunk, doc % 7, n_chars % 3), row)
            errors = [f"is a duplicate of row {first} of this chunk"] if first < row else []
        want[doc] = (file, chunk, row, "; ".join(errors))
    got = {r["doc_id"]: (r["file"], r["chunk_seq"], r["row_in_chunk"], r["errors"]) for r in documents_bulk_import(spark, str(tmp_path)).collect()}
    assert got == want


def test_verdicts_of_null_sources_and_texts(spark, tmp_path):
    from sluice.plans.catalogue import documents_file_verdicts

    awkward_documents(spark, tmp_path)
    got = {r["file"]: (r["status"], r["failure_message"]) for r in documents_file_verdicts(spark, str(tmp_path)).collect()}
    large = "The file is not processable: row 9 is larger than 16 KB, which usually means a quote is never closed."
    assert got == {"-0": ("failed", large), "src1-0": ("failed", large), "src5-0": ("failed", "The file is not processable: it is not a .csv file.")}


COLUMNS = "id string, path string, original_filename string, source_object_key string"


def test_failed_chunks_are_in_no_output(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        lines = [",".join(consent_rules().columns), *(f"c{i},n,,p,{'x' if i == 1 else 1},Active" for i in range(6))]
        (tmp_path / f"in/{name}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "in/c.csv").write_text("Consent code,Consent name\nc,n\n")
    rows = [(x, f"file://{tmp_path}/in/{x}.csv", "up.csv", f"consent/import-{x}/source/source.csv") for x in "abc"]
    lost = spark.createDataFrame([("a", 2, "gone " * 400), ("b", 1, "x"), ("b", 2, "x"), ("b", 3, "x"), ("a", 9, "no such chunk")], "import_id string, chunk_seq int, reason string")
    done = bulk_import(spark, spark.createDataFrame(rows, COLUMNS), str(tmp_path / "in"), limits=Limits(chunk_rows=2), parse_columns=("Consent code",), given_up=lost)
    got = {r["id"]: r.asDict() for r in done.imports.collect()}
    assert {k: (v["status"], v["output_object_key"], v["failure_message"]) for k, v in got.items()} == {
        "a": ("completed_with_errors", "consent/import-a/output/result.csv", "Chunks that could not be validated: 2"), "b": ("completed_with_errors", None, "Chunks that could not be validated: 1, 2, 3"),
        "c": ("completed_with_errors", None, "Chunks that could not be validated: 1"),
    }
    assert all(v["completed_at"] for v in got.values())
    chunks = {(r["bulk_import_id"], r["sequence"]): r for r in done.chunks.collect()}
    assert len(chunks) == 7 and chunks["a", 2]["failure_message"].endswith("...") and (chunks["a", 2]["valid_rows"], chunks["a", 2]["error_object_key"]) == (0, None)
    assert "missing the column [Description]" in chunks["c", 1]["failure_message"] and chunks["a", 1]["error_object_key"] == "consent/import-a/errors/chunk-000001.csv"
    assert sorted(r["cells"][0] for r in done.accepted.collect()) == ["c0", "c4", "c5"] and [r["cells"][0] for r in done.rejected.collect()] == ["c1"]
    sent = done.requests.groupBy("routing_key").count().collect()
    assert {r["routing_key"]: r["count"] for r in sent} == {"consent.chunk.validate": 7, "consent.import.assemble": 3}
    done.write(f"file://{tmp_path}/out")
    names = {str(p.relative_to(tmp_path / "out/consent")) for p in (tmp_path / "out").rglob("*.csv")}
    assert names == {*(f"import-{x}/chunks/chunk-00000{i}.csv" for x in "ab" for i in (1, 2, 3)), "import-c/chunks/chunk-000001.csv", "import-a/errors/chunk-000001.csv", "import-a/output/errors.csv", "import-a/output/result.csv"}


def test_all_rows_rejected_gives_a_header_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(",".join(consent_rules().columns) + "\n,n,,p,1,Active\n")
    row = [("a", f"file://{tmp_path}/in/a.csv", "up.csv", "consent/import-a/source/source.csv")]
    bulk_import(spark, spark.createDataFrame(row, COLUMNS), str(tmp_path / "in")).write(f"file://{tmp_path}/out")
    assert len((tmp_path / "out/consent/import-a/output/result.csv").read_text().splitlines()) == 1


def test_chunks_keep_null_and_repeated_places(spark):
    rows = [("f", 1, 5, "x"), ("f", 1, 5, "y"), ("f", None, 5, "z"), (None, 2, 5, "u"), (None, 1, None, "v"), ("f", 2, 5, "w")]
    df = spark.createDataFrame(rows, "scope string, place long, n long, other string").repartition(3)
    got = {r["other"]: (r["chunk_seq"], r["row_in_chunk"]) for r in assign_chunks(df, "scope", "place", "n", Limits(chunk_rows=2)).collect()}
    assert sorted((got["x"], got["y"])) == [(1, 2), (2, 1)] and {k: got[k] for k in "zwvu"} == {"z": (1, 1), "w": (2, 2), "v": (1, 1), "u": (1, 2)}
    assert sorted(r["other"] for r in assign_by_rows(df, ["scope"], ["place"], 2).collect()) == ["u", "v", "w", "x", "y", "z"]


def test_an_open_quote_is_never_put_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n1,2\n3,"open\n' + "line of the rest\n" * 500)
    rows = csv_records(spark, str(tmp_path), 100).orderBy("record_no").collect()
    assert [r["cells"] for r in rows] == [["A", "B"], ["1", "2"], None] and rows[2]["raw"] is None and rows[2]["n_bytes"] == 8 + 500 * 17


def test_no_folder_of_its_own_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    for master in ("yarn", "k8s://x", "spark://h:1", "local-cluster[2,1,512]"):
        session.sparkContext.master = master
        with pytest.raises(RuntimeError):
            work_folder(session)


def keyed(spark, n, parts=3):
    return spark.range(n, numPartitions=parts).selectExpr("concat('a/k-', id % 7, '.csv') as key", "cast(id as string) as record").repartition("key").sortWithinPartitions("key", F.col("record").cast("int"))


def test_files_by_key_are_committed_by_a_manifest(spark, tmp_path):
    run = keyed_files.write_keyed(keyed(spark, 700), f"file://{tmp_path}")
    for k in range(7):
        assert (tmp_path / f"a/k-{k}.csv").read_text() == "".join(f"{i}\n" for i in range(k, 700, 7))
    done = keyed_files.committed(f"file://{tmp_path}", run)
    assert done["files"] == 7 and done["bytes"] == sum(p.stat().st_size for p in (tmp_path / "a").iterdir())
    listed = [json.loads(x) for part in done["parts"] for x in (tmp_path / "_runs" / run / part).read_text().splitlines()]
    assert sorted(x["key"] for x in listed) == [f"a/k-{k}.csv" for k in range(7)]
    assert keyed_files.committed(f"file://{tmp_path}", "other") is None


def test_a_task_that_dies_leaves_nothing_that_readers_see(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/k-3.csv").write_text("of an earlier run\n")
    dies = F.when((F.col("record") == "693"), F.raise_error(F.lit("killed"))).otherwise(F.col("record"))
    with pytest.raises(Exception, match="killed"):
        keyed_files.write_keyed(spark.range(700, numPartitions=1).selectExpr("'a/k-3.csv' as key", "cast(id as string) as record").withColumn("record", dies), f"file://{tmp_path}")
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["k-3.csv"]
    assert (tmp_path / "a/k-3.csv").read_text() == "of an earlier run\n"
    assert not list(tmp_path.rglob("manifest.json"))
    assert spark.read.text(f"file://{tmp_path}/a").count() == 1  # Spark's readers pass hidden files by, too


def test_the_drivers_part_does_not_grow_with_the_keys(spark, tmp_path, monkeypatch):
    lines = spark.range(3000).selectExpr("concat('many/', id, '.csv') as key", "'x' as record").repartition(3, "key").sortWithinPartitions("key")
    seen = []
    run = keyed_files.write_keyed(lines, f"file://{tmp_path}")
    done = keyed_files.committed(f"file://{tmp_path}", run)
    seen.append((tmp_path / "_runs" / run / "manifest.json").stat().st_size)
    assert done["files"] == 3000 == len(list((tmp_path / "many").iterdir())) and len(done["parts"]) == 3 and seen[0] < 400
    keyed_files.remove_others(lines.where("key < 'many/2'").select("key"), f"file://{tmp_path}")
    assert {p.name for p in (tmp_path / "many").iterdir()} == {f"{k}.csv" for k in range(3000) if f"many/{k}.csv" < "many/2"}


def test_only_the_result_of_steps_stays(spark):
    base = work_folder(spark).rpartition("/")[0].removeprefix("file:")
    before = set(os.listdir(base))

    def one():
        return through_table(through_table(spark.range(10)).where("id > 2"))

    def two():
        return settled(spark, one).where("id > 5")

    out = settled(spark, two)
    assert sorted(r["id"] for r in out.collect()) == [6, 7, 8, 9] and len(set(os.listdir(base)) - before) == 1

    def fails():
        one()
        raise ValueError("late")

    with pytest.raises(ValueError, match="late"):
        settled(spark, fails)
    assert len(set(os.listdir(base)) - before) == 1
    out = through_table(spark.range(3))  # outside, tables stay
    assert out.count() == 3 and len(set(os.listdir(base)) - before) == 2
