"""Streams over files, stopped and started again."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.config import Limits
from sluice.functions.rules import consent_rules
from sluice.functions.status import IMPORT_MOVES
from sluice.operators import lifecycle, messages, views
from sluice.plans import bulk_import as plan
from sluice.plans.bulk_import import bulk_import
from sluice.streaming import imports as streams
from sluice.streaming import outbox as outboxes
from sluice.streaming import counts, envelopes, handled, stateful
from sluice.streaming.arrivals import table_stream


def lot(folder, names):
    head = ",".join(consent_rules().columns)
    folder.mkdir(parents=True, exist_ok=True)
    for name in names:
        rows = [f"c{i},{name},,p,1,Active" for i in range(5)] + [f"c1,{name},,p,1,Active", f",{name},,p,1,Active"]
        text = "wrong,header\n1,2\n" if name == "bad" else head + "\n" + "\n".join(rows) + "\n"
        (folder / f"_{name}").write_text(text)
        (folder / f"_{name}").rename(folder / f"{name}.csv")


def described(files):
    name = F.regexp_extract("path", "([^/]*)[.]csv$", 1)
    return files.select(name.alias("id"), "path", F.concat(name, F.lit(".csv")).alias("original_filename"), F.concat(F.lit("consent/"), name, F.lit("/source/source.csv")).alias("source_object_key"))


def outputs(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*.csv")}


def test_arrivals_in_lots_with_a_crash_equal_one_import(spark, tmp_path, monkeypatch):
    limits = Limits(chunk_rows=3)
    land, out = tmp_path / "land", tmp_path / "out"
    run = lambda: streams.import_stream(streams.arriving_files(spark, f"file://{land}", 2), described, f"file://{out}", f"file://{tmp_path}/log", limits=limits).awaitTermination()
    lot(land / "a", ["one", "two", "bad"])
    run()
    lot(land / "b", ["three", "four", "five"])
    write = plan.Imported.write
    calls = []

    def dies(self, folder):
        write(self, folder)
        calls.append(1)
        if len(calls) == 2:
            raise OSError("the driver dies between files and tables")

    monkeypatch.setattr(plan.Imported, "write", dies)
    with pytest.raises(Exception, match="dies between"):
        run()
    monkeypatch.setattr(plan.Imported, "write", write)
    half = streams.imported(spark, f"file://{out}", "rows")
    assert {r["import_id"] for r in half.collect()} < {"one", "two", "three", "four", "five"}
    lot(land / "c", ["six"])
    run()
    run()
    names = ["one", "two", "bad", "three", "four", "five", "six"]
    lot(tmp_path / "all", names)
    files = spark.createDataFrame([(f"file://{tmp_path}/all/{n}.csv",) for n in names], "path string")
    want = bulk_import(spark, described(files), f"file://{tmp_path}/all", limits=limits)
    want.write(f"file://{tmp_path}/want")
    assert outputs(out / "files") == outputs(tmp_path / "want")
    for name in streams.TABLES:
        table, same = streams.imported(spark, f"file://{out}", name).drop("batch", "completed_at"), getattr(want, name).drop("completed_at")
        key = lambda r: str(r)
        assert sorted(map(tuple, table.select(same.columns).collect()), key=key) == sorted(map(tuple, same.collect()), key=key)
    seen = [r["id"] for r in streams.imported(spark, f"file://{out}", "imports").collect()]
    assert sorted(seen) == sorted(names)


def test_files_that_nobody_describes_start_nothing(spark, tmp_path):
    lot(tmp_path / "land", ["one"])
    files = streams.arriving_files(spark, f"file://{tmp_path}/land")
    streams.import_stream(files, lambda f: described(f).where("false"), f"file://{tmp_path}/out", f"file://{tmp_path}/log").awaitTermination()
    assert not (tmp_path / "out").exists()


def arrivals(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(folder)


def drained(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def test_changes_in_any_order_lead_to_what_fold_gives(spark, tmp_path):
    stateful.with_keyed_state(spark)
    draw = random.Random(4)
    rows = [(draw.choice("abcde"), f"2026-01-01 {i // 60:02}:{i % 60:02}:00", i % 3, draw.choice([*IMPORT_MOVES, None])) for i in range(400)]
    rows += [("x", f"2026-01-01 03:00:0{2 - i}", 0, to) for i, to in enumerate(["validating", "parsing"])]
    changes = spark.createDataFrame(rows, "id string, at string, tie long, to string").withColumn("at", F.to_timestamp("at"))
    want = {r["id"]: r["status"] for r in lifecycle.fold(changes, "id", ["at", "tie"], "to", "queued", IMPORT_MOVES).collect()}
    draw.shuffle(rows)
    schema = "id string, at timestamp, tie long, to string"
    for lot in range(3):  # ten files in all, and two restarts
        for k in range(lot, 10, 3):
            part = spark.createDataFrame(rows[k::10], "id string, at string, tie long, to string").withColumn("at", F.to_timestamp("at"))
            part.coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = stateful.lifecycle_stream(arrivals(spark, f"file://{tmp_path}/in", schema), "id", "at", "tie", "to", "1 day")
        found = drained(stream, f"file://{tmp_path}")
    latest = found.groupBy("id").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("n"), F.count_distinct("version").alias("m"), F.count("*").alias("rows"))
    got = latest.collect()
    assert {r["id"]: r["status"] for r in got} == want
    assert all(r["n"] == r["m"] == r["rows"] for r in got)
    assert not found.where("settled").count()
    # a change that comes days later lets all the others settle
    spark.createDataFrame([("a", "2026-01-09 00:00:00", 0, "nonsense"), ("y", "2026-01-09 00:00:01", 0, "parsing")], "id string, at string, tie long, to string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"file://{tmp_path}/in/late")
    for k in range(2):
        stream = stateful.lifecycle_stream(arrivals(spark, f"file://{tmp_path}/in", schema), "id", "at", "tie", "to", "1 day")
        found = drained(stream, f"file://{tmp_path}")
    settled = {r["id"]: r["status"] for r in found.where("settled").groupBy("id").agg(F.max_by("status", "version").alias("status")).collect()}
    assert {k: v for k, v in settled.items() if k not in "ay"} == {k: v for k, v in want.items() if k != "a"}


def test_a_request_waits_for_the_imports_state(spark, tmp_path):
    stateful.with_keyed_state(spark)
    imports, chunks = "id string, status string, total long", "bulk_import_id string, sequence long, status string, total long"
    state = spark.createDataFrame([("z", "validating", 2, [1], False), ("w", "validating", 1, [], True)], "bulk_import_id string, status string, total long, finished array<long>, sent boolean")

    def arrive(n, told, done):
        spark.createDataFrame(told, imports).coalesce(1).write.parquet(f"file://{tmp_path}/imports/{n}")
        spark.createDataFrame(done, chunks).coalesce(1).write.parquet(f"file://{tmp_path}/chunks/{n}")
        streams_ = arrivals(spark, f"file://{tmp_path}/imports", imports), arrivals(spark, f"file://{tmp_path}/chunks", chunks)
        return sorted(tuple(r) for r in drained(stateful.guarded_barrier(*streams_, state), f"file://{tmp_path}").collect())

    none = [("q", "queued", None)]
    assert arrive(1, none, [("a", 1, "completed", 2), ("a", 2, "failed", 2), ("b", 1, "completed", None), ("w", 1, "completed", 1)]) == []
    assert arrive(2, [("a", "parsing", None), ("b", "validating", None)], [("z", 2, "completed", 2)]) == [("z", 2)]
    assert arrive(3, [("a", "validating", 2)], [("z", 2, "completed", 2)]) == [("a", 2), ("z", 2)]
    assert arrive(4, [("a", "validating", 2), ("b", "validating", 1)], [("a", 1, "completed", 2)]) == [("a", 2), ("b", 1), ("z", 2)]


def test_a_message_that_fails_three_times_fails_its_chunk_once(spark, tmp_path):
    body = lambda key, n, payload: json.dumps({"message_id": f"m{n}", "routing_key": key, "occurred_at": "2026-01-02T03:04:05Z", "payload": payload})
    rows = [(1, body("consent.chunk.validate", 1, {"chunk_id": "c1", "bulk_import_id": "i", "chunk_object_key": "k"})), (2, body("consent.import.assemble", 2, {"bulk_import_id": "i"}))]
    rows += [(3, body("consent.parse.requested", 3, {"bulk_import_id": "j", "source_object_key": "k"})), (4, "nope"), (5, body("other", 5, {}))]
    spark.createDataFrame(rows, "n int, body string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    seen, crashed = [], []

    def handle(batch):
        seen.extend((r["n"], r["attempt"]) for r in batch.where("reason is null").collect())
        return batch.withColumn("error", F.when(F.col("n").isin(1, 3) | ((F.col("n") == 2) & (F.col("attempt") == 1)), F.concat(F.lit("boom "), F.col("attempt").cast("string"))))

    def failed(dead, batch_id):
        messages.given_up(dead).write.mode("overwrite").parquet(f"file://{tmp_path}/failed/batch={batch_id}")
        if not dead.isEmpty() and not crashed:
            crashed.append(batch_id)
            raise OSError("dies after the dead are told")

    start = lambda: envelopes.deliver_with_retries(table_stream(spark, f"file://{tmp_path}/in"), envelopes.Handler(handle, failed), f"file://{tmp_path}/out", f"file://{tmp_path}/log")
    with pytest.raises(Exception, match="dies after"):
        envelopes.until_settled(start)
    assert envelopes.until_settled(start) == 2
    assert sorted(set(seen)) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (5, 1)]
    got = {name: sorted(r["n"] for r in spark.read.parquet(f"file://{tmp_path}/out/{name}").collect()) for name in ("handled", "dead", "rejected")}
    assert got == {"handled": [2, 5], "dead": [1, 3], "rejected": [4]}
    told = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/failed").select("kind", "id", "status", "failure_message").collect()]
    assert sorted(told) == [("chunk", "c1", "failed", "Validation failed: boom 3"), ("import", "j", "failed", "Parsing failed: boom 3")]


def test_filters_miss_nothing():
    draw = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        own, others = (draw.integers(-(1 << 62), 1 << 62, k) for k in (n, 20_000))
        found = handled.filter_of(own)
        assert handled.may_hold(found, own).all() if n else True
        assert handled.may_hold(found, others).mean() < (0.03 if n else 0.001)


def test_replays_of_any_age_are_dropped_and_no_id_is_lost(spark, tmp_path):
    ids = handled.HandledIds(f"file://{tmp_path}/ids", buckets=32, most_segments=3)
    draw, seen, shares = random.Random(6), set(), []
    for batch in range(8):
        fresh = [f"m{batch}-{i}" for i in range(200)]
        old = draw.sample(sorted(seen), 3) if seen else []
        rows = [(m, k) for k, m in enumerate([*fresh, *fresh[:20], *old])] + [(None, -1), (None, -2)]
        done = ids.check(spark.createDataFrame(rows, "message_id string, h int"), batch, "message_id")
        got = [r["message_id"] for r in done.new.collect()]
        assert sorted(x for x in got if x) == sorted(fresh) and got.count(None) == 2
        seen |= set(fresh)
        shares.append((done.read, done.files))
    assert {r["id"] for r in ids.ids(spark).collect()} == seen and ids.ids(spark).count() == len(seen)
    assert any(read < files for read, files in shares[1:])
    few = ids.check(spark.createDataFrame([(sorted(seen)[5], 1)], "message_id string, h int"), 99, "message_id")
    assert few.new.count() == 0 and 1 <= few.read <= 4 < few.files  # one file, and false positives
    with pytest.raises(ValueError, match="32 buckets"):
        handled.HandledIds(f"file://{tmp_path}/ids", buckets=8).check(few.new, 100, "message_id")


def test_a_batch_that_runs_again_is_no_replay_of_itself(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i % 90}",) for i in range(100)], "message_id string")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    given = []

    def handle(new, batch_id):
        given.append(sorted(r["message_id"] for r in new.collect()))
        if len(given) == 1:
            raise OSError("dies before it is done")

    run = lambda: handled.once_stream(table_stream(spark, f"file://{tmp_path}/in", 1), handled.HandledIds(f"file://{tmp_path}/ids", 4), handle, f"file://{tmp_path}/log").awaitTermination()
    with pytest.raises(Exception, match="dies before"):
        run()
    run()
    rows.limit(50).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run()
    assert given == [sorted({f"m{i}" for i in range(90)})] * 2 + [[]]


def test_kept_counts_equal_the_batch_query_after_any_prefix(spark, tmp_path, monkeypatch):
    draw, version, state, changes = random.Random(3), 0, {}, []
    for _ in range(300):
        version += 1
        changes.append((draw.choice("abc"), draw.randint(1, 9), draw.choice(["pending", "processing", "completed", "failed"]), draw.choice([None, 3, 5]), draw.randint(0, 4), version))
    schema = "bulk_import_id string, sequence int, status string, valid_rows long, invalid_rows long, version long"
    imports = spark.createDataFrame([(x, "validating") for x in "abcd"], "id string, status string")
    kept = counts.KeptCounts(f"file://{tmp_path}/kept", most_segments=3)
    add, dead = counts.KeptCounts.add, []

    def dies(self, batch, batch_id):
        add(self, batch, batch_id)
        if batch_id == 2 and not dead:
            dead.append(batch_id)
            raise OSError("dies after the commit")

    monkeypatch.setattr(counts.KeptCounts, "add", dies)
    for k in range(7):
        part = changes[43 * k : 43 * k + 43]
        late = changes[:3] if k else []  # states that newer ones have replaced
        spark.createDataFrame(part + late, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        run = lambda: counts.counts_stream(arrivals(spark, f"file://{tmp_path}/in", schema), kept, f"file://{tmp_path}/log").awaitTermination()
        if k == 2:
            with pytest.raises(Exception, match="dies after"):
                run()
        run()
        for c in part:
            state[c[:2]] = c
        now = spark.createDataFrame(list(state.values()), schema)

        counted = {r["id"]: (r["chunks_total"], r["chunks_finished"]) for r in views.with_chunk_counts(imports, now).collect()}
        summed = {r["id"]: (r["valid_rows"], r["rejected_rows"], r["chunks_progress"]) for r in views.summary(imports, now).collect()}
        got = kept.of_imports(imports).collect()
        assert {r["id"]: (r["chunks_total"], r["chunks_finished"]) for r in got} == counted
        assert {r["id"]: (r["valid_rows"], r["rejected_rows"], r["chunks_progress"]) for r in got} == summed
    assert dead and len(kept.segments.current()) <= 5


OUTBOX = "id string, failed_attempts int, last_error string, published_at timestamp, bad boolean"


def outbox(spark, tmp_path, n=60, range_rows=10):
    rows = spark.range(n).selectExpr("format_string('%05d', id) as id", "0 as failed_attempts", "cast(null as string) as last_error", "cast(null as timestamp) as published_at", "id in (7, 23, 24) as bad")
    table = outboxes.OutboxTable(spark, f"file://{tmp_path}/outbox", rows.schema, range_rows)
    table.append(rows)
    return table


def test_relays_over_a_whole_table_equal_a_plain_loop(spark, tmp_path):
    table, plain = outbox(spark, tmp_path), {f"{i:05}": [0, False] for i in range(60)}
    assert len(table.current()[1]) == 6
    for k in range(14):
        heals = k >= 4  # what can't be reached at first can be later
        fails = F.lit(False) if heals else F.col("bad")
        table.relay(fails, 8, at=F.lit("2026-01-02 00:00:00").cast("timestamp"))
        assert len(table.touched) <= 2
        for i in [x for x in sorted(plain) if not plain[x][1]][:8]:
            if not heals and int(i) in (7, 23, 24):
                plain[i][0] += 1
                break
            plain[i][1] = True
        assert {r["id"]: [r["failed_attempts"], r["published_at"] is not None] for r in table.rows().collect()} == plain
    assert table.relay(F.lit(False), 8) == {}


def test_a_change_that_comes_too_late_leaves_the_table_as_it_is(spark, tmp_path, monkeypatch):
    table = outbox(spark, tmp_path)
    other = outboxes.OutboxTable(spark, table.folder, table.schema, 10)
    write, begun = outboxes.OutboxTable._written, []

    def slow(self, rows):
        if not begun:
            begun.append(1)
            other.relay(F.lit(False), 3)
        return write(self, rows)

    monkeypatch.setattr(outboxes.OutboxTable, "_written", slow)
    with pytest.raises(outboxes.Changed):
        table.relay(F.lit(False), 5)
    monkeypatch.setattr(outboxes.OutboxTable, "_written", lambda self, rows: (_ for _ in ()).throw(OSError("dies")))
    with pytest.raises(OSError, match="dies"):
        table.relay(F.lit(False), 5)
    monkeypatch.setattr(outboxes.OutboxTable, "_written", write)
    assert table.rows().where("published_at is not null").count() == 3 and table.rows().count() == 60
    table.relay(F.lit(False), 5)
    assert [r["id"] for r in table.rows().where("published_at is not null").orderBy("id").collect()] == [f"{i:05}" for i in range(8)]


def test_prune_writes_only_ranges_with_old_rows(spark, tmp_path):
    table = outbox(spark, tmp_path)
    table.relay(F.lit(False), 15, at=F.lit("2026-01-01 00:00:00").cast("timestamp"))
    table.relay(F.lit(False), 10, at=F.lit("2026-01-20 00:00:00").cast("timestamp"))
    now = F.lit("2026-01-21 00:00:00").cast("timestamp")
    assert table.prune(now) <= 3 and table.rows().count() == 45
    assert table.prune(now) == 0
    assert [r["id"] for r in table.rows().orderBy("id").limit(1).collect()] == ["00015"]
    table.append(table.rows().limit(2).withColumn("id", F.concat(F.lit("z"), "id")))
    assert table.rows().count() == 47
