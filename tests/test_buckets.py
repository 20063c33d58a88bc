"""Keyed state by the bucket: as many rows of state as buckets, and what a plain loop gives."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.functions.status import IMPORT_MOVES
from sluice.operators import lifecycle
from sluice.plans import catalogue
from sluice.storage import settings
from sluice.streaming import barrier, counts, stateful
from sluice.streaming.arrivals import table_stream

BUCKETS = 4


def run(stream, folder):
    """Rows that a stream has written, and its rows of state."""
    with settings(stream.sparkSession, stateful.STORE):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").collect()), key=str), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def chunk_states():
    """Chunks of 60 imports, one without a key and one whose key is beyond what a double holds, in two lots, some of them twice."""
    draw = random.Random(5)
    keys = [None, 2**62 + 1, *range(58)]
    rows = [(k, s, draw.choice(["completed", "failed", "processing"]) if n % 3 else "completed", 3 if s == 1 else None) for n, k in enumerate(keys) for s in (1, 2, 3, 1)]
    rows += [(keys[0], None, "completed", 3)]
    draw.shuffle(rows)
    done = {}
    for k, s, status, _ in rows:
        if s and status in ("completed", "failed"):
            done.setdefault(k, set()).add(s)
    return rows, {k for k, s in done.items() if len(s) == 3}


@pytest.mark.parametrize("guarded", [False, True])
def test_barriers_keep_a_row_of_state_a_bucket(spark, tmp_path, guarded):
    rows, ready = chunk_states()
    want = sorted(((k, 3) for k in ready if not guarded or k is None or k % 2), key=str)
    states = [(k, "validating" if k is None or k % 2 else "completed", None) for k in {r[0] for r in rows}]
    for lot in range(2):
        spark.createDataFrame(rows[lot::2], "bulk_import_id long, sequence int, status string, total int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/chunks")
        spark.createDataFrame(states[lot::2], "id long, status string, total long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/imports")
        chunks, imports = (table_stream(spark, f"file://{tmp_path}/{x}") for x in ("chunks", "imports"))
        stream = stateful.guarded_barrier(imports, chunks, buckets=BUCKETS) if guarded else barrier.barrier_stream(chunks, BUCKETS)
        got, kept = run(stream, f"file://{tmp_path}/{guarded}")
    assert got == want and 0 < len(want) < 60
    assert kept <= BUCKETS


def test_differences_keep_a_row_of_state_a_bucket(spark, tmp_path):
    draw = random.Random(6)
    rows = [(draw.choice([None, 2**62 + 1, 1, 2]), draw.randint(1, 30), draw.choice(["pending", "completed", "failed"]), draw.choice([None, 4]), draw.choice([None, 1]), v) for v in range(400)]
    for lot in range(2):
        spark.createDataFrame(rows[lot::2], "bulk_import_id long, sequence int, status string, valid_rows long, invalid_rows long, version int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        _, kept = run(counts.differences(table_stream(spark, f"file://{tmp_path}/in"), BUCKETS), f"file://{tmp_path}")
    last = {r[:2]: r for r in rows}.values()
    want = {}
    for k, _, status, valid, invalid, _ in last:
        sums = want.setdefault(k, [0, 0, 0, 0])
        for i, x in enumerate((1, int(status != "pending"), valid or 0, invalid or 0)):
            sums[i] += x
    found = spark.read.parquet(f"file://{tmp_path}/out").groupBy("bulk_import_id").agg(*(F.sum(c) for c in counts.SUMS)).collect()
    assert {r[0]: list(r[1:]) for r in found} == want
    assert kept <= BUCKETS


def test_changes_keep_a_row_of_state_a_bucket(spark, tmp_path):
    draw = random.Random(7)
    rows = [(draw.choice([None, *range(40)]), f"2026-01-01 {i // 60:02}:{i % 60:02}:00", i, draw.choice([*IMPORT_MOVES, None])) for i in range(400)]
    rows = [(k if k != 39 else 2**62 + 1, *r) for k, *r in rows]
    changes = spark.createDataFrame(rows, "id long, at string, tie long, to string").withColumn("at", F.to_timestamp("at"))
    want = {r["id"]: r["status"] for r in lifecycle.fold(changes, "id", ["at", "tie"], "to", "queued", IMPORT_MOVES).collect()}
    late = spark.createDataFrame([(1, "2026-02-01 00:00:00", 0, None)], "id long, at string, tie long, to string").withColumn("at", F.to_timestamp("at"))
    kept = []
    for part in (changes.where("tie % 2 = 0"), changes.where("tie % 2 = 1"), late, None):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = stateful.lifecycle_stream(table_stream(spark, f"file://{tmp_path}/in"), "id", "at", "tie", "to", "1 day", buckets=BUCKETS)
        with settings(spark, stateful.STORE):
            query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        kept += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    found = spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out")
    assert {r["id"]: r["status"] for r in found.groupBy("id").agg(F.max_by("status", "version").alias("status")).collect()} == want
    # all but the change that comes last are settled, each key once
    settled = found.where("settled").groupBy("id").count().collect()
    assert {r["id"] for r in settled} == set(want) - {1} and {r["count"] for r in settled} == {1}
    assert found.groupBy("id", "version").count().where("count > 1").isEmpty()
    assert max(kept) <= 3 * BUCKETS  # state, timer and the timer by time


def test_envelopes_come_in_as_many_batches_whatever_the_number_of_files(spark, tmp_path, monkeypatch):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(12).write.parquet(f"file://{tmp_path}/events.parquet")
    started, start = [], catalogue.deliver_stream
    monkeypatch.setattr(catalogue, "deliver_stream", lambda *x: started.append(start(*x)) or started[-1])
    rows = catalogue.events_handled_stream(spark, f"file://{tmp_path}").count()
    assert rows == spark.read.parquet(f"file://{tmp_path}/events.parquet").count()
    assert sum(p["numInputRows"] > 0 for q in started for p in q.recentProgress) == 2
