import json
import random

from pyspark.sql import functions as F

from sluice.functions.status import IMPORT_MOVES, progress_percent
from sluice.operators import assemble, chunking, lifecycle, messages, search_index, validate, views
from sluice.functions.rules import consent_rules
from sluice.streaming.arrivals import table_stream
from sluice.streaming.barrier import barrier_stream
from sluice.streaming.envelopes import deliver_stream


def test_progress(spark):
    cases = [("queued", 0, 0, 0), ("parsing", 0, 0, 5), ("validating", 0, 1, 10), ("validating", 1, 2, 50), ("validating", 0, 0, 10), ("validating", 1, 3, 37), ("assembling", 2, 2, 95), ("completed", 1, 1, 100), ("failed", 0, 0, 100)]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "s string, f long, t long, want int, i int")
    assert all(r["p"] == r["want"] for r in df.select("want", progress_percent(F.col("s"), F.col("f"), F.col("t")).alias("p")).collect())


def test_lifecycle_ignores_moves_that_are_not_allowed(spark):
    events = [("a", 1, "parsing"), ("a", 2, "parsing"), ("a", 3, "completed"), ("a", 4, "validating"), ("a", 5, "failed"), ("b", 1, "failed"), ("b", 2, "parsing"), ("c", 1, "validating")]
    got = lifecycle.fold(spark.createDataFrame(events, "id string, at int, to string"), "id", ["at"], "to", "queued", IMPORT_MOVES)
    assert {r["id"]: r["status"] for r in got.collect()} == {"a": "validating", "b": "failed", "c": "queued"}


def test_completion_and_counts(spark):
    imports = spark.createDataFrame([("a", "validating"), ("b", "validating"), ("c", "assembling"), ("d", "validating")], "id string, status string")
    chunks = spark.createDataFrame([("a", "completed"), ("a", "failed"), ("b", "completed"), ("b", "pending"), ("c", "completed")], "bulk_import_id string, status string")
    assert [r["bulk_import_id"] for r in lifecycle.completion(imports, chunks).collect()] == ["a"]
    counted = {r["id"]: (r["chunks_total"], r["chunks_finished"]) for r in views.with_chunk_counts(imports, chunks).collect()}
    assert counted == {"a": (2, 2), "b": (2, 1), "c": (1, 1), "d": (0, 0)}


def test_outcomes(spark):
    imports = spark.createDataFrame([(i, f"p/{i}/source/s.csv") for i in "abcd"], "id string, source_object_key string")
    chunks = [("a", 1, "completed", 0), ("b", 1, "completed", 2), ("b", 2, "completed", 0), ("c", 12, "failed", 0), ("c", 5, "failed", 0), ("c", 1, "completed", 0), ("d", 1, "failed", 0)]
    found = assemble.import_outcome(imports, spark.createDataFrame(chunks, "import_id string, chunk_seq int, status string, invalid_rows long")).collect()
    got = {r["id"]: tuple(r)[1:5] for r in found}
    assert all(r["completed_at"] for r in found)
    assert got == {
        "a": ("completed", "p/a/output/result.csv", None, None),
        "b": ("completed_with_errors", "p/b/output/result.csv", "p/b/output/errors.csv", None),
        "c": ("completed_with_errors", "p/c/output/result.csv", None, "Chunks that could not be validated: 5, 12"),
        "d": ("completed_with_errors", None, None, "Chunks that could not be validated: 1"),
    }


def test_chunk_failure_and_fanout(spark):
    headers = spark.createDataFrame([("a", 1, list(consent_rules().columns)), ("a", 2, ["Consent code"])], "import_id string, chunk_seq int, header array<string>")
    failed = validate.chunk_failures(headers, consent_rules()).collect()
    assert [(r["chunk_seq"], r["failure_message"]) for r in failed] == [(2, "The file is not processable: the chunk header is missing the column [Consent name].")]
    rows = spark.createDataFrame([("a", "c/a/source/s.csv", 1), ("a", "c/a/source/s.csv", 1), ("b", "c/b/source/s.csv", 1)], "import_id string, source_object_key string, chunk_seq int")
    imports = spark.createDataFrame([("a", "parsing"), ("b", "validating")], "id string, status string")
    sent = chunking.fanout(chunking.chunk_list(rows), imports).collect()
    assert [json.loads(r["payload"])["chunk_object_key"] for r in sent] == ["c/a/chunks/chunk-000001.csv"]


BODIES = {
    "ok": ('{"message_id":"m","routing_key":"k","occurred_at":"2026-01-02T03:04:05.000006Z","payload":{"a":1}}', None),
    "list": ('{"message_id":"m","routing_key":"k","occurred_at":"2026-01-02","payload":[1]}', None),
    "text": ("nope", messages.NOT_JSON),
    "number id": ('{"message_id":5,"routing_key":"k","occurred_at":"2026-01-02","payload":{}}', messages.INCOMPLETE),
    "no payload": ('{"message_id":"m","routing_key":"k","occurred_at":"2026-01-02"}', messages.INCOMPLETE),
    "text payload": ('{"message_id":"m","routing_key":"k","occurred_at":"2026-01-02","payload":"x"}', messages.INCOMPLETE),
    "date": ('{"message_id":"m","routing_key":"k","occurred_at":"soon","payload":{}}', messages.NOT_A_DATE),
    "array": ("[1]", messages.INCOMPLETE),
}


def test_decoding(spark):
    df = spark.createDataFrame([(k, b) for k, (b, _) in BODIES.items()], "k string, body string")
    got = {r["k"]: r["reason"] for r in messages.decode(df).collect()}
    assert got == {k: messages.PREFIX + w if w else None for k, (_, w) in BODIES.items()}


def test_relay_stops_at_the_first_failure(spark):
    rows = [(f"{i:03d}", 0, None, None, i == 4) for i in range(1, 9)] + [("000", 0, None, "2026-01-01 00:00:00", True)]
    df = spark.createDataFrame(rows, "id string, failed_attempts int, last_error string, published_at string, bad boolean").withColumn("published_at", F.col("published_at").cast("timestamp"))
    got = {r["id"]: (r["state"], r["failed_attempts"]) for r in messages.relay(df, F.col("bad"), 6).collect()}
    assert got == {"001": ("published", 0), "002": ("published", 0), "003": ("published", 0), "004": ("failed", 1), "005": ("waiting", 0), "006": ("waiting", 0)}
    kept = messages.prune(df, F.lit("2026-01-09 00:00:00").cast("timestamp"))
    assert kept.where("id = '000'").count() == 0 and kept.count() == 8


def test_barrier_sends_once_over_restarts(spark, tmp_path):
    schema = "bulk_import_id string, sequence long, status string, total long"

    def arrive(n, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = barrier_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())

    arrive(1, ("a", 1, "completed", 2), ("b", 1, "completed", 1), ("c", 1, "pending", 1))
    assert run() == [("b", 1)]
    arrive(2, ("a", 2, "failed", 2), ("b", 1, "completed", 1), ("a", 1, "completed", 2))
    assert run() == [("a", 2), ("b", 1)]
    arrive(3, ("a", 2, "failed", 2), ("c", 1, "processing", 1), ("d", 1, "completed", None), ("d", None, "completed", None))
    assert run() == [("a", 2), ("b", 1)]


def test_delivery_stream_writes_by_outcome(spark, tmp_path):
    good = BODIES["ok"][0]
    rows = [(1, good, 1, None), (2, good, 1, "boom"), (3, good, 3, "boom"), (4, "nope", 1, None)]
    spark.createDataFrame(rows, "n int, body string, attempt int, error string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        deliver_stream(table_stream(spark, f"{tmp_path}/in"), lambda df: df, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {name: [(r["n"], r["next_attempt"]) for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect()] for name in ("handled", "retry", "dead", "rejected")}
    assert got == {"handled": [(1, 1)], "retry": [(2, 2)], "dead": [(3, 3)], "rejected": [(4, 1)]}


def test_attempts_and_errors_beside_the_body(spark):
    good = '{"message_id":"m","routing_key":"k","occurred_at":"2026-01-01T00:00:00Z","payload":{}}'
    df = spark.createDataFrame([(good, None, None), (good, 3, "late")], "body string, attempt int, last_error string")
    got = messages.decode(df).collect()
    assert [(r["attempt"], r["last_error"], r["reason"]) for r in got] == [(1, None, None), (3, "late", None)]
    bare = messages.decode(df.select("body")).collect()
    assert [(r["attempt"], r["last_error"]) for r in bare] == [(1, None)] * 2
    tried = df.select(F.lit(None).cast("string").alias("reason"), F.lit("broke").alias("error"), "attempt")
    assert [(r["outcome"], r["next_attempt"]) for r in messages.delivery(tried).collect()] == [("retried", 2), ("dead_lettered", 3)]


def test_relayed_rows_have_their_time(spark):
    rows = spark.createDataFrame([(f"{i}", 0, None, None) for i in range(4)], "id string, failed_attempts int, last_error string, published_at timestamp")
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    got = messages.relay(rows, F.col("id") == "2", 10, at=at).orderBy("id").collect()
    assert [r["published_at"] is not None for r in got] == [True, True, False, False] and got[2]["state"] == "failed"


def test_lifecycle_over_many_ranges(spark):
    draw, rows = random.Random(1), []
    for i in range(600):
        rows.append((draw.choice(["a", "a", "a", "b", None]), i, draw.choice(["parsing", "validating", "assembling", "completed", "failed", None, "nonsense"])))
    want = {}
    for key, _, to in rows:
        now = want.setdefault(key, "queued")
        if now in IMPORT_MOVES.get(to, ()):
            want[key] = to
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = lifecycle.fold(spark.createDataFrame(rows, "k string, at long, to string").repartition(4), "k", ["at"], "to").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["k"]: r["status"] for r in got} == want


def test_an_import_whose_assembly_was_given_up(spark):
    imports = spark.createDataFrame([("a", "c/i/s/x.csv"), ("b", "c/j/s/x.csv")], "id string, source_object_key string")
    chunks = spark.createDataFrame([("a", 1, "completed", 0), ("b", 1, "completed", 2)], "import_id string, chunk_seq int, status string, invalid_rows long")
    lost = spark.createDataFrame([("b", "broker " * 300)], "id string, reason string")
    got = {r["id"]: r for r in assemble.import_outcome(imports, chunks, given_up=lost).collect()}
    assert (got["a"]["status"], got["b"]["status"], got["b"]["output_object_key"], got["b"]["completed_at"]) == ("completed", "failed", None, None)
    assert len(got["b"]["failure_message"]) in (1002, 1003) and got["a"]["completed_at"]


def test_search_by_index_equals_contains(spark, tmp_path):
    draw = random.Random(12)
    words = ["report", "Consent", "RE", "reporter", "née", "a", "", "x.csv", "con sent", "zzz"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 4))), f"2026-01-{draw.randint(1, 9):02} 00:00:00") for i in range(300)] + [(300, None, "2026-01-05 00:00:00")]
    imports = spark.createDataFrame(rows, "id long, original_filename string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    index = search_index.NameIndex(f"file://{tmp_path}/index", buckets=8)
    index.build(imports)
    for pattern in ("report", "REPORTER", "t con", "née", "zz", "", "nothing", "sent", "rep%", "csv"):
        want = [r["id"] for r in views.search(imports, pattern).collect()]
        got, after = [], None
        while True:
            page = index.page(imports, pattern, 40, after).collect()
            got += [r["id"] for r in page]
            after = search_index.last_place(page)
            if len(page) < 40:
                break
        assert got == want, pattern


def test_search_reads_the_rarest_lists(spark, tmp_path):
    imports = spark.range(5000).selectExpr("id", "concat('report ', if(id % 500 = 0, 'needle', 'hay')) as original_filename", "timestamp '2026-01-01' + make_dt_interval(int(id)) as created_at")
    index = search_index.NameIndex(f"file://{tmp_path}/index")
    index.build(imports)
    found, read = index.candidates(imports, "ort needle")
    assert found.count() == 10 and read == 30
    first = index.page(imports, "ort needle", 4).collect()
    later, _ = index.candidates(imports, "ort needle", search_index.last_place(first))
    assert [r["id"] for r in first] == [4500, 4000, 3500, 3000] and later.count() == 6
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]
