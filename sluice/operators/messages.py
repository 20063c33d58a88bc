"""Messages as rows: envelopes, payload checks, routing, retries, the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.cells import limited

MAX_ATTEMPTS = 3
KEEP_DAYS = 7
#: Routing key -> fields that its payload needs; fixed values.
PAYLOADS = {
    "consent.parse.requested": ("bulk_import_id", "source_object_key"),
    "consent.chunk.validate": ("bulk_import_id", "chunk_id", "chunk_object_key"),
    "consent.import.assemble": ("bulk_import_id",),
}


def encode_body(message_id: Column, routing_key: Column, occurred_at: Column, payload: Column) -> Column:
    """The JSON body; occurred_at in UTC with microseconds. Attempts and errors stay outside."""
    stamp = F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct(message_id.alias("message_id"), routing_key.alias("routing_key"), stamp.alias("occurred_at"), payload.alias("payload")))


#: Why a body can't be read, and what stands before the reason; fixed values.
NOT_JSON = "the body is not JSON"
INCOMPLETE = "message_id, routing_key, occurred_at or payload is missing"
NOT_A_DATE = "occurred_at is not a date"
PREFIX = "Invalid message envelope: "


def decode(messages: DataFrame, body: str = "body") -> DataFrame:
    """Adds message_id, routing_key, occurred_at, payload (JSON text) and ``reason`` of a bad body.

    Types are checked as they stand in the JSON: a number isn't a string. What travels
    beside the body are the columns attempt (1 where it is null or left out) and last_error.
    """
    messages = messages.withColumn("attempt", F.coalesce("attempt", F.lit(1)) if "attempt" in messages.columns else F.lit(1))
    if "last_error" not in messages.columns:
        messages = messages.withColumn("last_error", F.lit(None).cast("string"))
    parsed = messages.withColumn("_v", F.try_parse_json(body))
    kind = lambda field: F.schema_of_variant(F.try_variant_get("_v", f"$.{field}", "variant"))
    text = lambda field: F.when(kind(field) == "STRING", F.try_variant_get("_v", f"$.{field}", "string"))
    payload = F.when(kind("payload").startswith("OBJECT") | kind("payload").startswith("ARRAY"), F.to_json(F.try_variant_get("_v", "$.payload", "variant")))
    out = parsed.withColumns({"message_id": text("message_id"), "routing_key": text("routing_key"), "_at": text("occurred_at"), "payload": payload})
    out = out.withColumn("occurred_at", F.coalesce(F.try_to_timestamp("_at"), F.try_to_timestamp("_at", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))))
    reason = (
        F.when(F.col("_v").isNull(), F.lit(NOT_JSON))
        .when(F.col("message_id").isNull() | F.col("routing_key").isNull() | F.col("_at").isNull() | F.col("payload").isNull(), F.lit(INCOMPLETE))
        .when(F.col("occurred_at").isNull(), F.lit(NOT_A_DATE))
    )
    return out.withColumn("reason", F.when(reason.isNotNull(), F.concat(F.lit(PREFIX), reason))).drop("_v", "_at")


def payload_ok(routing_key: Column, payload: Column, needs: dict[str, tuple[str, ...]] = PAYLOADS) -> Column:
    """Whether the payload has every field that its routing key needs, none of them empty."""
    out = F.lit(False)
    for key, fields in needs.items():
        filled = F.lit(True)
        for field in fields:
            filled = filled & (F.coalesce(F.get_json_object(payload, f"$.{field}"), F.lit("")) != "")
        out = F.when(routing_key == key, filled).otherwise(out)
    return out


def delivery(messages: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Adds outcome, next_attempt and last_error to deliveries with reason, error (null if handled) and attempt (null: the first)."""
    attempt = F.coalesce("attempt", F.lit(1))
    failed, left = F.col("error").isNotNull(), attempt < max_attempts
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(~failed, "handled").when(left, "retried").otherwise("dead_lettered")
    out = messages.withColumn("outcome", outcome)
    return out.withColumn("next_attempt", F.when(F.col("outcome") == "retried", attempt + 1).otherwise(attempt)).withColumn(
        "last_error", F.when(F.col("outcome").isin("retried", "dead_lettered"), limited(F.col("error")))
    )


#: Routing key -> what its message is about, the id of that in the payload, and what stands before the reason; fixed values.
SUBJECTS = {
    "consent.parse.requested": ("import", "bulk_import_id", "Parsing failed: "),
    "consent.chunk.validate": ("chunk", "chunk_id", "Validation failed: "),
    "consent.import.assemble": ("import", "bulk_import_id", "Assembling failed: "),
}


def given_up(dead: DataFrame, most: int = 1000) -> DataFrame:
    """kind, id, status, failure_message: the imports and chunks that messages whose attempts are used up (routing_key, payload, last_error) leave failed."""
    kind, id_, before = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("")
    for key, (what, field, prefix) in SUBJECTS.items():
        own = F.col("routing_key") == key
        kind, id_, before = F.when(own, F.lit(what)).otherwise(kind), F.when(own, F.get_json_object("payload", f"$.{field}")).otherwise(id_), F.when(own, F.lit(prefix)).otherwise(before)
    reason = limited(F.concat(before, F.coalesce("last_error", F.lit(""))), most)
    found = dead.select(kind.alias("kind"), id_.alias("id"), reason.alias("reason")).where("kind is not null and id is not null")
    return found.groupBy("kind", "id").agg(F.lit("failed").alias("status"), F.min("reason").alias("failure_message"))


def route(messages: DataFrame, bindings: DataFrame) -> DataFrame:
    """A row per message and bound queue; unbound messages go nowhere.

    Bindings are configuration, some rows; the optimiser broadcasts them while they are.
    """
    return messages.join(bindings, ["exchange", "routing_key"])


def outbox_rows(messages: DataFrame) -> DataFrame:
    """Outbox rows of messages (exchange, routing_key, payload, created_at); the id is a digest, so reruns agree."""
    identity = F.sha2(F.concat_ws("|", "exchange", "routing_key", "payload", F.col("created_at").cast("string")), 256)
    return messages.select(
        identity.alias("id"), "exchange", "routing_key", "payload", F.lit(0).alias("failed_attempts"), F.lit(None).cast("string").alias("last_error"),
        "created_at", F.lit(None).cast("timestamp").alias("published_at"),
    )


def unpublished(outbox: DataFrame) -> DataFrame:
    return outbox.where("published_at is null")


def relay(outbox: DataFrame, fails: Column, limit: int, error: str = "not reachable", at: Column | None = None) -> DataFrame:
    """The oldest ``limit`` unpublished rows with state: published, failed or waiting; published_at (``at``, now if None) of those that went out.

    Rows go out in the order of their ids until one fails; those after it wait. The
    batch has at most ``limit`` rows, so one window over it is bounded.
    """
    batch = unpublished(outbox).orderBy("id").limit(limit).withColumn("_n", F.row_number().over(Window.orderBy("id")))
    first = F.min(F.when(fails, F.col("_n"))).over(Window.partitionBy())
    out = batch.withColumn("_f", first)
    state = F.when(F.col("_f").isNull() | (F.col("_n") < F.col("_f")), "published").when(F.col("_n") == F.col("_f"), "failed").otherwise("waiting")
    out = out.withColumn("state", state).drop("_n", "_f")
    out = out.withColumn("published_at", F.when(F.col("state") == "published", F.current_timestamp() if at is None else at))
    return out.withColumn("failed_attempts", F.col("failed_attempts") + F.when(F.col("state") == "failed", 1).otherwise(0)).withColumn(
        "last_error", F.when(F.col("state") == "failed", limited(F.lit(error))).otherwise(F.col("last_error"))
    )


def prune(outbox: DataFrame, now: Column, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Rows without those published more than ``keep_days`` ago; unpublished rows always stay."""
    return outbox.where(F.col("published_at").isNull() | (F.col("published_at") >= now - F.make_dt_interval(F.lit(keep_days))))


def dedup(messages: DataFrame) -> DataFrame:
    return messages.dropDuplicates(["message_id"])
