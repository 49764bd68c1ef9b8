"""Validation of incoming JSON records: one stage that gives fields, hashes and the first failure's code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clock_uncertain, first_failure, json_number, json_text, known_offset_ns, merged_flags, valid_identifier, valid_source_identifier

__all__ = ["batch_sizes", "clock_uncertain", "outcomes", "strict_object", "validate_events", "validate_heartbeats", "validate_sidecars"]

YEAR_MS, DAY_MS = 365 * 24 * 3600 * 1000, 24 * 3600 * 1000
EVENT_FIELDS = ("schema_version", "collector_id", "event_type", "device_timestamp_raw", "clock_offset_ms", "clock_error_ms", "idempotency_key", "payload")
HEARTBEAT_FIELDS = ("schema_version", "collector_id", "state", "device_start_raw", "device_end_raw", "clock_offset_ms", "clock_error_ms", "idempotency_key", "quality_flags")
SIDECAR_FIELDS = ("schema_version", "complete", "collector_id", "source_idempotency_key", "device_start_raw", "device_end_raw", "clock_offset_ms", "clock_error_ms", "size_bytes", "sha256", "media_type")
# Fixed values of the record format.
FLAGS = ("obscured", "corrupt", "clock_uncertain", "incomplete")
EVENT_CODES = {
    "size": "EVENT_TOO_LARGE", "json": "EVENT_JSON_INVALID", "schema": "EVENT_SCHEMA_UNSUPPORTED", "collector": "EVENT_COLLECTOR_INVALID",
    "type": "EVENT_TYPE_INVALID", "time": "EVENT_DEVICE_TIME_INVALID", "offset": "EVENT_CLOCK_OFFSET_INVALID", "error": "EVENT_CLOCK_ERROR_INVALID",
    "key": "EVENT_IDEMPOTENCY_KEY_INVALID", "payload": "EVENT_PAYLOAD_INVALID", "deep": "EVENT_PAYLOAD_TOO_DEEP", "conflict": "EVENT_IDEMPOTENCY_CONFLICT",
    "batch_empty": "EVENT_BATCH_EMPTY", "batch_large": "EVENT_BATCH_TOO_LARGE",
}
HEARTBEAT_CODES = {
    "size": "HEARTBEAT_TOO_LARGE", "json": "HEARTBEAT_JSON_INVALID", "schema": "HEARTBEAT_SCHEMA_UNSUPPORTED", "collector": "HEARTBEAT_COLLECTOR_INVALID",
    "state": "HEARTBEAT_STATE_INVALID", "time": "HEARTBEAT_TIME_INVALID", "duration": "HEARTBEAT_DURATION_INVALID", "clock": "HEARTBEAT_CLOCK_INVALID",
    "key": "HEARTBEAT_IDEMPOTENCY_KEY_INVALID", "flags": "HEARTBEAT_QUALITY_FLAGS_INVALID", "conflict": "HEARTBEAT_IDEMPOTENCY_CONFLICT",
}


def within_depth(raw: Column, most: int) -> Column:
    """Whether objects and arrays nest at most so deep in a JSON text: brackets outside of quoted text, taken off pair by pair from inside.

    Texts with no more opening brackets than that, as most are, are not looked at.
    """
    opened = F.length(raw) - F.length(F.translate(raw, "[{", ""))
    left = F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), '"[^"]*"', "")
    left = F.regexp_replace(left, r"[^\[\]{}]", "")
    for _ in range(most):
        left = F.regexp_replace(left, r"\[\]|\{\}", "")
    return F.when(opened <= most, F.lit(True)).otherwise(left == "")


def strict_object(raw: Column, fields: tuple[str, ...], required: bool = False, parsed: Column | None = None) -> Column:
    """Whether a text is one JSON object with none but these keys, no key twice at any level, and nothing after it.

    ``parsed`` is try_parse_json(raw) if that is at hand: it refuses keys that come twice, but reads on over what
    follows the object.  So the text must also be read as the only element of an array, and, where it could close
    that array itself, as a field of an object that has another field after it.
    """
    parsed = F.try_parse_json(raw) if parsed is None else parsed
    read = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<map<string,string>>")
    after = F.from_json(F.concat(F.lit('{"o":'), raw, F.lit(',"e":1}')), "o map<string,string>, e int")["e"]
    names = F.array(*(F.lit(f) for f in fields))

    def known(m: Column) -> Column:
        keys = F.map_keys(m)
        only = F.size(F.array_except(keys, names)) == 0
        return only & (F.size(keys) == len(fields)) if required else only

    # one element and none but these keys, told in one expression: named twice, the text would be read twice
    ok = parsed.isNotNull() & raw.rlike(r"(?s)^\s*\{.*\}\s*$") & (~raw.rlike(r"\}\s*\]") | (after == 1)) & (F.transform(read, known) == F.array(F.lit(True)))
    return F.coalesce(ok, F.lit(False))


def _int(v: Column, path: str) -> Column:
    n = json_number(v, path)
    return F.when(n == F.floor(n), n.cast("long"))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the JSON of these columns, as c0, c1, ..."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def validate_events(df: DataFrame, max_bytes: int = 65536, max_depth: int = 16, check_depth: bool = True) -> DataFrame:
    """df (.., raw) with fields, device_ns, payload, payload_hash, content_hash and error_code (null: valid).

    A null or empty raw is not JSON.  Payload texts are kept as they came; hashes see keys in one order.
    """
    codes = EVENT_CODES
    df = df.withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    payload = F.try_variant_get(v, "$.payload", "variant")
    df = df.withColumns({
        "schema_version": _int(v, "$.schema_version"), "collector_id": json_text(v, "$.collector_id"), "event_type": json_text(v, "$.event_type"),
        "device_timestamp_raw": json_text(v, "$.device_timestamp_raw"), "clock_offset_ms": _int(v, "$.clock_offset_ms"), "clock_error_ms": _int(v, "$.clock_error_ms"),
        "idempotency_key": json_text(v, "$.idempotency_key"), "payload": F.get_json_object("raw", "$.payload"), "payload_kind": F.schema_of_variant(payload),
        "payload_hash": F.sha2(F.to_json(payload), 256),
    })
    df = df.withColumn("device_ns", known_offset_ns(F.col("device_timestamp_raw")))
    offset, error = F.col("clock_offset_ms"), F.col("clock_error_ms")
    code = first_failure(
        (F.coalesce(F.octet_length("raw"), F.lit(0)) <= max_bytes, codes["size"]), (strict_object(F.col("raw"), EVENT_FIELDS, parsed=v), codes["json"]), (F.col("schema_version") == 1, codes["schema"]),
        (valid_identifier(F.col("collector_id"), 128), codes["collector"]), (valid_identifier(F.col("event_type"), 128), codes["type"]),
        (F.col("device_ns").isNotNull(), codes["time"]), (offset.between(-YEAR_MS, YEAR_MS), codes["offset"]), (error.between(0, DAY_MS), codes["error"]),
        (valid_identifier(F.col("idempotency_key"), 256), codes["key"]), (F.col("payload_kind").startswith("OBJECT"), codes["payload"]),
        (within_depth(F.coalesce("payload", F.lit("")), max_depth) if check_depth else F.lit(True), codes["deep"]),
    )
    hashed = content_hash(*(F.col(c) for c in ("schema_version", "collector_id", "event_type", "device_timestamp_raw", "clock_offset_ms", "clock_error_ms", "idempotency_key", "payload_hash")))
    return df.withColumns({"error_code": code, "content_hash": hashed}).drop("v", "payload_kind")


def validate_heartbeats(df: DataFrame, collectors: DataFrame, max_bytes: int = 65536) -> DataFrame:
    """df (.., raw) with heartbeat fields, start_ns, end_ns, sorted quality_flags, content_hash and error_code.

    collectors (collector_id, heartbeat_period_ns) is configuration, small by nature.
    """
    codes = HEARTBEAT_CODES
    v = F.try_parse_json("raw")
    df = df.withColumn("v", v)
    v = F.col("v")
    df = df.withColumns({
        "schema_version": _int(v, "$.schema_version"), "collector_id": json_text(v, "$.collector_id"), "state": json_text(v, "$.state"),
        "device_start_raw": json_text(v, "$.device_start_raw"), "device_end_raw": json_text(v, "$.device_end_raw"), "clock_offset_ms": _int(v, "$.clock_offset_ms"),
        "clock_error_ms": _int(v, "$.clock_error_ms"), "idempotency_key": json_text(v, "$.idempotency_key"), "flags": F.try_variant_get(v, "$.quality_flags", "array<string>"),
    })
    df = df.withColumns({"start_ns": known_offset_ns(F.col("device_start_raw")), "end_ns": known_offset_ns(F.col("device_end_raw"))})
    df = df.join(collectors.select(F.col("collector_id").alias("_known"), F.col("heartbeat_period_ns").alias("_period")), F.col("collector_id") == F.col("_known"), "left")
    length = F.col("end_ns") - F.col("start_ns")
    flags = F.col("flags")
    allowed = F.array(*(F.lit(f) for f in FLAGS))
    code = first_failure(
        (F.coalesce(F.octet_length("raw"), F.lit(0)) <= max_bytes, codes["size"]), (strict_object(F.col("raw"), HEARTBEAT_FIELDS, parsed=v), codes["json"]), (F.col("schema_version") == 1, codes["schema"]),
        (F.col("_known").isNotNull() & valid_identifier(F.col("collector_id"), 128), codes["collector"]), (F.col("state").isin("active", "idle"), codes["state"]),
        (F.col("start_ns").isNotNull() & F.col("end_ns").isNotNull(), codes["time"]), ((length > 0) & (length <= F.col("_period")), codes["duration"]),
        (F.col("clock_offset_ms").between(-YEAR_MS, YEAR_MS) & F.col("clock_error_ms").between(0, DAY_MS), codes["clock"]), (valid_identifier(F.col("idempotency_key"), 256), codes["key"]),
        ((F.size(F.array_except(flags, allowed)) == 0) & (F.size(F.array_distinct(flags)) == F.size(flags)), codes["flags"]),
    )
    df = df.withColumns({"error_code": code, "quality_flags": merged_flags(flags)})
    hashed = content_hash(*(F.col(c) for c in ("schema_version", "collector_id", "state", "device_start_raw", "device_end_raw", "clock_offset_ms", "clock_error_ms", "idempotency_key", "quality_flags")))
    return df.withColumn("content_hash", hashed).drop("v", "flags", "_known", "_period")


def validate_sidecars(df: DataFrame, max_duration_ns: int) -> DataFrame:
    """df (.., raw) with sidecar fields, start_ns, end_ns, fingerprint, status (null: go on) and error_code.

    An incomplete sidecar is pending; any other failure is quarantined.
    """
    df = df.withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    complete = F.when(F.schema_of_variant(F.try_variant_get(v, "$.complete", "variant")) == "BOOLEAN", F.try_variant_get(v, "$.complete", "boolean"))
    texts = ("collector_id", "source_idempotency_key", "device_start_raw", "device_end_raw", "sha256", "media_type")
    df = df.withColumns({"complete": complete, **{t: json_text(v, f"$.{t}") for t in texts}, **{n: _int(v, f"$.{n}") for n in ("schema_version", "clock_offset_ms", "clock_error_ms", "size_bytes")}})
    df = df.withColumns({"start_ns": known_offset_ns(F.col("device_start_raw")), "end_ns": known_offset_ns(F.col("device_end_raw"))})
    length = F.col("end_ns") - F.col("start_ns")
    bad = "MEDIA_SIDECAR_INVALID"
    code = first_failure(
        (strict_object(F.col("raw"), SIDECAR_FIELDS, required=True, parsed=v) & F.col("complete").isNotNull() & (F.col("schema_version") == 1), bad), (F.col("complete"), "MEDIA_SIDECAR_INCOMPLETE"),
        (valid_source_identifier(F.col("collector_id"), 128) & valid_source_identifier(F.col("source_idempotency_key"), 256), bad),
        (F.col("start_ns").isNotNull() & F.col("end_ns").isNotNull() & (length > 0) & (length <= max_duration_ns), "MEDIA_TIME_INVALID"),
        (F.col("clock_offset_ms").between(-YEAR_MS, YEAR_MS) & F.col("clock_error_ms").between(0, DAY_MS), "MEDIA_TIME_INVALID"),
        (F.col("size_bytes") > 0, bad), (F.col("sha256").rlike("^[0-9a-f]{64}$"), bad), (F.col("media_type") == "video", "MEDIA_TYPE_INVALID"),
    )
    print_of = content_hash(*(F.col(c) for c in SIDECAR_FIELDS))
    df = df.withColumns({"error_code": code, "fingerprint": F.when(code.isNull(), print_of)})
    status = F.when(F.col("error_code") == "MEDIA_SIDECAR_INCOMPLETE", "pending").when(F.col("error_code").isNotNull(), "quarantined")
    return df.withColumn("status", status).drop("v")


def batch_sizes(df: DataFrame, batches: DataFrame, most: int = 100) -> DataFrame:
    """(batch_id, n, error_code) of each batch: empty and oversize ones are rejected whole."""
    n = df.groupBy("batch_id").agg(F.count("*").alias("n"))
    out = batches.select("batch_id").distinct().join(n, "batch_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("error_code", F.when(F.col("n") == 0, EVENT_CODES["batch_empty"]).when(F.col("n") > most, EVENT_CODES["batch_large"]))


def outcomes(results: DataFrame) -> DataFrame:
    """Number of rows of each status and error code; rejected rows are the dead letters."""
    return results.groupBy("status", "error_code").agg(F.count("*").alias("n"))
