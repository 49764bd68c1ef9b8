"""Evidence frames derived from the test tables, by one text for Spark and for the SQL that results are compared with.

In a text, ns(ts) is a timestamp in nanoseconds, sha(x) a SHA-256 in hex, and arr(..) an array.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DAY = 86400 * 10**9
#: 2024-01-01, the first day of the event table.
T0 = 1704067200 * 10**9

TEXTS = {
    # candidates: every 20th repeats the one nine before it, every other 20th contradicts it, small values are rejected
    "cand": """SELECT e.event_id AS id, CAST(floor(e.event_id / 100) AS BIGINT) AS batch_id, e.event_id % 100 AS idx,
        'c' || CAST(CAST(floor(e.event_id / 10) AS BIGINT) % 8 AS STRING) AS collector_id,
        'k' || CAST(e.event_id - CASE WHEN e.event_id % 10 = 9 THEN 9 ELSE 0 END AS STRING) AS idempotency_key,
        s.event_type, ns(s.ts) AS device_ns, ((s.event_id * 37) % 7 - 3) * 1000 AS clock_offset_ms, (s.event_id * 13) % 3000 AS clock_error_ms,
        s.props AS payload, ns(e.ts) + 30000000000 AS received_ns, CASE WHEN e.value < 1 THEN 'EVENT_PAYLOAD_INVALID' END AS error_code,
        sha(s.event_type || '|' || s.props || '|' || CAST(((s.event_id * 37) % 7 - 3) * 1000 AS STRING)) AS content_hash
        FROM events e JOIN events s ON s.event_id = e.event_id - CASE WHEN e.event_id % 20 = 9 THEN 9 ELSE 0 END""",
    "raw": """SELECT event_id AS id, 'c' || CAST(CAST(floor(event_id / 10) AS BIGINT) % 8 AS STRING) AS collector_id, 'k' || CAST(event_id AS STRING) AS idempotency_key,
        CASE WHEN event_type = 'click' THEN 'activitywatch.event' ELSE event_type END AS event_type, ns(ts) AS device_ns,
        ((event_id * 37) % 7 - 3) * 1000 AS clock_offset_ms, (event_id * 13) % 3000 AS clock_error_ms, ns(ts) + 30000000000 AS received_ns,
        CASE WHEN event_type <> 'click' THEN props WHEN event_id % 5 = 0 THEN '{"bucket_id":"b","duration_seconds":"3"}' ELSE
        '{"bucket_id":"b' || CAST(user_id AS STRING) || '","bucket_type":"' || CASE WHEN event_id % 3 = 0 THEN 'afkstatus' ELSE 'window' END || '","source_event_id":' || CAST(event_id AS STRING)
        || ',"duration_seconds":' || CAST(event_id % 300 AS STRING) || ',"data":{"status":"' || CASE WHEN event_id % 2 = 0 THEN 'afk' ELSE 'x' END || '"}}' END AS payload, value, user_id FROM events""",
    "hb": """SELECT event_id AS id, 'c' || CAST(CAST(floor(event_id / 10) AS BIGINT) % 8 AS STRING) AS collector_id, CASE WHEN event_type = 'error' THEN 'idle' ELSE 'active' END AS state,
        ns(ts) AS device_start_ns, ns(ts) + (60 + event_id % 240) * 1000000000 AS device_end_ns, ((event_id * 37) % 7 - 3) * 1000 AS clock_offset_ms, (event_id * 13) % 3000 AS clock_error_ms,
        ns(ts) + 400000000000 AS received_ns, 'h' || CAST(event_id AS STRING) AS idempotency_key,
        CASE WHEN event_id % 7 = 0 THEN arr('obscured') WHEN event_id % 7 = 1 THEN arr('incomplete', 'corrupt') ELSE arr() END AS quality_flags FROM events""",
    "media": """SELECT doc_id AS id, doc_id AS media_segment_id, 'c' || CAST(doc_id % 8 AS STRING) AS collector_id, 's' || CAST(doc_id AS STRING) AS source_key, 1704067200000000000 + doc_id * 60000000000 AS device_start_ns,
        1704067200000000000 + doc_id * 60000000000 + (30 + doc_id % 90) * 1000000000 AS device_end_ns, 0 AS clock_offset_ms, (doc_id * 13) % 3000 AS clock_error_ms,
        1704067200000000000 + doc_id * 60000000000 + 600000000000 AS received_ns, sha(text) AS sha256, n_chars AS size_bytes, (30 + doc_id % 90) * 1000 AS duration_ms,
        'm' || CAST(doc_id % 3 AS STRING) AS metadata_hash, 'media/' || CAST(doc_id AS STRING) || '.mp4' AS path, 1704067200000000000 + doc_id * 3600000000000 AS created_ns FROM documents""",
    "ilog": """SELECT event_id AS id, 'k' || CAST(user_id AS STRING) AS ingest_key, CASE event_id % 7 WHEN 0 THEN 'discovered' WHEN 1 THEN 'pending' WHEN 2 THEN 'validated' WHEN 3 THEN 'accepted' WHEN 4 THEN 'accepted'
        WHEN 5 THEN 'quarantined' ELSE 'failed' END AS status, CASE WHEN event_id % 7 = 5 THEN 'MEDIA_HASH_MISMATCH' WHEN event_id % 7 = 6 THEN 'MEDIA_TOO_LARGE' END AS error_code,
        'staging/' || CAST(event_id % 50 AS STRING) AS path, user_id AS media_segment_id, ns(ts) AS occurred_ns FROM events""",
    "slog": """SELECT o_orderkey AS id, o_custkey AS media_segment_id, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'missing' ELSE 'restored' END AS status,
        o_orderpriority AS reason_code, ns(o_orderdate) AS occurred_ns FROM orders""",
    "faults": """SELECT event_id AS id, 'm' || CAST(user_id % 5 AS STRING) AS module, CASE WHEN value > 20 THEN 'critical' ELSE 'warning' END AS severity, event_type AS status,
        'E' || CAST(event_id % 4 AS STRING) AS error_code, props AS detail, ns(ts) AS occurred_ns FROM events WHERE event_type = 'error'""",
    "modules": "SELECT event_id AS id, 'm' || CAST(user_id % 6 AS STRING) AS module, event_type AS status, 'r' || CAST(event_id % 3 AS STRING) AS reason_code FROM events",
    "modes": """SELECT event_id AS id, 'h' || CAST(user_id % 3 AS STRING) AS host_id, CASE WHEN event_type IN ('click', 'view') THEN 'normal' WHEN event_type = 'error' THEN 'degraded' ELSE 'exam' END AS mode,
        'r' || CAST(event_id % 2 AS STRING) AS reason_code FROM events""",
    "retention": """SELECT event_id AS id, user_id AS media_segment_id, 'media/' || CAST(user_id AS STRING) || '.mp4' AS path, CASE event_id % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'deleted' ELSE 'skipped' END AS status,
        'r' || CAST(event_id % 4 AS STRING) AS reason_code FROM events""",
    "samples": """SELECT event_id AS id, 'h' || CAST(user_id % 3 AS STRING) AS host_id, CAST(floor(ns(ts) / 86400000000000) AS BIGINT) AS day, ns(ts) AS at_ns,
        CAST(floor(event_id / 50) AS BIGINT) AS pid, event_id * 0.5 + value * 0.01 AS cpu_s, CASE WHEN event_type = 'error' AND value > 30 THEN 'degraded' ELSE 'healthy' END AS status,
        CAST(floor(event_id / 300) AS BIGINT) AS boot, CASE WHEN event_type = 'error' THEN CAST(floor(event_id / 4) AS BIGINT) END AS crash_ns,
        value AS working_set, CASE WHEN event_id % 10 <> 0 THEN value * 2 END AS private_bytes, CAST(event_id % 97 AS DOUBLE) AS handles, 1000 - value AS free_bytes FROM events""",
    "awpages": """SELECT 'b' || CAST(user_id AS STRING) AS bucket_id, CAST(floor(event_id / 2) AS BIGINT) AS id, event_id % 2 AS page, CASE WHEN event_id % 40 = 1 THEN 'other' ELSE CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING) END AS timestamp,
        CASE WHEN event_id % 60 = 3 THEN props ELSE 'd' END AS data, value AS duration FROM events""",
    "revs": """SELECT 'b' || CAST(user_id % 4 AS STRING) AS bucket_id, user_id AS id, event_id AS seq, CASE WHEN event_id % 25 = 7 THEN 'other' ELSE 'same' END AS content, round(value) + CAST(floor(event_id / 400) AS BIGINT) AS duration FROM events""",
}
#: Collectors, their windows (all days 00:00-24:00 for some, working hours for others), and excluded time.
TEXTS["collectors"] = """SELECT 'c' || CAST(r_regionkey AS STRING) AS collector_id, CASE WHEN r_regionkey % 2 = 0 THEN 'activity' ELSE 'media' END AS kind, 300000000000 AS heartbeat_period_ns,
    60000000000 AS allowed_lateness_ns, 1800000000000 AS offline_after_ns, CASE WHEN r_regionkey = 4 THEN 'America/New_York' ELSE 'UTC' END AS timezone FROM region"""
#: All collectors of the events, configured by their numbers.
TEXTS["fleet"] = """SELECT DISTINCT 'c' || CAST(CAST(floor(event_id / 10) AS BIGINT) % 8 AS STRING) AS collector_id, CASE WHEN CAST(floor(event_id / 10) AS BIGINT) % 2 = 0 THEN 'activity' ELSE 'media' END AS kind,
    300000000000 AS heartbeat_period_ns, 60000000000 AS allowed_lateness_ns, 1800000000000 AS offline_after_ns, CASE WHEN CAST(floor(event_id / 10) AS BIGINT) % 8 = 4 THEN 'America/New_York' ELSE 'UTC' END AS timezone FROM events"""
TEXTS["exclusions"] = f"SELECT {T0} + n_nationkey * 100000000000000 AS start_ns, {T0} + n_nationkey * 100000000000000 + (1 + n_nationkey % 3) * 3600000000000 AS end_ns FROM nation WHERE n_nationkey < 20"
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _spark_text(text: str) -> str:
    text = re.sub(r"\bns\((\w+(?:\.\w+)?)\)", r"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ)) * 1000)", text)
    text = text.replace("arr()", "CAST(array() AS ARRAY<STRING>)")
    return re.sub(r"\barr\(", "array(", re.sub(r"\bsha\(", "sha2_256(", text)).replace("sha2_256(", "_sha(")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's frame, or a table."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TEXTS[name]
    used = [t for t in _TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    held: list[str] = []  # quoted texts, so that their braces and words stay
    text = re.sub(r"'[^']*'", lambda m: (held.append(m.group(0)), f"__{len(held) - 1}__")[1], text)
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    text = _spark_text(text)
    text = re.sub(r"_sha\(((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*)\)", r"sha2(\1, 256)", text)
    for i, x in enumerate(held):
        text = text.replace(f"__{i}__", x.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def _duck_text(text: str) -> str:
    text = re.sub(r"\bns\((\w+(?:\.\w+)?)\)", r"(epoch_us(\1) * 1000)", text)
    text = re.sub(r"\barr\(\)", "CAST([] AS VARCHAR[])", text)
    text = re.sub(r"\barr\(([^()]*)\)", r"[\1]", text)
    return re.sub(r"\bsha\(", "sha256(", text)


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body with the adapters that it names as common table expressions."""
    parts = ", ".join(f"{n} AS ({_duck_text(TEXTS[n])})" for n in names)
    body = _duck_text(body.strip())
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"
