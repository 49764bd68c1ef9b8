"""Texts that are one JSON object with known keys, and texts that only look like it."""

from pyspark.sql import functions as F
from tidemark.operators import facts, validate

GOOD = ['{"a":1}', ' {"a":1}\n', '{"a":null}', "{}", '{"a":{"b":[{"c":1}]}}', '{"a":"}] {"}', '{"b":[1,2],"a":"\\""}']
BAD = ['{"a":1}{"a":2}', '{"a":1},{"a":2}', '{"a":1} x}', '{"a":1}] x}', '{"a":1}],[{"a":1}', '{"a":1},"e":1,"o":{"a":1}', '{"a":1,"a":2}', '{"a":{"c":1,"c":2}}', '[{"a":1}]', "", "null", '{"a":1,}', '{"A":1}', '{"c":1}', "{'a':1}", None]


def test_strict_objects(spark):
    df = spark.createDataFrame([(t, True) for t in GOOD] + [(t, False) for t in BAD], "raw string, want boolean")
    got = df.select("raw", "want", validate.strict_object(F.col("raw"), ("a", "b")).alias("ok")).collect()
    assert [(r.raw, r.ok) for r in got] == [(r.raw, r.want) for r in got]
    assert [r[0] for r in spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',)], "raw string").select(validate.strict_object(F.col("raw"), ("a", "b"), required=True)).collect()] == [False, True]


def test_nesting(spark):
    texts = {"": 0, "[]": 1, '{"a":[{"b":"]]"}]}': 3, "[" * 16 + "]" * 16: 16, '{"a\\"[[":{}}': 2, "[[],[],{}]": 2}
    for most in (0, 1, 2, 3, 16):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", validate.within_depth(F.col("t"), most).alias("ok")).collect()
        assert {r.t: r.ok for r in got} == {t: d <= most for t, d in texts.items()}


def test_first_failures_go_by_rank(spark):
    """Records that break several rules have the code of the first in the order of the rules."""
    at = '"device_timestamp_raw":"2024-05-01T00:00:00Z"'
    rows = {
        '{"schema_version":2,"collector_id":" c","event_type":"",' + at + ',"clock_offset_ms":0,"clock_error_ms":0,"idempotency_key":"k","payload":{}}': "EVENT_SCHEMA_UNSUPPORTED",
        '{"schema_version":1,"collector_id":" c","event_type":"",' + at + ',"clock_offset_ms":0,"clock_error_ms":0,"idempotency_key":"k","payload":{}}': "EVENT_COLLECTOR_INVALID",
        '{"schema_version":1,"collector_id":"c","event_type":"","device_timestamp_raw":"x","clock_offset_ms":0,"clock_error_ms":-1,"idempotency_key":"k","payload":[]}': "EVENT_TYPE_INVALID",
        '{"schema_version":1,"collector_id":"c","event_type":"t","device_timestamp_raw":"x","clock_offset_ms":99999999999999,"clock_error_ms":-1,"idempotency_key":"k","payload":{}}': "EVENT_DEVICE_TIME_INVALID",
        '{"schema_version":1,"collector_id":"c","event_type":"t",' + at + ',"clock_offset_ms":99999999999999,"clock_error_ms":-1,"idempotency_key":"","payload":{}}': "EVENT_CLOCK_OFFSET_INVALID",
        '{"schema_version":1,"collector_id":"c","event_type":"t",' + at + ',"clock_offset_ms":0,"clock_error_ms":-1,"idempotency_key":"","payload":7}': "EVENT_CLOCK_ERROR_INVALID",
        '{"schema_version":1,"collector_id":"c","event_type":"t",' + at + ',"clock_offset_ms":0,"clock_error_ms":0,"idempotency_key":"","payload":7}': "EVENT_IDEMPOTENCY_KEY_INVALID",
        '{"schema_version":1,"collector_id":"c","event_type":"t",' + at + ',"clock_offset_ms":0,"clock_error_ms":0,"idempotency_key":"k","payload":7}': "EVENT_PAYLOAD_INVALID",
        '{"schema_version":1,"collector_id":"c","event_type":"t",' + at + ',"clock_offset_ms":0,"clock_error_ms":0,"idempotency_key":"k","payload":{"a":' + "[" * 16 + "]" * 16 + "}}": "EVENT_PAYLOAD_TOO_DEEP",
        '{"schema_version":2,"x":1}': "EVENT_JSON_INVALID",
    }
    got = validate.validate_events(spark.createDataFrame([(t,) for t in rows], "raw string")).collect()
    assert {r.raw: r.error_code for r in got} == rows


def test_rejected_rows_without_keys_are_not_grouped(spark):
    rows = [(1, "c", "k", "h", None), (2, "c", "k", "h", None), (3, "c", "k", "g", None), (4, None, None, None, "X"), (5, None, None, None, "X"), (6, "d", "k", "h", None)]
    df = spark.createDataFrame(rows, "id long, collector_id string, idempotency_key string, content_hash string, error_code string")
    old = spark.createDataFrame([(9, "d", "k", "other")], "id long, collector_id string, idempotency_key string, content_hash string")
    got = {r.id: (r.status, r.fact_id) for r in facts.resolve_idempotent(df, "id", old).collect()}
    assert got == {1: ("accepted", 1), 2: ("duplicate", 1), 3: ("conflict", 1), 4: ("rejected", None), 5: ("rejected", None), 6: ("conflict", 9)}
