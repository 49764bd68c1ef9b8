"""Scalars and validation rules on small inputs, nulls and broken texts included."""

from pyspark.sql import functions as F
from tidemark.functions import scalars as X
from tidemark.operators import activity, facts, statelog, timeline, validate

EVENT = '{"schema_version":1,"collector_id":"c","event_type":"t","device_timestamp_raw":"%s","clock_offset_ms":0,"clock_error_ms":0,"idempotency_key":"%s","payload":%s}'


def _codes(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    return [r.error_code for r in validate.validate_events(df).orderBy("i").collect()]


def test_event_shapes(spark):
    at = "2033-11-05T23:59:59.5-03:30"
    good = EVENT % (at, "k", '{"collector_id":[],"Key":{"key":null}}')  # names of the record mean nothing inside a payload
    bad = "EVENT_JSON_INVALID"
    twice = good.replace('"Key":{', '"Key":{"key":0,')
    texts = [good, None, "", " ", "null", "7", good + ",", "\n" + good, good.replace("{", '{"more":true,', 1), good.replace("clock_error_ms", "Clock_Error_Ms"), twice, good + good, "x" * 65537]
    assert _codes(spark, *texts) == [None, bad, bad, bad, bad, bad, bad, None, bad, bad, bad, bad, "EVENT_TOO_LARGE"]
    assert _codes(spark, EVENT % (at, "k", "[" * 20 + "]" * 20), EVENT % (at, "k", '{"a":' * 17 + "1" + "}" * 17)) == ["EVENT_PAYLOAD_INVALID", "EVENT_PAYLOAD_TOO_DEEP"]


def test_heartbeats_that_are_absent(spark):
    known = spark.createDataFrame([("c", 10**12)], "collector_id string, heartbeat_period_ns long")
    df = spark.createDataFrame([(0, None), (1, ""), (2, " " * 65537)], "i int, raw string")
    assert [r.error_code for r in validate.validate_heartbeats(df, known).orderBy("i").collect()] == ["HEARTBEAT_JSON_INVALID", "HEARTBEAT_JSON_INVALID", "HEARTBEAT_TOO_LARGE"]


def test_known_offsets(spark):
    texts = ["2026-07-18T02:00:00Z", "2026-07-18T02:00:00+00:00", "2026-07-18T02:00:00-00:00", "2026-07-18T02:00:00", "2026-07-18", " 2026-07-18T02:00:00Z", "2026-02-30T02:00:00Z", "2026-07-18T10:00:00.1234567891+08:00", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    base = 1784340000 * 10**9
    assert [r[0] for r in df.orderBy("i").select(X.known_offset_ns(F.col("t"))).collect()] == [base, base, None, None, None, None, None, base + 123456789, None]


def test_times_with_line_breaks_and_broken_zones(spark):
    texts = ["2026-07-18T02:00:00Z\n", "2026-07-18T02:00:00+08:00\n", "2026-07-18T02:00:00.5Z", "2026-07-18T02:00:00.25-01:30", "2026-07-18T02:00:00+0100", "2026-07-18T02:00:00.Z", "Z", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    base = 1784340000 * 10**9
    assert [r[0] for r in df.orderBy("i").select(X.known_offset_ns(F.col("t"))).collect()] == [None, None, base + 5 * 10**8, base + 5400 * 10**9 + 25 * 10**7, None, None, None, None]


def test_identifiers_and_numbers(spark):
    texts = ["c1", "a b", " a", "a\n", "\u00a0a", "\u00e9", "a\x7f", "", "x" * 9, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(X.valid_identifier(F.col("t"), 8)).collect()] == [True, True, False, False, False, True, False, False, False, False]
    numbers = ["1", "1.0", "1e2", "0.25", '"1"', "true", "null", "9007199254740993", "123456789012345678901234567890"]
    df = spark.createDataFrame([(i, '{"n":%s}' % t) for i, t in enumerate(numbers)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(X.json_number(F.try_parse_json("t"), "$.n")).collect()] == [1.0, 1.0, 100.0, 0.25, None, None, None, 9007199254740992.0, 123456789012345678901234567890.0]


def test_strict_look_reads_a_text_twice_only(spark):
    """Once as an element, once as a field; an expression that is named again in a rule is computed again."""
    assert str(validate.strict_object(F.col("raw"), ("a", "b"), required=True)).count("from_json") == 2


def test_payload_is_parsed_once_below_a_filter(spark):
    """Facts are those with a positive end; each use of the seconds in that filter must not parse the payload anew."""
    good = '{"bucket_id":"b","bucket_type":"afkstatus","source_event_id":1,"duration_seconds":%s,"data":{"status":"afk"}}'
    rows = [(1, "activitywatch.event", good % 5), (2, "activitywatch.event", good % 0), (3, "activitywatch.event", good % "2.5"), (4, "activitywatch.event", "{"), (5, "activitywatch.event", None), (6, "view", good % 5)]
    events = spark.createDataFrame(rows, "id long, event_type string, payload string").selectExpr("*", "'c' as collector_id", "id * 10 as device_ns", "0L as clock_offset_ms", "0L as clock_error_ms", "0L as received_ns")
    entries = timeline.project_events(events)
    assert [(r.source_id, r.end_ns) for r in entries.orderBy("source_id").collect()] == [(1, 5_000_000_010), (2, 20), (3, 2_500_000_030), (4, None), (5, None), (6, None)]
    out = timeline.coverage_facts(entries)
    assert [(r.stable_id, r.end_ns, r.reason_code) for r in out.orderBy("stable_id").collect()] == [("event:1", 5_000_000_010, "ACTIVITYWATCH_AFK"), ("event:3", 2_500_000_030, "ACTIVITYWATCH_AFK")]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 2  # the seconds, and the texts of the facts


def test_fixed_width_time(spark):
    df = spark.createDataFrame([(0,), (-1,), (1784340000123456789,)], "n long")
    assert [r[0] for r in df.select(X.fixed_utc(F.col("n"))).collect()] == ["1970-01-01T00:00:00.000000000Z", "1969-12-31T23:59:59.999999999Z", "2026-07-18T02:00:00.123456789Z"]


def test_outcomes_in_order_and_replay(spark):
    at = "2033-11-05T21:29:59-06:00"
    texts = [EVENT % (at, "k", '{"a":1}'), EVENT % ("2033-11-05T21:29:59", "k", '{"a":1}'), EVENT % (at, "k", '{"a":1}'), EVENT % (at, "k", '{"a":2}')]
    df = validate.validate_events(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, raw string"))
    out = facts.resolve_idempotent(df, "id")
    assert [(r.status, r.fact_id) for r in out.orderBy("id").collect()] == [("accepted", 0), ("rejected", None), ("duplicate", 0), ("conflict", 0)]
    stored = out.where("status = 'accepted'")
    again = facts.resolve_idempotent(df.where("id in (0, 2)"), "id", stored)
    assert {r.status for r in again.collect()} == {"duplicate"}
    assert facts.resolve_idempotent(df.limit(0), "id").count() == 0


def test_pages_do_not_lose_rows(spark):
    df = spark.range(25).withColumn("k", F.col("id") % 3)
    seen, after = [], None
    while True:
        rows = [(r.k, r.id) for r in timeline.page(df, ("k", "id"), after, 10).collect()]
        seen += rows[:10]
        if len(rows) <= 10:
            break
        after = rows[9]
    assert sorted(seen) == sorted((r.k, r.id) for r in df.collect()) and len(set(seen)) == 25


def test_revisions_and_prefix(spark):
    rows = spark.createDataFrame([("b", 1, i, "x", d) for i, d in enumerate((30.0, 40.0, 40.0, 35.0, 45.0))], "bucket_id string, id long, seq long, content string, duration double")
    assert [r.status for r in activity.revisions(rows).orderBy("seq").collect()] == ["base", "revision", "duplicate", "error", "revision"]
    spans = spark.createDataFrame([("x", i, t, t + long) for i, (t, long) in enumerate([(3, 4), (10, 90), (11, 1), (40, 2)])] + [("y", 9, 50, 60)], "bucket string, id long, t long, e long")
    ids = lambda cutoff: sorted(r.id for r in activity.stable_prefix(spans, "bucket", ("t", "id"), "e", cutoff).collect())
    assert (ids(7), ids(8), ids(100), ids(101)) == ([], [0], [0, 9], [0, 1, 2, 3, 9])


def test_levels_and_latest(spark):
    df = spark.createDataFrame([(1, "h", 100.0), (2, "h", 5.0), (3, "h", 50.0), (4, "h", None)], "id long, host string, free double")
    levels = df.withColumn("level", statelog.disk_level(F.col("free"), 50, 20, 10))
    assert [r.level for r in levels.orderBy("id").collect()] == ["normal", "reserve", "warning", "normal"]
    assert [r.id for r in statelog.latest(df, ("host",), "id").collect()] == [4]
    assert statelog.latest(df.limit(0), ("host",), "id").count() == 0


def test_queries_over_all_rows_leave_none_out(spark, sf):
    """Rows by hand: every exam row is an intervention and every sample a backup, an exercise; half of the documents are old enough to be orphans."""
    from tidemark.plans import QUERIES

    events = [r.event_type for r in spark.read.parquet(f"{sf}/events.parquet").select("event_type").collect()]
    exam = sum(k not in ("click", "view", "error") for k in events)
    assert QUERIES["q11_interventions_all"](spark, sf).count() == exam
    assert sum(r.interventions for r in QUERIES["q10_final_verdict_all"](spark, sf).collect()) == exam
    assert QUERIES["w9_backup_gaps_all"](spark, sf).count() == QUERIES["q6_exercise_results_all"](spark, sf).count() == len(events)
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert QUERIES["j9_orphans_all"](spark, sf).count() >= sum(i < (min(ids) + max(ids)) // 2 for i in ids) - 50
