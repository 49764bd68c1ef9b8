"""Queries of validation, idempotent append, filters, scalars and the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import facts, timeline, validate
from ..sources import readers, sinks
from ..sources.keyed import Keyed, Pages
from ..sources.paths import work_dir
from .adapters import DAY, T0, frame, sql

C = F.col


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return facts.resolve_idempotent(frame(s, d, "cand"), "id")


RES = """WITH w AS (SELECT *, row_number() OVER (PARTITION BY collector_id, idempotency_key, error_code IS NULL ORDER BY id) AS n,
  first_value(id) OVER (PARTITION BY collector_id, idempotency_key, error_code IS NULL ORDER BY id) AS f, first_value(content_hash) OVER (PARTITION BY collector_id, idempotency_key, error_code IS NULL ORDER BY id) AS fh FROM cand),
res AS (SELECT *, CASE WHEN error_code IS NOT NULL THEN 'rejected' WHEN n = 1 THEN 'accepted' WHEN fh = content_hash THEN 'duplicate' ELSE 'conflict' END AS status, CASE WHEN error_code IS NULL THEN f END AS fact_id FROM w)
"""


def _event_texts(s: SparkSession, d: str) -> DataFrame:
    """Events as JSON texts, each tenth of them broken in another way."""
    e = s.read.parquet(f"{d}/events.parquet")
    k = C("event_id") % 12
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    key = C("event_id").cast("string")
    head = text('{"schema_version":', F.when(k == 5, "2").otherwise("1"), ',"collector_id":"', F.when(k == 6, " c").otherwise("c1"), '","event_type":"', F.when(k == 10, "").otherwise("t"), '","device_timestamp_raw":"', F.when(k == 7, "2024-01-01T00:00:00-00:00").otherwise("2024-01-01T00:00:00+02:00"), '"')
    mid = text(',"clock_offset_ms":', F.when(k == 8, "99999999999").otherwise("5"), ',"clock_error_ms":', F.when(k == 9, '"5"').otherwise("5"), ',"idempotency_key":"k', key, '"')
    tail = F.when(k == 1, ',"payload":{},"payload":{}}').when(k == 2, ',"Payload":{},"payload":{}}').when(k == 3, ',"payload":{"a":{"b":1,"b":2}}}').when(k == 4, ',"payload":{}} x').when(k == 11, ',"payload":[1]}').otherwise(text(',"payload":', C("props"), "}"))
    return e.select(C("event_id").alias("id"), text(head, mid, tail).alias("raw"))


def _i1(s: SparkSession, d: str) -> DataFrame:
    return _event_texts(s, d).select("id", validate.strict_object(C("raw"), validate.EVENT_FIELDS).alias("ok"))


def _i2(s: SparkSession, d: str) -> DataFrame:
    return validate.validate_events(_event_texts(s, d)).select("id", "error_code", C("device_ns"))


def _i7(s: SparkSession, d: str) -> DataFrame:
    v = validate.validate_events(_event_texts(s, d), check_depth=False).where("error_code is null")
    return v.agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("contents"), F.count_distinct("payload_hash").alias("payloads"))


def _heartbeat_texts(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    k, key = C("event_id") % 10, C("event_id").cast("string")
    end = F.when(k == 4, "2024-01-01T00:10:00Z").when(k == 5, "2024-01-01").otherwise("2024-01-01T01:04:00+01:00")
    flags = F.when(k == 6, '["obscured","obscured"]').when(k == 7, '["odd"]').when(k == 8, "[]").otherwise('["obscured","corrupt"]')
    text = F.concat(F.lit('{"schema_version":1,"collector_id":"c'), F.when(k == 1, "99").otherwise("1"), F.lit('","state":"'), F.when(k == 2, "off").otherwise("idle"), F.lit('","device_start_raw":"2024-01-01T00:00:00Z","device_end_raw":"'), end, F.lit('","clock_offset_ms":0,"clock_error_ms":'), F.when(k == 3, "-1").otherwise("1"), F.lit(',"idempotency_key":"h'), key, F.lit('","quality_flags":'), flags, F.lit("}"))
    return e.select(C("event_id").alias("id"), text.alias("raw"))


def _absent(texts: DataFrame) -> DataFrame:
    """Records that are null, empty or white space for three of five ids."""
    k = C("id") % 5
    return texts.withColumn("raw", F.when(k == 1, "").when(k == 2, " \t").when(k > 2, C("raw")))


def _i4(s: SparkSession, d: str) -> DataFrame:
    v = validate.validate_heartbeats(_heartbeat_texts(s, d), frame(s, d, "collectors"))
    return v.select("id", "error_code", F.concat_ws(",", "quality_flags").alias("flags"))


def _i8(s: SparkSession, d: str) -> DataFrame:
    v = validate.validate_heartbeats(_heartbeat_texts(s, d), frame(s, d, "collectors")).where("error_code is null")
    return v.agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("contents"))


def _i6(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/documents.parquet")
    k = C("doc_id") % 9
    digest = F.when(k == 4, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256))
    raw = F.concat(F.lit('{"schema_version":1,"complete":'), F.when(k == 1, "false").otherwise("true"), F.lit(',"collector_id":"'), F.when(k == 2, "c 1").otherwise("c1"), F.lit('","source_idempotency_key":"s"'), F.when(k == 3, "").otherwise(',"device_start_raw":"2024-01-01T00:00:00Z"'), F.lit(',"device_end_raw":"'), F.when(k == 5, "2024-01-02T00:00:00Z").otherwise("2024-01-01T00:01:00Z"), F.lit('","clock_offset_ms":0,"clock_error_ms":0,"size_bytes":'), F.when(k == 6, "0").otherwise(F.lit("7")), F.lit(',"sha256":"'), digest, F.lit('","media_type":"'), F.when(k == 7, "audio").otherwise("video"), F.lit('"}'))
    v = validate.validate_sidecars(e.select("doc_id", raw.alias("raw")), 600 * X.NS)
    return v.select("doc_id", "status", "error_code", C("fingerprint").isNotNull().alias("has_fingerprint"))


def _i10(s: SparkSession, d: str) -> DataFrame:
    c = frame(s, d, "cand").where("id % 7 <> 3 or batch_id % 3 <> 0")
    batches = s.read.parquet(f"{d}/events.parquet").select((F.floor(C("event_id") / 100) * 2).alias("batch_id"))
    return validate.batch_sizes(c.select((C("batch_id") * 1).alias("batch_id")), batches, 90)


def _times(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    zone = F.get(F.array(*(F.lit(z) for z in ("Z", "+02:00", "-05:30", "-00:00", ""))), (C("event_id") % 5).cast("int"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(C("event_id") % 2 == 0, "789").otherwise(""), zone)
    return e.select(C("event_id").alias("id"), X.known_offset_ns(text).alias("ns"))


def _timeline(s: SparkSession, d: str) -> DataFrame:
    raw = _resolved(s, d).where("status = 'accepted'")
    raw = raw.withColumn("event_type", C("event_type"))
    return timeline.build_timeline(raw, frame(s, d, "hb"), frame(s, d, "media"))


TIMELINE = RES + """, tl AS (
  SELECT 'event:' || CAST(id AS STRING) AS stable_id, 'raw_event' AS source_type, id AS source_id, collector_id, event_type, device_ns + clock_offset_ms * 1000000 AS start_ns, CAST(NULL AS BIGINT) AS end_ns, received_ns, clock_error_ms > 1000 AS clock_uncertain,
    CASE WHEN clock_error_ms > 1000 THEN 'clock_uncertain' ELSE '' END AS flags FROM res WHERE status = 'accepted'
  UNION ALL SELECT 'heartbeat:' || CAST(id AS STRING), 'heartbeat', id, collector_id, 'collector.heartbeat', device_start_ns + clock_offset_ms * 1000000, device_end_ns + clock_offset_ms * 1000000, received_ns, clock_error_ms > 1000,
    array_to_string(list_sort(list_distinct(list_concat(quality_flags, CASE WHEN clock_error_ms > 1000 THEN ['clock_uncertain'] ELSE [] END))), ',') FROM hb
  UNION ALL SELECT 'media:' || CAST(id AS STRING), 'media_segment', id, collector_id, 'media.segment', device_start_ns, device_end_ns, received_ns, clock_error_ms > 1000, CASE WHEN clock_error_ms > 1000 THEN 'clock_uncertain' ELSE '' END FROM media)
"""
_OUT = ["stable_id", "source_type", "source_id", "collector_id", "event_type", "start_ns", "end_ns", "received_ns", "clock_uncertain"]


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*_OUT, F.concat_ws(",", "quality_flags").alias("flags"))


def _c1(s: SparkSession, d: str) -> DataFrame:
    return _flat(timeline.project_events(frame(s, d, "raw")))


C1 = """SELECT 'event:' || CAST(id AS STRING) AS stable_id, 'raw_event' AS source_type, id AS source_id, collector_id, event_type, device_ns + clock_offset_ms * 1000000 AS start_ns,
  CASE WHEN event_type = 'activitywatch.event' AND id % 5 <> 0 THEN device_ns + clock_offset_ms * 1000000 + (id % 300) * 1000000000 END AS end_ns, received_ns, clock_error_ms > 1000 AS clock_uncertain,
  array_to_string([x FOR x IN [CASE WHEN clock_error_ms > 1000 THEN 'clock_uncertain' END, CASE WHEN event_type = 'activitywatch.event' AND id % 5 = 0 THEN 'incomplete' END] IF x IS NOT NULL], ',') AS flags FROM raw"""


def _c9(s: SparkSession, d: str) -> DataFrame:
    t = timeline.build_timeline(frame(s, d, "raw"), frame(s, d, "hb"), frame(s, d, "media"))
    return timeline.coverage_facts(t).select("collector_id", "start_ns", "end_ns", "availability", "reason_code", "priority", "stable_id")


C9 = """SELECT collector_id, device_ns + clock_offset_ms * 1000000 AS start_ns, device_ns + clock_offset_ms * 1000000 + (id % 300) * 1000000000 AS end_ns,
  CASE WHEN id % 6 = 0 THEN 'confirmed_idle' ELSE 'covered' END AS availability, CASE WHEN id % 6 = 0 THEN 'ACTIVITYWATCH_AFK' ELSE 'ACTIVITYWATCH_EVENT' END AS reason_code, CASE WHEN id % 6 = 0 THEN 40 ELSE 20 END AS priority, 'event:' || CAST(id AS STRING) AS stable_id
  FROM raw WHERE event_type = 'activitywatch.event' AND id % 5 <> 0 AND id % 300 > 0
  UNION ALL SELECT collector_id, device_start_ns + clock_offset_ms * 1000000, device_end_ns + clock_offset_ms * 1000000, CASE WHEN state = 'idle' THEN 'confirmed_idle' ELSE 'covered' END, CASE WHEN state = 'idle' THEN 'HEARTBEAT_IDLE' ELSE 'HEARTBEAT_ACTIVE' END, 30, 'heartbeat:' || CAST(id AS STRING) FROM hb
  UNION ALL SELECT collector_id, device_start_ns, device_end_ns, 'covered', 'MEDIA_ACCEPTED', 30, 'media:' || CAST(id AS STRING) FROM media"""
KEYS = ("start_ns", "received_ns", "source_type", "source_id", "stable_id")
_MID = T0 + 10 * DAY


def _f5(s: SparkSession, d: str) -> DataFrame:
    """A page behind id 200 of the snapshot up to id 900, from the files that hold it."""
    pages = Pages(s, work_dir(s, "events"), ("id",))
    pages.write(frame(s, d, "raw").where("id <= 900").select("id", "collector_id", "payload"), 16)
    return pages.page((200,), 100)


def _f6(s: SparkSession, d: str) -> DataFrame:
    pages = Pages(s, work_dir(s, "timeline"), KEYS)
    pages.write(_timeline(s, d), 16)
    return _flat(pages.page((_MID, 0, "", 0, ""), 50))


def _s9(s: SparkSession, d: str) -> DataFrame:
    new = _flat(_timeline(s, d))
    old = new.where("source_id % 3 <> 0").withColumn("flags", F.when(C("source_id") % 5 == 1, "old").otherwise(C("flags")))
    return timeline.changed(new, old, ("source_type", "source_id")).select("source_type", "source_id", "flags")


def _s9_generation(s: SparkSession, d: str) -> DataFrame:
    """A timeline of which a quarter changes: the sink writes those rows only."""
    rows = _flat(_timeline(s, d))
    sink = Keyed(s, work_dir(s, "keyed"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), ("source_type", "source_id"))
    sink.upsert(rows.where("source_id % 3 <> 0"), 1)
    sink.upsert(rows.where("source_id % 4 = 0").withColumn("flags", F.lit("new")), 2)
    return sink.rows().groupBy("source_type", "flags").agg(F.count("*").alias("n"))


def _s1(s: SparkSession, d: str) -> DataFrame:
    path = work_dir(s, "landing")
    _event_texts(s, d).select("raw").write.text(path)
    return validate.validate_events(readers.json_lines(s, path), check_depth=False).groupBy("error_code").agg(F.count("*").alias("n"))


def _s2(s: SparkSession, d: str) -> DataFrame:
    path = work_dir(s, "landing")
    _heartbeat_texts(s, d).select("raw").write.text(path)
    return validate.validate_heartbeats(readers.json_lines(s, path), frame(s, d, "collectors")).groupBy("error_code").agg(F.count("*").alias("n"))


def _s7(s: SparkSession, d: str) -> DataFrame:
    path = work_dir(s, "facts")
    ok = _resolved(s, d).where("status = 'accepted'").select("id", "collector_id", "device_ns")
    sinks.append_facts(ok.where("id % 2 = 0"), path)
    sinks.append_facts(ok.where("id % 2 = 1"), path)
    return s.read.parquet(path).groupBy(F.date_diff("event_date", F.lit("1970-01-01")).cast("long").alias("day"), "collector_id").agg(F.count("*").alias("n"))


_BROKEN = "CASE WHEN id % 12 IN (1, 2, 3, 4) THEN 'EVENT_JSON_INVALID' WHEN id % 12 = 5 THEN 'EVENT_SCHEMA_UNSUPPORTED' WHEN id % 12 = 6 THEN 'EVENT_COLLECTOR_INVALID' WHEN id % 12 = 10 THEN 'EVENT_TYPE_INVALID' WHEN id % 12 = 7 THEN 'EVENT_DEVICE_TIME_INVALID' WHEN id % 12 = 8 THEN 'EVENT_CLOCK_OFFSET_INVALID' WHEN id % 12 = 9 THEN 'EVENT_CLOCK_ERROR_INVALID' WHEN id % 12 = 11 THEN 'EVENT_PAYLOAD_INVALID' END"
_HB = "CASE id % 10 WHEN 1 THEN 'HEARTBEAT_COLLECTOR_INVALID' WHEN 2 THEN 'HEARTBEAT_STATE_INVALID' WHEN 3 THEN 'HEARTBEAT_CLOCK_INVALID' WHEN 4 THEN 'HEARTBEAT_DURATION_INVALID' WHEN 5 THEN 'HEARTBEAT_TIME_INVALID' WHEN 6 THEN 'HEARTBEAT_QUALITY_FLAGS_INVALID' WHEN 7 THEN 'HEARTBEAT_QUALITY_FLAGS_INVALID' END"
_IDS = "(SELECT event_id AS id, props, ts, value, user_id FROM events)"

ENTRIES = {
    "s1_event_source": (_s1, f"SELECT {_BROKEN} AS error_code, count(*) AS n FROM {_IDS} GROUP BY 1"),
    "s2_heartbeat_source": (_s2, f"SELECT {_HB} AS error_code, count(*) AS n FROM {_IDS} GROUP BY 1"),
    "s7_append_facts": (_s7, sql(RES + "SELECT CAST(floor(device_ns / 86400000000000) AS BIGINT) AS day, collector_id, count(*) AS n FROM res WHERE status = 'accepted' GROUP BY ALL", "cand")),
    "s9_changed_rows": (_s9, sql(TIMELINE + "SELECT source_type, source_id, flags FROM tl WHERE source_id % 3 = 0 OR source_id % 5 = 1", "cand", "hb", "media")),
    "s9_next_generation": (_s9_generation, sql(TIMELINE + "SELECT source_type, CASE WHEN source_id % 4 = 0 THEN 'new' ELSE flags END AS flags, count(*) AS n FROM tl WHERE source_id % 4 = 0 OR source_id % 3 <> 0 GROUP BY 1, 2", "cand", "hb", "media")),
    "i1_strict_json": (_i1, f"SELECT id, id % 12 NOT IN (1, 2, 3, 4) AS ok FROM {_IDS}"),
    "i2_event_rules": (_i2, f"SELECT id, {_BROKEN} AS error_code, CASE WHEN id % 12 NOT IN (1, 3, 7) THEN 1704060000000000000 END AS device_ns FROM {_IDS}"),
    "i2_absent_records": (lambda s, d: validate.validate_events(_absent(_event_texts(s, d))).select("id", "error_code"), f"SELECT id, CASE WHEN id % 5 < 3 THEN 'EVENT_JSON_INVALID' ELSE {_BROKEN} END AS error_code FROM {_IDS}"),
    "i4_absent_records": (lambda s, d: validate.validate_heartbeats(_absent(_heartbeat_texts(s, d)), frame(s, d, "collectors")).select("id", "error_code"), f"SELECT id, CASE WHEN id % 5 < 3 THEN 'HEARTBEAT_JSON_INVALID' ELSE {_HB} END AS error_code FROM {_IDS}"),
    "i3_idempotent_append": (lambda s, d: _resolved(s, d).select("id", "status", "fact_id", "error_code"), sql(RES + "SELECT id, status, fact_id, CASE WHEN status = 'conflict' THEN 'EVENT_IDEMPOTENCY_CONFLICT' ELSE error_code END AS error_code FROM res", "cand")),
    "i3_with_existing_facts": (lambda s, d: (lambda c: facts.resolve_idempotent(c.where("id >= 500"), "id", _resolved(s, d).where("status = 'accepted' and id < 500").select("collector_id", "idempotency_key", "id", "content_hash")).select("id", "status", "fact_id"))(frame(s, d, "cand")), sql(RES + "SELECT id, status, fact_id FROM res WHERE id >= 500", "cand")),
    "i4_heartbeat_rules": (_i4, f"SELECT id, {_HB} AS error_code, CASE id % 10 WHEN 6 THEN 'obscured' WHEN 7 THEN 'odd' WHEN 8 THEN '' ELSE 'corrupt,obscured' END AS flags FROM {_IDS}"),
    "i5_heartbeat_append": (lambda s, d: facts.resolve_idempotent(frame(s, d, "hb").select("id", "collector_id", (C("id") % 50).cast("string").alias("idempotency_key"), F.sha2("state", 256).alias("content_hash"), F.lit(None).cast("string").alias("error_code")), "id", conflict="HEARTBEAT_IDEMPOTENCY_CONFLICT").select("id", "status", "fact_id", "error_code"),
        sql("WITH w AS (SELECT id, state, first_value(id) OVER p AS f, first_value(state) OVER p AS fs FROM hb WINDOW p AS (PARTITION BY collector_id, id % 50 ORDER BY id)) SELECT id, CASE WHEN f = id THEN 'accepted' WHEN fs = state THEN 'duplicate' ELSE 'conflict' END AS status, f AS fact_id, CASE WHEN f <> id AND fs <> state THEN 'HEARTBEAT_IDEMPOTENCY_CONFLICT' END AS error_code FROM w", "hb")),
    "i6_sidecar_rules": (_i6, """SELECT doc_id, CASE WHEN doc_id % 9 = 1 THEN 'pending' WHEN doc_id % 9 BETWEEN 2 AND 7 THEN 'quarantined' END AS status,
        CASE doc_id % 9 WHEN 1 THEN 'MEDIA_SIDECAR_INCOMPLETE' WHEN 5 THEN 'MEDIA_TIME_INVALID' WHEN 7 THEN 'MEDIA_TYPE_INVALID' WHEN 0 THEN NULL WHEN 8 THEN NULL ELSE 'MEDIA_SIDECAR_INVALID' END AS error_code, doc_id % 9 IN (0, 8) AS has_fingerprint FROM documents"""),
    "i7_payload_hashes": (_i7, f"SELECT count(*) AS n, count(*) AS contents, count(DISTINCT props) AS payloads FROM {_IDS} WHERE id % 12 = 0"),
    "i8_heartbeat_hash": (_i8, f"SELECT count(*) AS n, count(*) AS contents FROM {_IDS} WHERE id % 10 IN (0, 8, 9)"),
    "i9_outcomes": (lambda s, d: validate.outcomes(_resolved(s, d)), sql(RES + "SELECT status, CASE WHEN status = 'conflict' THEN 'EVENT_IDEMPOTENCY_CONFLICT' ELSE error_code END AS error_code, count(*) AS n FROM res GROUP BY 1, 2", "cand")),
    "i10_batch_sizes": (_i10, sql("""WITH b AS (SELECT DISTINCT CAST(floor(event_id / 100) AS BIGINT) * 2 AS batch_id FROM events), c AS (SELECT batch_id, count(*) AS n FROM cand WHERE id % 7 <> 3 OR batch_id % 3 <> 0 GROUP BY 1)
        SELECT b.batch_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'EVENT_BATCH_EMPTY' WHEN n > 90 THEN 'EVENT_BATCH_TOO_LARGE' END AS error_code FROM b LEFT JOIN c ON b.batch_id = c.batch_id""", "cand")),
    "f1_time_range": (lambda s, d: _flat(_timeline(s, d).where((C("start_ns") >= _MID) & (C("start_ns") < _MID + DAY))), sql(TIMELINE + f"SELECT * FROM tl WHERE start_ns >= {_MID} AND start_ns < {_MID + DAY}", "cand", "hb", "media")),
    "f2_overlap": (lambda s, d: _flat(_timeline(s, d).where((C("start_ns") < _MID + DAY) & (C("end_ns") > _MID))), sql(TIMELINE + f"SELECT * FROM tl WHERE start_ns < {_MID + DAY} AND end_ns > {_MID}", "cand", "hb", "media")),
    "f3_positive_rows": (lambda s, d: _c9(s, d).select("stable_id", "start_ns", "end_ns"), sql(f"SELECT stable_id, start_ns, end_ns FROM ({C9}) AS x", "raw", "hb", "media")),
    "f3_positive_intervals": (lambda s, d: _c9(s, d).groupBy("reason_code").agg(F.count("*").alias("n")), sql(f"SELECT reason_code, count(*) AS n FROM ({C9}) AS x GROUP BY 1", "raw", "hb", "media")),
    "f4_activity_payload": (lambda s, d: timeline.with_duration(frame(s, d, "raw").where("event_type = 'activitywatch.event'")).select("id", "seconds"), sql("SELECT id, CASE WHEN id % 5 <> 0 THEN CAST(id % 300 AS DOUBLE) END AS seconds FROM raw WHERE event_type = 'activitywatch.event'", "raw")),
    "f5_incremental_events": (_f5, sql("SELECT id, collector_id, payload FROM raw WHERE id > 200 AND id <= 900 ORDER BY id LIMIT 101", "raw")),
    "f6_incremental_timeline": (_f6, sql(TIMELINE + f"SELECT * FROM tl WHERE (start_ns, received_ns, source_type, source_id, stable_id) > ({_MID}, 0, '', 0, '') ORDER BY start_ns, received_ns, source_type, source_id, stable_id LIMIT 51", "cand", "hb", "media")),
    "f7_key_family": (lambda s, d: frame(s, d, "raw").select(timeline.base_key(F.concat(F.lit("a"), C("user_id").cast("string"), F.when(C("id") % 3 > 0, F.concat(F.lit(":duration:"), C("id").cast("string"))).otherwise(""))).alias("base")).groupBy("base").agg(F.count("*").alias("n")), sql("SELECT 'a' || CAST(user_id AS STRING) AS base, count(*) AS n FROM raw GROUP BY 1", "raw")),
    "f8_collector_scope": (lambda s, d: _flat(_timeline(s, d).where("collector_id = 'c3'")), sql(TIMELINE + "SELECT * FROM tl WHERE collector_id = 'c3'", "cand", "hb", "media")),
    "f9_guarded": (lambda s, d: timeline.guarded(frame(s, d, "raw").where(f"device_ns < {T0 + DAY}"), 10**7).agg(F.count("*").alias("n")), sql(f"SELECT count(*) AS n FROM raw WHERE device_ns < {T0 + DAY}", "raw")),
    "u1_l1_timeline": (lambda s, d: _flat(timeline.ordered(_timeline(s, d))), sql(TIMELINE + "SELECT * FROM tl", "cand", "hb", "media")),
    "u4_merged_flags": (lambda s, d: frame(s, d, "hb").groupBy("collector_id").agg(F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set("quality_flags"))))).alias("flags")), sql("SELECT collector_id, string_agg(f, ',' ORDER BY f) AS flags FROM (SELECT DISTINCT collector_id, unnest(quality_flags) AS f FROM hb) AS x GROUP BY 1", "hb")),
    "c1_event_entries": (_c1, sql(C1, "raw")),
    "c2_heartbeat_entries": (lambda s, d: _flat(timeline.project_heartbeats(frame(s, d, "hb"))), sql(TIMELINE + "SELECT * FROM tl WHERE source_type = 'heartbeat'", "cand", "hb", "media")),
    "c2_media_entries": (lambda s, d: _flat(timeline.project_media(frame(s, d, "media"))), sql(TIMELINE + "SELECT * FROM tl WHERE source_type = 'media_segment'", "cand", "hb", "media")),
    "c9_coverage_facts": (_c9, sql(C9, "raw", "hb", "media")),
    "x1_known_offset": (_times, "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN -7200000000000 WHEN 2 THEN 19800000000000 END + epoch_us(ts) * 1000 + CASE WHEN event_id % 2 = 0 THEN 789 ELSE 0 END AS ns FROM events"),
    "x2_fixed_utc": (lambda s, d: frame(s, d, "raw").select("id", X.fixed_utc(C("device_ns") + C("id") % 1000).alias("text")), sql("SELECT id, strftime(make_timestamp(device_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') || lpad(CAST(id % 1000 AS STRING), 3, '0') || 'Z' AS text FROM raw", "raw")),
    "x3_clock_correction": (lambda s, d: frame(s, d, "raw").select("id", X.corrected_ns(C("device_ns"), C("clock_offset_ms")).alias("ns"), X.clock_uncertain(C("clock_error_ms")).alias("uncertain")), sql("SELECT id, device_ns + clock_offset_ms * 1000000 AS ns, clock_error_ms > 1000 AS uncertain FROM raw", "raw")),
    "x4_duration_end": (lambda s, d: frame(s, d, "raw").select("id", X.duration_end_ns(C("device_ns"), C("value")).alias("ns")), sql("SELECT id, device_ns + CAST(trunc(value * 1e9) AS BIGINT) AS ns FROM raw", "raw")),
    "x5_identifiers": (lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", X.valid_identifier(F.when(C("c_custkey") % 5 == 0, F.concat(F.lit(" "), "c_name")).when(C("c_custkey") % 5 == 1, "").when(C("c_custkey") % 5 == 2, F.concat("c_name", F.lit("\t"), "c_name")).when(C("c_custkey") % 5 == 3, F.repeat("c_name", 8)).otherwise(C("c_name")), 128).alias("ok")), "SELECT c_custkey, c_custkey % 5 = 4 AS ok FROM customer"),
    "x6_nul_key": (lambda s, d: frame(s, d, "raw").select("id", X.nul_key(C("collector_id"), C("id"), C("event_type")).alias("key")), sql("SELECT id, sha256(collector_id || chr(0) || CAST(id AS STRING) || chr(0) || event_type) AS key FROM raw", "raw")),
    "x7_duration_ms": (lambda s, d: frame(s, d, "raw").select("id", X.duration_ms(F.when(C("id") % 9 == 0, "n/a").otherwise((C("id") / 8 + 0.0001).cast("string"))).alias("ms")), sql("SELECT id, CASE WHEN id % 9 <> 0 THEN CAST(ceil((id / 8 + 0.0001) * 1000) AS BIGINT) END AS ms FROM raw", "raw")),
    "x9_activity_key": (lambda s, d: frame(s, d, "raw").select("id", X.activity_base_key(C("collector_id"), C("id")).alias("key")), sql("SELECT id, 'activitywatch:' || substr(sha256(collector_id), 1, 16) || ':' || CAST(id AS STRING) AS key FROM raw", "raw")),
    "x11_minute_of_day": (lambda s, d: frame(s, d, "raw").select("id", X.minute_of_day(F.format_string("%02d:%02d", C("id") % 26, C("id") % 60)).alias("minute")), sql("SELECT id, CAST(CASE WHEN id % 26 < 24 OR id % 26 = 24 AND id % 60 = 0 THEN (id % 26) * 60 + id % 60 END AS INTEGER) AS minute FROM raw", "raw")),
    "x12_weekday": (lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", X.weekday_name(C("o_orderdate").cast("date")).alias("day")), "SELECT o_orderkey, lower(dayname(o_orderdate)) AS day FROM orders"),
    "x13_detail": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.detail_text(C("text")).alias("detail")), "SELECT doc_id, substr(text, 1, 1024) AS detail FROM documents"),
    "x14_json_fields": (lambda s, d: frame(s, d, "raw").select("id", X.json_number(F.try_parse_json("payload"), "$.duration_seconds").alias("seconds"), X.json_text(F.try_parse_json("payload"), "$.data.status").alias("status")), sql("SELECT id, CASE WHEN event_type = 'activitywatch.event' AND id % 5 <> 0 THEN CAST(id % 300 AS DOUBLE) END AS seconds, CASE WHEN event_type = 'activitywatch.event' AND id % 5 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'afk' ELSE 'x' END END AS status FROM raw", "raw")),
}
