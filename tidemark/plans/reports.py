"""Queries of whole daily reports, hashes and key families, over all rows of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, media, timeline, validate
from .adapters import DAY, T0, frame, sql
from .audit import DAY0, GAP, HEALTH
from .ingest import _event_texts, _heartbeat_texts

C = F.col
#: The measured peaks of a sample: working set, private bytes, heap and so on.
METRICS = tuple(f"metric_{i:02}" for i in range(1, 15))
LIMIT = 4000.0


def _metrics(s: SparkSession, d: str) -> DataFrame:
    """Samples with fourteen metrics, each of them missing on other rows."""
    x = frame(s, d, "samples")
    return x.withColumns({m: F.when(C("id") % (i + 3) != 0, C("working_set") * i + C("handles")) for i, m in enumerate(METRICS, 1)})


def _peaks(s: SparkSession, d: str) -> DataFrame:
    return audit.daily_peaks(_metrics(s, d), METRICS)


PEAKS = "pk AS (SELECT host_id, day, " + ", ".join(f"max(CASE WHEN id % {i + 3} <> 0 THEN working_set * {i} + handles END) AS {m}" for i, m in enumerate(METRICS, 1)) + ", min(free_bytes) AS free_bytes FROM samples GROUP BY 1, 2)"


def _deltas(s: SparkSession, d: str) -> DataFrame:
    """Two tables on each host: its samples, and those that are not healthy."""
    x = frame(s, d, "samples")
    two = x.select("host_id", "day", F.explode(F.when(C("status") == "healthy", F.array(F.lit("samples"))).otherwise(F.array(F.lit("samples"), F.lit("unhealthy")))).alias("table_name"))
    counts = two.groupBy("day", F.concat_ws("/", "host_id", "table_name").alias("table_name")).agg(F.count("*").alias("n"))
    return audit.count_deltas(counts).withColumns({"host_id": F.split_part("table_name", F.lit("/"), F.lit(1)), "table_name": F.split_part("table_name", F.lit("/"), F.lit(2))})


DELTAS = """ct AS (SELECT host_id, day, 'samples' AS table_name, count(*) AS n FROM samples GROUP BY 1, 2 UNION ALL SELECT host_id, day, 'unhealthy', count(*) FROM samples WHERE status <> 'healthy' GROUP BY 1, 2),
dl AS (SELECT b.host_id, b.day + 1 AS day, b.table_name, coalesce(a.n, 0) - b.n AS delta FROM ct b LEFT JOIN ct a ON a.host_id = b.host_id AND a.day = b.day + 1 AND a.table_name = b.table_name WHERE b.day < (SELECT max(day) FROM ct))"""


def _runs(s: SparkSession, d: str) -> DataFrame:
    """The first sample of each process on a host and day as a run of the publisher."""
    first = frame(s, d, "samples").groupBy("host_id", "day", "pid").agg(F.min("id").alias("id"))
    return first.select("host_id", "day", F.when(C("id") % 3 == 0, "failed").otherwise("passed").alias("status"), (5 + (C("id") % 4 == 1).cast("int")).alias("segments"), (C("id") % 5 != 2).alias("in_window"))


RUNS = "fi AS (SELECT host_id, day, min(id) AS id FROM samples GROUP BY host_id, day, pid), ru AS (SELECT host_id, day, count(*) FILTER (WHERE id % 3 <> 0) AS runs, count(*) FILTER (WHERE id % 3 <> 0 AND id % 4 <> 1 AND id % 5 <> 2) AS good FROM fi GROUP BY 1, 2)"


def _supervised(s: SparkSession, d: str) -> DataFrame:
    return audit.supervisor_summary(frame(s, d, "samples")).withColumn("passed", (C("restarts") <= 3) & (C("boots") <= 2))


SUPERVISED = "su AS (SELECT host_id, day, count(DISTINCT crash_ns) AS crashes, greatest(count(DISTINCT pid) - 1, 0) AS restarts, count(DISTINCT boot) AS boots FROM samples GROUP BY 1, 2)"


def _gates(s: SparkSession, d: str) -> DataFrame:
    """Every gate of a host's day: resources, samples, counts, publisher, supervisor."""
    resources = audit.resource_gate(_peaks(s, d), {m: LIMIT for m in METRICS}, {"free_bytes": 700.0})
    health = audit.sample_gate(frame(s, d, "samples"), frame(s, d, "exclusions"), 7200)
    return audit.daily_verdict(resources, health, audit.delta_gate(_deltas(s, d)), audit.publisher_gate(_runs(s, d), 5, ("host_id", "day")), _supervised(s, d))


GATES = f"""{GAP}{HEALTH}, {PEAKS}, {DELTAS}, {RUNS}, {SUPERVISED}, gt AS (
  SELECT host_id, day, coalesce({" AND ".join(f"{m} <= {LIMIT}" for m in METRICS)} AND free_bytes >= 700, false) AS passed FROM pk
  UNION ALL SELECT host_id, day, passed FROM sg UNION ALL SELECT host_id, day, min(delta) >= 0 FROM dl GROUP BY 1, 2
  UNION ALL SELECT host_id, day, runs = 1 AND good = 1 FROM ru UNION ALL SELECT host_id, day, restarts <= 3 AND boots <= 2 FROM su)
"""


def _rollup(s: SparkSession, d: str) -> DataFrame:
    days = _peaks(s, d).join(audit.supervisor_summary(frame(s, d, "samples")), ["host_id", "day"]).join(audit.delta_gate(_deltas(s, d)).select("host_id", "day", "delta"), ["host_id", "day"], "left")
    return audit.rollup(days, ("delta", "crashes", "restarts"), METRICS, ("free_bytes",))


def _hands(s: SparkSession, d: str) -> DataFrame:
    log = s.read.parquet(f"{d}/events.parquet").select(C("event_id").alias("id"), F.concat(F.lit("h"), (C("user_id") % 3).cast("string")).alias("host_id"), C("event_type").alias("kind"), (F.unix_micros(C("ts").cast("timestamp")) * 1000).alias("at_ns"))
    return audit.interventions(log, ("error", "purchase"), DAY0 + 3, 14).select("id", "host_id", "kind", "day")


def _expiries(s: SparkSession, d: str) -> DataFrame:
    c = frame(s, d, "fleet").select("collector_id", "heartbeat_period_ns", "allowed_lateness_ns", "offline_after_ns")
    hb = frame(s, d, "hb").select("collector_id", C("device_start_ns").alias("start_ns"), C("device_end_ns").alias("end_ns"))
    return timeline.liveness_changes(hb, c, T0 + 40 * DAY)


def _keys(s: SparkSession, d: str) -> DataFrame:
    """Events under keys that a revision extends: a<user>, and a<user>:duration:<id>."""
    key = F.concat(F.lit("a"), C("user_id").cast("string"), F.when(C("id") % 3 > 0, F.concat(F.lit(":duration:"), C("id").cast("string"))).otherwise(""))
    return frame(s, d, "raw").select("id", key.alias("idempotency_key"))


def _media_hashes(s: SparkSession, d: str) -> DataFrame:
    """Metadata of thirteen fields and its hash."""
    m = frame(s, d, "media")
    fields = ("collector_id", "source_key", "device_start_ns", "device_end_ns", "clock_offset_ms", "clock_error_ms", "size_bytes", "sha256", "duration_ms", "path", "created_ns", "received_ns", "media_segment_id")
    return m.select("id", media.metadata_hash(*(C(f) for f in fields)).alias("hash"))


_M = ("collector_id", "source_key", "device_start_ns", "device_end_ns", "clock_offset_ms", "clock_error_ms", "size_bytes", "sha256", "duration_ms", "path", "created_ns", "received_ns", "media_segment_id")
_IDS = "(SELECT event_id AS id, props FROM events)"
_TEXT = "'\"' || {} || '\"'"

ENTRIES = {
    "a17_all_metrics": (_peaks, sql("WITH " + PEAKS + " SELECT * FROM pk", "samples")),
    "a20_with_deltas": (_rollup, sql(f"WITH {PEAKS}, {DELTAS}, {SUPERVISED}, dd AS (SELECT host_id, day, sum(delta) AS delta FROM dl GROUP BY 1, 2) SELECT pk.host_id, CAST(sum(delta) AS BIGINT) AS delta, CAST(sum(crashes) AS BIGINT) AS crashes, CAST(sum(restarts) AS BIGINT) AS restarts, {', '.join(f'max({m}) AS {m}' for m in METRICS)}, min(free_bytes) AS free_bytes FROM pk JOIN su ON pk.host_id = su.host_id AND pk.day = su.day LEFT JOIN dd ON pk.host_id = dd.host_id AND pk.day = dd.day GROUP BY 1", "samples")),
    "j10_deltas_of_missing_tables": (lambda s, d: _deltas(s, d).select("host_id", "day", "table_name", "delta", "passed"), sql(f"WITH {DELTAS} SELECT *, delta >= 0 AS passed FROM dl", "samples")),
    "q7_publisher_by_host": (lambda s, d: audit.publisher_gate(_runs(s, d), 5, ("host_id", "day")), sql(f"WITH {RUNS} SELECT host_id, day, runs, runs = 1 AND good = 1 AS passed FROM ru", "samples")),
    "q9_all_gates": (_gates, sql(GATES + "SELECT host_id, day, count(*) AS gates, bool_and(passed) AS passed FROM gt GROUP BY 1, 2", "samples", "exclusions")),
    "q11_interventions_of_days": (_hands, f"SELECT event_id AS id, 'h' || CAST(user_id % 3 AS VARCHAR) AS host_id, event_type AS kind, epoch_us(ts) // 86400000000 AS day FROM events WHERE event_type IN ('error', 'purchase') AND epoch_us(ts) // 86400000000 BETWEEN {DAY0 + 3} AND {DAY0 + 16}"),
    "t8_liveness": (_expiries, sql(f"""WITH x AS (SELECT collector_id, device_start_ns AS s, device_end_ns AS e FROM hb), l AS (SELECT collector_id, e, coalesce(lead(s) OVER (PARTITION BY collector_id ORDER BY e, s), {T0 + 40 * DAY}) AS nxt FROM x),
        w AS (SELECT collector_id, heartbeat_period_ns AS p, heartbeat_period_ns + allowed_lateness_ns AS pl, offline_after_ns AS o FROM fleet), y AS (SELECT l.collector_id, e + p AS at_ns, 'missing' AS state, nxt FROM l JOIN w USING (collector_id) UNION ALL SELECT l.collector_id, e + pl, 'delayed', nxt FROM l JOIN w USING (collector_id) UNION ALL SELECT l.collector_id, e + o, 'offline', nxt FROM l JOIN w USING (collector_id))
        SELECT collector_id, at_ns, state FROM y WHERE at_ns < nxt""", "hb", "fleet")),
    "f7_family_of_a_key": (lambda s, d: timeline.key_family(_keys(s, d), "a7", 10**6), sql("SELECT id, 'a' || CAST(user_id AS STRING) || CASE WHEN id % 3 > 0 THEN ':duration:' || CAST(id AS STRING) ELSE '' END AS idempotency_key FROM raw WHERE user_id = 7", "raw")),
    "i7_content_hashes": (lambda s, d: validate.validate_events(_event_texts(s, d)).where("error_code is null").select("id", "payload_hash", "content_hash"), f"WITH p AS (SELECT id, sha256(CAST(json(props) AS VARCHAR)) AS h FROM {_IDS} WHERE id % 12 = 0) SELECT id, h AS payload_hash, sha256('{{\"c0\":1,\"c1\":\"c1\",\"c2\":\"t\",\"c3\":\"2024-01-01T00:00:00+02:00\",\"c4\":5,\"c5\":5,\"c6\":\"k' || CAST(id AS VARCHAR) || '\",\"c7\":\"' || h || '\"}}') AS content_hash FROM p"),
    "i8_content_hashes": (lambda s, d: validate.validate_heartbeats(_heartbeat_texts(s, d), frame(s, d, "collectors")).where("error_code is null").select("id", "content_hash"), f"SELECT id, sha256('{{\"c0\":1,\"c1\":\"c1\",\"c2\":\"idle\",\"c3\":\"2024-01-01T00:00:00Z\",\"c4\":\"2024-01-01T01:04:00+01:00\",\"c5\":0,\"c6\":1,\"c7\":\"h' || CAST(id AS VARCHAR) || '\",\"c8\":' || CASE WHEN id % 10 = 8 THEN '[]' ELSE '[\"corrupt\",\"obscured\"]' END || '}}') AS content_hash FROM {_IDS} WHERE id % 10 IN (0, 8, 9)"),
    "x10_metadata_hashes": (_media_hashes, sql("SELECT id, sha256('{' || " + " || ',' || ".join(f"'\"c{i:02d}\":' || " + (_TEXT.format(f) if f in ("collector_id", "source_key", "sha256", "path") else f"CAST({f} AS STRING)") for i, f in enumerate(_M)) + " || '}') AS hash FROM media", "media")),
}
