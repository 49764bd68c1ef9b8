"""Queries of state reconstruction, logs and certification counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, statelog
from .adapters import frame, sql
from .ingest import RES, _resolved

C = F.col
_LOGS = ("raw", "hb", "media", "ilog", "slog", "faults", "modules", "modes", "retention")


def _table(name: str, *keys: str):
    return lambda s, d: audit.counted(frame(s, d, name), *keys)


def _counts(name: str, *keys: str) -> str:
    cols = ", ".join(f"coalesce(CAST({k} AS STRING), '') AS key_{i}" for i, k in enumerate(keys, 1))
    return sql(f"SELECT {cols}, count(*) AS n FROM {name} GROUP BY ALL", name)


def _w1(s: SparkSession, d: str) -> DataFrame:
    return statelog.ingest_changes(frame(s, d, "ilog"), "ingest_key", "id", ("status", "error_code")).select("id", "ingest_key", "status")


W1 = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY ingest_key ORDER BY id) AS n FROM ilog), f AS (SELECT * FROM k WHERE n = 1 OR status <> 'discovered'),
w AS (SELECT *, lag(id) OVER p AS pid, lag(status) OVER p AS ps, lag(error_code) OVER p AS pe FROM f WINDOW p AS (PARTITION BY ingest_key ORDER BY id)),
ch AS (SELECT id, ingest_key, status FROM w WHERE pid IS NULL OR ps <> status OR pe IS DISTINCT FROM error_code)
"""


def _w4(s: SparkSession, d: str) -> DataFrame:
    return statelog.fault_edges(frame(s, d, "modules"), ("module",), "id", C("status") == "error", "reason_code").select("id", "module", "edge")


def _levels(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "samples").withColumn("level", statelog.disk_level(C("free_bytes"), 990, 980, 960))


def _a15(s: SparkSession, d: str) -> DataFrame:
    now = statelog.latest(frame(s, d, "ilog"), ("ingest_key",), "id")
    return statelog.ingest_summary(now, frame(s, d, "media"))


LATEST = "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY id DESC) AS rn FROM {t}) AS x WHERE rn = 1) "


def _p4(s: SparkSession, d: str) -> DataFrame:
    """Collectors with their counters and a backlog that stays null where none is reported."""
    c = frame(s, d, "raw").select("collector_id").distinct()
    from ..operators.facts import import_counters

    backlog = statelog.latest(frame(s, d, "ilog"), ("ingest_key",), "id").where("status in ('pending', 'validated')")
    backlog = backlog.groupBy(F.concat(F.lit("c"), (C("media_segment_id") % 16).cast("string")).alias("collector_id")).agg(F.count("*").alias("backlog"))
    return c.join(import_counters(_resolved(s, d)), "collector_id", "left").join(backlog, "collector_id", "left")


ENTRIES = {
    "a1_table_counts": (lambda s, d: audit.table_counts({n: frame(s, d, n) for n in _LOGS}), sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _LOGS), *_LOGS)),
    "a2_events_by_collector": (_table("raw", "collector_id"), _counts("raw", "collector_id")),
    "a3_heartbeats_by_state": (_table("hb", "collector_id", "state"), _counts("hb", "collector_id", "state")),
    "a4_media_by_collector": (_table("media", "collector_id"), _counts("media", "collector_id")),
    "a5_ingest_by_status": (_table("ilog", "status", "error_code"), _counts("ilog", "status", "error_code")),
    "a6_media_by_status": (lambda s, d: audit.counted(statelog.latest(frame(s, d, "slog"), ("media_segment_id",), "id"), "status"), sql(LATEST.format(k="media_segment_id", t="slog") + "SELECT status AS key_1, count(*) AS n FROM cur GROUP BY 1", "slog")),
    "a7_faults": (_table("faults", "severity", "status", "error_code"), _counts("faults", "severity", "status", "error_code")),
    "a8_module_states": (_table("modules", "module", "status", "reason_code"), _counts("modules", "module", "status", "reason_code")),
    "a9_mode_transitions": (lambda s, d: audit.counted(statelog.mode_transitions(frame(s, d, "modes"), ("host_id",), "id"), "old_mode", "mode", "reason_code"), sql("WITH w AS (SELECT *, coalesce(lag(mode) OVER (PARTITION BY host_id ORDER BY id), 'unknown') AS old FROM modes) SELECT old AS key_1, mode AS key_2, reason_code AS key_3, count(*) AS n FROM w WHERE old <> mode GROUP BY ALL", "modes")),
    "a10_retention": (_table("retention", "status", "reason_code"), _counts("retention", "status", "reason_code")),
    "a11_event_duplicates": (lambda s, d: audit.duplicate_groups(frame(s, d, "cand"), "collector_id", "event_type", "device_ns", "clock_offset_ms", "clock_error_ms", "payload"), sql("SELECT count(*) AS n FROM (SELECT 1 FROM cand GROUP BY collector_id, event_type, device_ns, clock_offset_ms, clock_error_ms, payload HAVING count(*) > 1) AS x", "cand")),
    "a12_heartbeat_duplicates": (lambda s, d: audit.duplicate_groups(frame(s, d, "hb").withColumn("device_start_ns", F.floor(C("device_start_ns") / 3.6e12)).withColumn("device_end_ns", C("id") % 3), "collector_id", "state", "device_start_ns", "device_end_ns", "clock_offset_ms", "quality_flags"), sql("SELECT count(*) AS n FROM (SELECT 1 FROM hb GROUP BY collector_id, state, floor(device_start_ns / 3.6e12), id % 3, clock_offset_ms, quality_flags HAVING count(*) > 1) AS x", "hb")),
    "a13_media_duplicates": (lambda s, d: audit.duplicate_groups(frame(s, d, "media"), "sha256"), sql("SELECT count(*) AS n FROM (SELECT 1 FROM media GROUP BY sha256 HAVING count(*) > 1) AS x", "media")),
    "a14_longest_media": (lambda s, d: audit.most(frame(s, d, "media"), "duration_ms"), sql("SELECT coalesce(max(duration_ms), 0) AS most FROM media", "media")),
    "a15_ingest_summary": (_a15, sql(LATEST.format(k="ingest_key", t="ilog") + "SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS {k}" for k in ("discovered", "pending", "validated", "accepted", "quarantined", "failed")) + ", count(*) FILTER (WHERE status IN ('discovered', 'pending', 'validated')) AS backlog, arg_max(error_code, id) FILTER (WHERE error_code IS NOT NULL) AS last_error_code, (SELECT count(*) FROM media) AS segments FROM cur", "ilog", "media")),
    "a21_import_counters": (lambda s, d: __import__("tidemark.operators.facts", fromlist=["x"]).import_counters(_resolved(s, d)), sql(RES + "SELECT collector_id, count(*) FILTER (WHERE status = 'accepted') AS imported, count(*) FILTER (WHERE status = 'duplicate') AS duplicates FROM res GROUP BY 1", "cand")),
    "j1_p1_current_ingest": (lambda s, d: statelog.latest(frame(s, d, "ilog"), ("ingest_key",), "id").select("ingest_key", "id", "status", "error_code"), sql(LATEST.format(k="ingest_key", t="ilog") + "SELECT ingest_key, id, status, error_code FROM cur", "ilog")),
    "p1_incremental": (lambda s, d: (lambda g: statelog.incremental(statelog.latest(g.where("id < 600"), ("ingest_key",), "id"), g.where("id >= 400"), ("ingest_key",), "id").select("ingest_key", "id", "status"))(frame(s, d, "ilog")), sql(LATEST.format(k="ingest_key", t="ilog") + "SELECT ingest_key, id, status FROM cur", "ilog")),
    "p2_segment_status": (lambda s, d: statelog.latest(frame(s, d, "slog"), ("media_segment_id",), "id").select("media_segment_id", "id", "status"), sql(LATEST.format(k="media_segment_id", t="slog") + "SELECT media_segment_id, id, status FROM cur", "slog")),
    "p3_module_states": (lambda s, d: statelog.latest(frame(s, d, "modules"), ("module",), "id"), sql(LATEST.format(k="module", t="modules") + "SELECT module, id, status, reason_code FROM cur", "modules")),
    "p3_last_mode": (lambda s, d: frame(s, d, "modes").agg(F.max_by("mode", "id").alias("mode")), sql("SELECT arg_max(mode, id) AS mode FROM modes", "modes")),
    "p4_summary": (_p4, sql(RES + ", cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ingest_key ORDER BY id DESC) AS rn FROM ilog) AS x WHERE rn = 1), b AS (SELECT 'c' || CAST(media_segment_id % 16 AS STRING) AS collector_id, count(*) AS backlog FROM cur WHERE status IN ('pending', 'validated') GROUP BY 1) "
        "SELECT r.collector_id, count(*) FILTER (WHERE status = 'accepted') AS imported, count(*) FILTER (WHERE status = 'duplicate') AS duplicates, any_value(backlog) AS backlog FROM res r LEFT JOIN b ON r.collector_id = b.collector_id GROUP BY 1", "cand", "ilog")),
    "w1_change_points": (_w1, sql(W1 + "SELECT * FROM ch", "ilog")),
    "w2_chained_keys": (lambda s, d: statelog.chained_key(_w1(s, d), "ingest_key", "id").select("id", "event_key"), sql(W1 + "SELECT id, sha256(ingest_key || chr(0) || CAST(coalesce(lag(id) OVER (PARTITION BY ingest_key ORDER BY id), 0) AS STRING)) AS event_key FROM ch", "ilog")),
    "w3_mode_transitions": (lambda s, d: statelog.mode_transitions(frame(s, d, "modes"), ("host_id",), "id").select("id", "old_mode", "mode"), sql("SELECT id, old AS old_mode, mode FROM (SELECT *, coalesce(lag(mode) OVER (PARTITION BY host_id ORDER BY id), 'unknown') AS old FROM modes) AS x WHERE old <> mode", "modes")),
    "w4_fault_edges": (_w4, sql("WITH w AS (SELECT *, status = 'error' AS dn, lag(status = 'error') OVER p AS was, lag(reason_code) OVER p AS oc FROM modules WINDOW p AS (PARTITION BY module ORDER BY id)), e AS (SELECT id, module, CASE WHEN dn AND (NOT coalesce(was, false) OR oc IS DISTINCT FROM reason_code) THEN 'degraded' WHEN NOT dn AND coalesce(was, false) THEN 'recovered' END AS edge FROM w) SELECT * FROM e WHERE edge IS NOT NULL", "modules")),
    "w5_disk_levels": (lambda s, d: statelog.level_changes(_levels(s, d), ("host_id",), "id").select("id", "old_level", "level", "severity"), sql("WITH l AS (SELECT *, CASE WHEN free_bytes <= 960 THEN 'reserve' WHEN free_bytes <= 980 THEN 'critical' WHEN free_bytes <= 990 THEN 'warning' ELSE 'normal' END AS level FROM samples), w AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY host_id ORDER BY id), 'normal') AS old_level FROM l) SELECT id, old_level, level, CASE level WHEN 'normal' THEN 'info' WHEN 'warning' THEN 'warning' ELSE 'critical' END AS severity FROM w WHERE level <> old_level", "samples")),
    "w10_crash_loops": (lambda s, d: statelog.bursts(frame(s, d, "faults").withColumn("s", F.floor(C("occurred_ns") / 1e9).cast("long")), ("module",), "s", 36000, 5).select("id", "recent"), sql("WITH f AS (SELECT *, CAST(floor(occurred_ns / 1e9) AS BIGINT) AS s FROM faults), w AS (SELECT id, count(*) OVER (PARTITION BY module ORDER BY s RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS recent FROM f) SELECT * FROM w WHERE recent >= 5", "faults")),
    "l2_recent_faults": (lambda s, d: statelog.top_recent(frame(s, d, "faults"), "id"), sql("SELECT id, module, severity, status, error_code, occurred_ns FROM faults ORDER BY id DESC LIMIT 20", "faults")),
    "q4_duplicate_gate": (lambda s, d: audit.duplicate_groups(frame(s, d, "media"), "sha256").select((C("n") == 0).alias("passed")), sql("SELECT count(*) = 0 AS passed FROM (SELECT 1 FROM media GROUP BY sha256 HAVING count(*) > 1) AS x", "media")),
    "q5_core_loss_gate": (lambda s, d: statelog.latest(frame(s, d, "slog"), ("media_segment_id",), "id").agg(F.count_if(C("status").isin("missing", "retention_deleted")).alias("lost")).select("lost", (C("lost") == 0).alias("passed")), sql(LATEST.format(k="media_segment_id", t="slog") + "SELECT count(*) FILTER (WHERE status IN ('missing', 'retention_deleted')) AS lost, count(*) FILTER (WHERE status IN ('missing', 'retention_deleted')) = 0 AS passed FROM cur", "slog")),
    "q12_media_duration_gate": (lambda s, d: audit.most(frame(s, d, "media"), "duration_ms").select((C("most") <= 600000).alias("passed")), sql("SELECT max(duration_ms) <= 600000 AS passed FROM media", "media")),
}
