"""Queries of samples, gates and verdicts: metric samples of three hosts over the days of January 2024."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, intervals, reconcile
from ..sources import readers
from ..sources.paths import work_dir
from .adapters import DAY, T0, frame, sql

C = F.col
DAY0 = T0 // DAY
PEAKS = ("working_set", "private_bytes", "handles")
LIMITS, FLOORS = {"working_set": 300.0, "private_bytes": 500.0, "handles": 96.0}, {"free_bytes": 700.0}


def _samples(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "samples")


def _peaks(s: SparkSession, d: str) -> DataFrame:
    return audit.daily_peaks(_samples(s, d), PEAKS)


PEAK = "WITH pk AS (SELECT host_id, day, max(working_set) AS working_set, max(private_bytes) AS private_bytes, max(handles) AS handles, min(free_bytes) AS free_bytes FROM samples GROUP BY 1, 2)"
RES_GATE = "coalesce(working_set <= 300 AND private_bytes <= 500 AND handles <= 96 AND free_bytes >= 700, false)"
FREE = ", fe AS (SELECT end_ns AS a, lead(start_ns, 1, 4611686018427387904) OVER (ORDER BY start_ns) AS b FROM exclusions UNION ALL SELECT -4611686018427387904, min(start_ns) FROM exclusions)"
GAP = f"""WITH po AS (SELECT DISTINCT host_id, day, at_ns AS t FROM samples UNION SELECT DISTINCT host_id, day, day * {DAY} FROM samples UNION SELECT DISTINCT host_id, day, (day + 1) * {DAY} FROM samples),
gp AS (SELECT * FROM (SELECT host_id, day, t AS s, lead(t) OVER (PARTITION BY host_id, day ORDER BY t) AS e FROM po) AS x WHERE e IS NOT NULL){FREE},
lf AS (SELECT host_id, day, gp.s, sum(least(e, b) - greatest(gp.s, a)) AS ns FROM gp JOIN fe ON gp.s < b AND e > a GROUP BY 1, 2, 3), ga AS (SELECT host_id, day, max(ns) / 1e9 AS gap_s FROM lf GROUP BY 1, 2)
"""
HEALTH = """, nn AS (SELECT host_id, day, count(*) AS samples, count(*) FILTER (WHERE status <> 'healthy' AND NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.start_ns <= at_ns AND at_ns < x.end_ns)) AS unhealthy FROM samples GROUP BY 1, 2),
sg AS (SELECT nn.host_id, nn.day, samples, unhealthy, gap_s, unhealthy = 0 AND coalesce(gap_s <= 3 * 7200, false) AS passed FROM nn LEFT JOIN ga ON nn.host_id = ga.host_id AND nn.day = ga.day)
"""


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Samples as nested JSON lines in files by day, read back."""
    path = work_dir(s, "samples")
    x = _samples(s, d)
    nested = x.select(
        "host_id", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), C("day").cast("int")), "yyyy-MM-dd").alias("date"),
        F.struct(F.struct(C("free_bytes").cast("long").alias("free_bytes")).alias("x")).alias("ignored"), F.struct(C("free_bytes").cast("long").alias("free_bytes")).alias("operations"),
        F.struct(C("pid").cast("int").alias("pid"), C("cpu_s").alias("cpu_total_seconds"), C("working_set").cast("long").alias("working_set_bytes")).alias("process"),
        F.array(F.struct(F.lit("c0").alias("collector_id"), C("id").alias("imported"), (C("id") % 7).alias("duplicates")), F.struct(F.lit("c1").alias("collector_id"), (C("id") % 11).alias("imported"), C("pid").alias("duplicates"))).alias("collectors"),
    )
    nested.write.partitionBy("date").json(path)
    return readers.run_samples(s, path)


def _s6(s: SparkSession, d: str) -> DataFrame:
    n = _nested(s, d)
    return n.groupBy("host_id", F.date_diff("date_local", F.lit("1970-01-01")).cast("long").alias("day")).agg(F.count("*").alias("n"), F.max("process.working_set_bytes").alias("peak"), F.min("operations.free_bytes").alias("free"))


def _a18(s: SparkSession, d: str) -> DataFrame:
    n = _nested(s, d).withColumn("day", F.date_diff("date_local", F.lit("1970-01-01")).cast("long")).withColumn("pid", C("process.pid").cast("long"))
    return audit.counter_peaks(n)


def _a20(s: SparkSession, d: str) -> DataFrame:
    days = _peaks(s, d).join(audit.supervisor_summary(_samples(s, d)), ["host_id", "day"])
    return audit.rollup(days, ("crashes", "restarts"), PEAKS, ("free_bytes",))


def _counts(s: SparkSession, d: str) -> DataFrame:
    x = _samples(s, d)
    return x.groupBy("day", C("host_id").alias("table_name")).agg(F.count("*").alias("n"))


KINDS = ("process", "reboot", "activity", "media", "restore", "rollback")


def _verdict(s: SparkSession, d: str) -> DataFrame:
    resources = audit.resource_gate(_peaks(s, d), LIMITS, FLOORS)
    health = audit.sample_gate(_samples(s, d), frame(s, d, "exclusions"), 7200)
    return audit.daily_verdict(resources, health)


def _all_hands(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "modes").where("mode = 'exam'").select("host_id", "id")


def _all_runs(s: SparkSession, d: str) -> DataFrame:
    """The first sample of each process on a host and day as a run: as many as the table has."""
    first = _samples(s, d).groupBy("host_id", "day", "pid").agg(F.min("id").alias("id"))
    return first.select("day", F.when(C("id") % 3 == 0, "failed").otherwise("passed").alias("status"), (5 + (C("id") % 4 == 1).cast("int")).alias("segments"), (C("id") % 5 != 2).alias("in_window"))


def _all_records(s: SparkSession, d: str) -> DataFrame:
    """Each sample as an exercise: its kind by its id, passed if healthy, with its value as the duration."""
    return _samples(s, d).select("id", F.get(F.array(*(F.lit(k) for k in KINDS)), (C("id") % 6).cast("int")).alias("kind"), F.when(C("status") == "healthy", "passed").otherwise("failed").alias("status"), C("private_bytes").alias("duration_s"), F.lit(90.0).alias("rto_s"))


ALL_REC = "WITH rc AS (SELECT id, CASE id % 6 WHEN 0 THEN 'process' WHEN 1 THEN 'reboot' WHEN 2 THEN 'activity' WHEN 3 THEN 'media' WHEN 4 THEN 'restore' ELSE 'rollback' END AS kind, CASE WHEN status = 'healthy' THEN 'passed' ELSE 'failed' END AS status, private_bytes AS duration_s FROM samples)"
VERDICT = f"{PEAK}, {GAP[5:]}{HEALTH}, dv AS (SELECT pk.host_id, pk.day, 2 AS gates, {RES_GATE} AND sg.passed AS passed FROM pk JOIN sg ON pk.host_id = sg.host_id AND pk.day = sg.day)"


def _sampled(s: SparkSession, d: str) -> DataFrame:
    files = frame(s, d, "media").withColumn("included", C("id") % 2 == 0).withColumn("day", C("id") % 5)
    return reconcile.media_sample(files, 4, "day").select("day", "path", F.when(C("id") % 14 == 4, "x").otherwise(C("sha256")).alias("sha256"))


def _bodies(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("media/"), C("doc_id").cast("string"), F.lit(".mp4")).alias("path"), F.encode("text", "UTF-8").alias("content"))


ENTRIES = {
    "s6_run_samples": (_s6, sql("SELECT host_id, day, count(*) AS n, max(CAST(trunc(working_set) AS BIGINT)) AS peak, min(CAST(trunc(free_bytes) AS BIGINT)) AS free FROM samples GROUP BY 1, 2", "samples")),
    "a17_daily_peaks": (_peaks, sql(PEAK + " SELECT * FROM pk", "samples")),
    "a18_counter_peaks": (_a18, sql("SELECT host_id, day, pid, c AS collector_id, max(CASE WHEN c = 'c0' THEN id ELSE id % 11 END) AS imported, max(CASE WHEN c = 'c0' THEN id % 7 ELSE pid END) AS duplicates FROM samples, (VALUES ('c0'), ('c1')) AS v(c) GROUP BY 1, 2, 3, 4", "samples")),
    "a19_supervisor": (lambda s, d: audit.supervisor_summary(_samples(s, d)), sql("SELECT host_id, day, count(DISTINCT crash_ns) AS crashes, greatest(count(DISTINCT pid) - 1, 0) AS restarts, count(*) FILTER (WHERE status = 'degraded') AS degraded, count(DISTINCT boot) AS boots FROM samples GROUP BY 1, 2", "samples")),
    "a20_rollup": (_a20, sql(PEAK + ", su AS (SELECT host_id, day, count(DISTINCT crash_ns) AS crashes, greatest(count(DISTINCT pid) - 1, 0) AS restarts FROM samples GROUP BY 1, 2) SELECT pk.host_id, CAST(sum(crashes) AS BIGINT) AS crashes, CAST(sum(restarts) AS BIGINT) AS restarts, max(working_set) AS working_set, max(private_bytes) AS private_bytes, max(handles) AS handles, min(free_bytes) AS free_bytes FROM pk JOIN su ON pk.host_id = su.host_id AND pk.day = su.day GROUP BY 1", "samples")),
    "a23_tree_sizes": (lambda s, d: audit.tree_sizes(frame(s, d, "media").withColumn("length", C("size_bytes")), C("collector_id")), sql("SELECT collector_id AS root, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM media GROUP BY 1", "media")),
    "w6_cpu_percent": (lambda s, d: audit.cpu_percent(_samples(s, d)).select("id", F.round("cpu_percent", 6).alias("cpu_percent")), sql("SELECT id, round(CASE WHEN lag(pid) OVER o = pid AND at_ns > lag(at_ns) OVER o THEN greatest(0, 100 * (cpu_s - lag(cpu_s) OVER o) / ((at_ns - lag(at_ns) OVER o) / 1e9)) END, 6) AS cpu_percent FROM samples WINDOW o AS (PARTITION BY host_id ORDER BY at_ns, id)", "samples")),
    "w7_largest_gap": (lambda s, d: audit.largest_gap(_samples(s, d), frame(s, d, "exclusions")).withColumn("gap_s", F.round("gap_s", 6)), sql(GAP + "SELECT host_id, day, round(gap_s, 6) AS gap_s FROM ga", "samples", "exclusions")),
    "j8_outside_windows": (lambda s, d: intervals.outside(_samples(s, d), "at_ns", frame(s, d, "exclusions")).select("id"), sql("SELECT id FROM samples WHERE NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.start_ns <= at_ns AND at_ns < x.end_ns)", "samples", "exclusions")),
    "j10_count_deltas": (lambda s, d: audit.count_deltas(_counts(s, d)), sql("WITH c AS (SELECT day, host_id AS table_name, count(*) AS n FROM samples GROUP BY 1, 2) SELECT a.day, a.table_name, a.n - b.n AS delta, a.n >= b.n AS passed FROM c a JOIN c b ON a.day = b.day + 1 AND a.table_name = b.table_name", "samples")),
    "q2_resource_gate": (lambda s, d: audit.resource_gate(_peaks(s, d), LIMITS, FLOORS), sql(PEAK + f" SELECT host_id, day, {RES_GATE} AS passed FROM pk", "samples")),
    "q3_sample_gate": (lambda s, d: audit.sample_gate(_samples(s, d), frame(s, d, "exclusions"), 7200).withColumn("gap_s", F.round("gap_s", 6)), sql(GAP + HEALTH + "SELECT host_id, day, samples, unhealthy, round(gap_s, 6) AS gap_s, passed FROM sg", "samples", "exclusions")),
    "q9_daily_verdict": (_verdict, sql(VERDICT + " SELECT * FROM dv", "samples", "exclusions")),
    "q13_media_sample_gate": (lambda s, d: audit.rehash_gate(_sampled(s, d), _bodies(s, d)), sql("WITH f AS (SELECT *, row_number() OVER (PARTITION BY id % 5 ORDER BY sha256, path) AS n FROM media WHERE id % 2 = 0) SELECT id % 5 AS day, count(*) AS n, bool_and(id % 14 <> 4) AS passed FROM f WHERE n <= 4 GROUP BY 1", "media")),
    "w9_backup_gaps_all": (lambda s, d: audit.backup_gaps(_samples(s, d).select("host_id", C("at_ns").alias("created_ns")), 86700).select("created_ns", F.round("gap_s", 6).alias("gap_s"), "rpo_met"), sql("WITH b AS (SELECT at_ns AS created_ns, (at_ns - lag(at_ns) OVER (PARTITION BY host_id ORDER BY at_ns)) / 1e9 AS g FROM samples) SELECT created_ns, round(g, 6) AS gap_s, g <= 86700 AS rpo_met FROM b", "samples")),
    "q6_exercise_gate_all": (lambda s, d: audit.exercise_gate(_all_records(s, d), KINDS), sql(ALL_REC + ", k AS (SELECT unnest(['process', 'reboot', 'activity', 'media', 'restore', 'rollback']) AS kind), g AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE status = 'passed' AND duration_s <= 90) AS p FROM rc GROUP BY 1) SELECT k.kind, coalesce(n, 0) AS n, coalesce(n = 1 AND p = 1, false) AS passed FROM k LEFT JOIN g ON k.kind = g.kind", "samples")),
    "q6_exercise_results_all": (lambda s, d: audit.exercise_results(_all_records(s, d)).select("id", "result", "error_code"), sql(ALL_REC + " SELECT id, CASE WHEN status = 'passed' AND duration_s <= 90 THEN 'passed' ELSE 'failed' END AS result, CASE WHEN status = 'passed' AND NOT coalesce(duration_s <= 90, false) THEN 'EXERCISE_RTO_MISSED' END AS error_code FROM rc", "samples")),
    "q7_publisher_gate_all": (lambda s, d: audit.publisher_gate(_all_runs(s, d), 5), sql("WITH f AS (SELECT day, min(id) AS id FROM samples GROUP BY host_id, day, pid), r AS (SELECT day, id % 3 <> 0 AS ok, id % 3 <> 0 AND id % 4 <> 1 AND id % 5 <> 2 AS good FROM f) SELECT day, count(*) FILTER (WHERE ok) AS runs, count(*) FILTER (WHERE ok) = 1 AND count(*) FILTER (WHERE good) = 1 AS passed FROM r GROUP BY 1", "samples")),
    "q10_final_verdict_all": (lambda s, d: audit.final_verdict(_verdict(s, d), DAY0 + 1, 14, _all_hands(s, d)), sql(VERDICT + f", hs AS (SELECT host_id, count(*) AS n FROM modes WHERE mode = 'exam' GROUP BY 1), fv AS (SELECT host_id, count(*) AS present, count(*) FILTER (WHERE passed) AS passing FROM dv WHERE day BETWEEN {DAY0 + 1} AND {DAY0 + 14} GROUP BY 1) SELECT h.host_id, coalesce(present, 0) AS present, coalesce(passing, 0) AS passing, coalesce(n, 0) AS interventions, coalesce(passing, 0) = 14 AND coalesce(n, 0) = 0 AS passed FROM (SELECT DISTINCT host_id FROM samples) h LEFT JOIN fv ON h.host_id = fv.host_id LEFT JOIN hs ON h.host_id = hs.host_id", "samples", "exclusions", "modes")),
    "q11_interventions_all": (lambda s, d: _all_hands(s, d), sql("SELECT host_id, id FROM modes WHERE mode = 'exam'", "modes")),
}
ENTRIES |= {name: ENTRIES[f"{name}_all"] for name in ("w9_backup_gaps", "q6_exercise_gate", "q6_exercise_results", "q7_publisher_gate", "q10_final_verdict", "q11_interventions")}  # names of earlier forms, which took some rows only
