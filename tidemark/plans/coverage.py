"""Queries of schedules, coverage and its gates: all collectors of the events over all their days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, coverage, intervals, timeline
from ..operators.publication import Publication
from ..sources import sinks
from ..sources.paths import stored, work_dir
from .adapters import DAY, T0, frame, sql

C = F.col
HOUR = DAY // 24
START, END = T0, T0 + 31 * DAY
NOW = T0 + 29 * DAY + 7 * HOUR
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _windows(c: DataFrame) -> DataFrame:
    """All day for activity collectors, two windows on working days for media."""
    days = c.select("collector_id", "kind", F.posexplode(F.array(*(F.lit(x) for x in DAYS))).alias("n", "day"))
    all_day = days.where("kind = 'activity'").select("collector_id", "day", F.lit(0).alias("start_minute"), F.lit(1440).alias("end_minute"))
    work = days.where("kind = 'media' and n < 5").select("collector_id", "day", F.explode(F.array(F.struct(F.lit(480).alias("a"), F.lit(1080).alias("b")), F.struct(F.lit(1200).alias("a"), F.lit(1320).alias("b")))).alias("w"))
    return all_day.unionByName(work.select("collector_id", "day", C("w.a").alias("start_minute"), C("w.b").alias("end_minute")))


def _fleet(s: SparkSession, d: str) -> DataFrame:
    """The collectors, stored: they are found in all events."""
    return stored(frame(s, d, "fleet"), "fleet")


def _plans(c: DataFrame) -> DataFrame:
    return coverage.expand_schedule(c, _windows(c), START, END)


def _facts(s: SparkSession, d: str, c: DataFrame) -> DataFrame:
    t = timeline.build_timeline(frame(s, d, "raw"), frame(s, d, "hb"), frame(s, d, "media"))
    return timeline.coverage_facts(t).join(c.select("collector_id"), "collector_id", "left_semi")


def _whole(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collectors, plans and facts (with projection_id), stored as any timeline projection is: all are read several times."""
    c = _fleet(s, d)
    facts = _facts(s, d, c).withColumn("projection_id", F.split_part("stable_id", F.lit(":"), F.lit(2)).cast("long"))
    return c, stored(_plans(c), "plans"), stored(facts, "facts")


def _coverage(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coverage, stored, with the collectors and plans that it is of."""
    c, plans, facts = _whole(s, d)
    return stored(coverage.build_coverage(c, plans, facts.drop("projection_id"), START, END, NOW), "coverage"), c, plans


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_flags", F.concat_ws(",", "quality_flags"))


def _cte(start: int, end: int, now: int, days: list[int], fleet: str) -> str:
    """Facts, plans, pieces and coverage of a range; days: the working days in it."""
    return f"""WITH fl AS (
  SELECT collector_id, device_ns + clock_offset_ms * 1000000 AS s, device_ns + clock_offset_ms * 1000000 + (id % 300) * 1000000000 AS e, CASE WHEN id % 6 = 0 THEN 'confirmed_idle' ELSE 'covered' END AS av,
    CASE WHEN id % 6 = 0 THEN 'ACTIVITYWATCH_AFK' ELSE 'ACTIVITYWATCH_EVENT' END AS rc, CASE WHEN id % 6 = 0 THEN 40 ELSE 20 END AS pr, 'event:' || CAST(id AS STRING) AS sid, CASE WHEN clock_error_ms > 1000 THEN ['clock_uncertain'] ELSE [] END AS fg
  FROM raw WHERE event_type = 'activitywatch.event' AND id % 5 <> 0 AND id % 300 > 0
  UNION ALL SELECT collector_id, device_start_ns + clock_offset_ms * 1000000, device_end_ns + clock_offset_ms * 1000000, CASE WHEN state = 'idle' THEN 'confirmed_idle' ELSE 'covered' END, CASE WHEN state = 'idle' THEN 'HEARTBEAT_IDLE' ELSE 'HEARTBEAT_ACTIVE' END, 30, 'heartbeat:' || CAST(id AS STRING), list_concat(quality_flags, CASE WHEN clock_error_ms > 1000 THEN ['clock_uncertain'] ELSE [] END) FROM hb
  UNION ALL SELECT collector_id, device_start_ns, device_end_ns, 'covered', 'MEDIA_ACCEPTED', 30, 'media:' || CAST(id AS STRING), CASE WHEN clock_error_ms > 1000 THEN ['clock_uncertain'] ELSE [] END FROM media
), f AS (SELECT fl.* FROM fl JOIN {fleet} USING (collector_id)),
plans AS (
  SELECT collector_id, CASE WHEN timezone = 'UTC' THEN {start} ELSE {start - DAY + 5 * HOUR} END AS ps, {start} AS s, {end} AS e FROM {fleet} WHERE kind = 'activity'
  UNION ALL SELECT collector_id, {start} + k * {DAY} + a * {HOUR}, {start} + k * {DAY} + a * {HOUR}, {start} + k * {DAY} + b * {HOUR} FROM {fleet}, (SELECT unnest({days}) AS k) AS d, (VALUES (8, 18), (20, 22)) AS h(a, b) WHERE kind = 'media'
), lim AS (SELECT collector_id, heartbeat_period_ns AS p, heartbeat_period_ns + allowed_lateness_ns AS pl, offline_after_ns AS off FROM {fleet}),
fr AS (SELECT f.*, p, pl, off FROM f JOIN lim USING (collector_id) WHERE f.s < {end} AND f.e > {start} - off),
t AS (
  SELECT collector_id, unnest([ps + p, ps + pl, ps + off, s, e, {now}]) AS t FROM plans JOIN lim USING (collector_id)
  UNION SELECT collector_id, unnest([s, e, e + p, e + pl, e + off]) FROM fr
), pt AS (SELECT DISTINCT plans.collector_id, ps, s AS pw, t FROM plans JOIN t ON plans.collector_id = t.collector_id AND t.t >= s AND t.t <= e),
sg AS (SELECT * FROM (SELECT collector_id, ps, pw, t AS s, lead(t) OVER (PARTITION BY collector_id, pw ORDER BY t) AS e FROM pt) AS x WHERE e IS NOT NULL),
wn AS (SELECT sg.collector_id, sg.s, sg.e, arg_min({{'av': av, 'rc': rc}}, (-pr, sid)) AS w, list_sort(list_distinct(flatten(list(fg)))) AS fg FROM sg JOIN fr ON sg.collector_id = fr.collector_id AND fr.s <= sg.s AND fr.e >= sg.e GROUP BY 1, 2, 3),
ends AS (SELECT collector_id, e FROM fr),
la AS (SELECT sg.collector_id, sg.s, max(ends.e) AS last FROM sg JOIN ends ON sg.collector_id = ends.collector_id AND ends.e <= sg.s GROUP BY 1, 2),
cl AS (SELECT sg.*, w, coalesce(array_to_string(fg, ','), '') AS fg, coalesce(last, ps) AS ref, p, pl, off FROM sg LEFT JOIN wn ON sg.collector_id = wn.collector_id AND sg.s = wn.s AND sg.e = wn.e LEFT JOIN la ON sg.collector_id = la.collector_id AND sg.s = la.s JOIN lim ON sg.collector_id = lim.collector_id),
st AS (SELECT collector_id, pw, s, e, fg, CASE WHEN w IS NOT NULL THEN w.av WHEN s >= {now} OR {now} < ref + pl THEN 'pending' WHEN s < ref + p THEN 'unknown' WHEN s < ref + off THEN 'delayed' ELSE 'offline' END AS av,
  CASE WHEN w IS NOT NULL THEN w.rc WHEN s >= {now} THEN 'SCHEDULED_FUTURE' WHEN {now} < ref + pl THEN 'AWAITING_HEARTBEAT' WHEN s < ref + p THEN 'HEARTBEAT_MISSING' WHEN s < ref + off THEN 'HEARTBEAT_LATE' ELSE 'HEARTBEAT_OFFLINE' END AS rc FROM cl),
mg AS (SELECT *, sum(nw) OVER (PARTITION BY collector_id, pw ORDER BY s) AS i FROM (SELECT *, CASE WHEN lag(e) OVER o = s AND lag(av) OVER o = av AND lag(rc) OVER o = rc AND lag(fg) OVER o = fg THEN 0 ELSE 1 END AS nw FROM st WINDOW o AS (PARTITION BY collector_id, pw ORDER BY s)) AS x),
cov AS (SELECT collector_id, min(s) AS start_ns, max(e) AS end_ns, any_value(av) AS availability, any_value(rc) AS reason_code, any_value(fg) AS quality_flags FROM mg GROUP BY collector_id, pw, i)
"""


CTE = _cte(START, END, NOW, [k for k in range(31) if k % 7 < 5], "fleet")
_ALL = ("raw", "hb", "media", "fleet", "exclusions")
# what is left of an interval (s, e) without the exclusion windows: between the windows' ends and starts
FREE = """, xw AS (SELECT start_ns AS a, end_ns AS b FROM exclusions), fe AS (SELECT b AS a, lead(a, 1, 4611686018427387904) OVER (ORDER BY a) AS b FROM xw UNION ALL SELECT -4611686018427387904, min(a) FROM xw)
"""
LEFT = """, lf AS (SELECT cov.collector_id, greatest(start_ns, a) AS s, least(end_ns, b) AS e, availability AS av, quality_flags AS fg FROM cov JOIN fe ON start_ns < b AND end_ns > a)
"""
SEC = """, us AS (SELECT lf.*, (e - s) / 1e9 AS sec, kind, NOT (contains(fg, 'corrupt') OR contains(fg, 'incomplete') OR kind = 'media' AND contains(fg, 'obscured')) AND (av = 'covered' OR av = 'confirmed_idle' AND kind = 'activity') AS ok FROM lf JOIN fleet USING (collector_id)),
av AS (SELECT collector_id, """ + ", ".join(f"sum(CASE WHEN av = '{k}' THEN sec ELSE 0 END) AS {k}_s" for k in ("covered", "confirmed_idle", "pending", "unknown", "delayed", "offline")) + """, sum(sec) AS total_s, sum(CASE WHEN ok THEN sec ELSE 0 END) AS usable_s, sum(CASE WHEN ok THEN sec ELSE 0 END) / sum(sec) AS ratio FROM us GROUP BY 1)
"""
RUN = """, rb AS (SELECT *, av IN ('offline', 'unknown') AS bad FROM lf), rn AS (SELECT *, CASE WHEN bad AND lag(e) OVER o = s AND lag(bad) OVER o THEN 0 ELSE 1 END AS nw FROM rb WINDOW o AS (PARTITION BY collector_id ORDER BY s)),
ri AS (SELECT *, sum(nw) OVER (PARTITION BY collector_id ORDER BY s) AS i FROM rn), rr AS (SELECT collector_id, max(ns) AS longest_ns FROM (SELECT collector_id, i, sum(CASE WHEN bad THEN e - s ELSE 0 END) AS ns FROM ri GROUP BY 1, 2) AS x GROUP BY 1)
"""
EXP = """, ex AS (SELECT collector_id, sum(least(e, b) - greatest(s, a)) / 1e9 AS expected_s FROM plans JOIN fe ON s < b AND e > a GROUP BY 1)
"""


def _left(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cov, c, _ = _coverage(s, d)
    return stored(intervals.subtract(cov, frame(s, d, "exclusions")), "left"), c


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _gate(s: SparkSession, d: str) -> DataFrame:
    cov, c, plans = _coverage(s, d)
    states = c.select("collector_id", F.when(C("collector_id") == "c2", "stale").otherwise("fresh").alias("state"))
    return _round(audit.coverage_gate(cov, c, coverage.expected_seconds(plans, frame(s, d, "exclusions")), states, frame(s, d, "exclusions")), "planned_s", "classified_s", "ratio", "longest_bad_s")


def _stale(s: SparkSession, d: str) -> DataFrame:
    c = _fleet(s, d).withColumn("timezone", F.when(C("collector_id") == "c1", "Missing/Timezone").otherwise(C("timezone")))
    good, bad = coverage.split_stale(c)
    old = c.select("collector_id", F.lit(4).cast("long").alias("generation")).where("collector_id <> 'c3'")
    marks = frame(s, d, "raw").select("collector_id", C("id").alias("projection_id"))
    return coverage.projection_state(marks, good, bad, old)


def _published(s: SparkSession, d: str) -> DataFrame:
    """Two generations written, the second published for some collectors only."""
    path = work_dir(s, "coverage")
    rows = frame(s, d, "hb").select("collector_id", C("id"))
    sinks.write_generation(rows.where("id % 2 = 0"), path, 1)
    sinks.publish(s, path, rows.select("collector_id").distinct().select("collector_id", F.lit(1).alias("generation"), F.lit("fresh").alias("state")), 1)
    sinks.write_generation(rows, path, 2)
    two = rows.select("collector_id").distinct().where("collector_id < 'c4'")
    sinks.publish(s, path, two.select("collector_id", F.lit(2).alias("generation"), F.when(C("collector_id") == "c0", "stale").otherwise("fresh").alias("state")), 2)
    return sinks.published(s, path).select("id", "collector_id", C("generation").cast("long").alias("generation"))


LATE = "stable_id LIKE 'heartbeat:%7'"


def _late(s: SparkSession, d: str) -> DataFrame:
    """The days whose coverage some heartbeats can change."""
    c = _fleet(s, d)
    return coverage.affected_days(_facts(s, d, c).where(LATE), c)


def _stabbed(facts: DataFrame) -> DataFrame:
    """Facts that cover the first second of an activity interval."""
    seconds = facts.where("priority = 20").select("collector_id", "start_ns", (C("start_ns") + 10**9).alias("end_ns")).distinct()
    return intervals.stab_join(seconds, facts.where("priority = 30"), "collector_id").select("collector_id", "start_ns", "end_ns", C("f_stable_id").alias("stable_id"))


BY_DAY = f"""SELECT collector_id, greatest(start_ns, k * {DAY}) AS start_ns, least(end_ns, (k + 1) * {DAY}) AS end_ns, availability, reason_code, quality_flags
FROM (SELECT *, unnest(range(start_ns // {DAY}, (end_ns - 1) // {DAY} + 1)) AS k FROM cov) AS x"""
AFFECTED = f"SELECT DISTINCT collector_id, unnest(range(CAST(floor(s / {DAY}) AS BIGINT), CAST(floor((e + off) / {DAY}) AS BIGINT) + 1)) AS day FROM f JOIN lim USING (collector_id) WHERE sid LIKE 'heartbeat:%7'"


def _rebuilt(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, plans, facts = _whole(s, d)
    old = c.where("collector_id <> 'c3'").select("collector_id", F.lit(4).cast("long").alias("generation"))
    return coverage.rebuild(c, plans, facts, old, START, END, NOW)


def _repaired(s: SparkSession, d: str) -> DataFrame:
    """Coverage without some heartbeats, then those days built anew that they can change."""
    c, plans, facts = _whole(s, d)
    old = stored(coverage.by_day(coverage.build_coverage(c, plans, facts.where(f"NOT {LATE}"), START, END, NOW)), "early")
    return _flat(coverage.repaired(c, plans, facts, facts.where(LATE), old, START, END, NOW).drop("day"))


def _publication(s: SparkSession, d: str) -> Publication:
    """Coverage published by day without some heartbeats, which then come and have their days published again."""
    c, plans, facts = _whole(s, d)
    own = Publication(s, work_dir(s, "publication"), c, plans, START, END)
    own.add(facts.where(f"NOT {LATE}"), 0)
    own.publish(0, NOW, own.windows)
    own.add(facts.where(LATE), 1)
    own.publish(1, NOW)
    return own


ENTRIES = {
    "c3_subtract": (lambda s, d: intervals.subtract(frame(s, d, "hb").select("id", C("device_start_ns").alias("start_ns"), C("device_end_ns").alias("end_ns")), frame(s, d, "exclusions")), sql("WITH " + FREE[2:] + "SELECT id, greatest(device_start_ns, a) AS start_ns, least(device_end_ns, b) AS end_ns FROM hb JOIN fe ON device_start_ns < b AND device_end_ns > a", "hb", "exclusions")),
    "c4_schedule": (lambda s, d: _plans(_fleet(s, d)), sql(CTE + "SELECT collector_id, ps AS plan_start_ns, s AS start_ns, e AS end_ns FROM plans", *_ALL)),
    "c5_c6_c7_c8_c10_coverage": (lambda s, d: _flat(_coverage(s, d)[0]), sql(CTE + "SELECT * FROM cov", *_ALL)),
    "c11_stale_collectors": (_stale, sql("SELECT collector_id, CASE collector_id WHEN 'c1' THEN 4 WHEN 'c3' THEN 1 ELSE 5 END AS generation, CASE WHEN collector_id = 'c1' THEN 'stale' ELSE 'fresh' END AS state, CASE WHEN collector_id = 'c1' THEN 'COVERAGE_TIMEZONE_INVALID' END AS error_code, CASE WHEN collector_id = 'c1' THEN 0 ELSE (SELECT max(id) FROM raw WHERE raw.collector_id = fleet.collector_id) END AS watermark FROM fleet", "raw", "fleet")),
    "c12_expected_seconds": (lambda s, d: _round(coverage.expected_seconds(stored(_plans(_fleet(s, d)), "plans"), frame(s, d, "exclusions")), "expected_s"), sql(CTE + FREE + EXP + "SELECT collector_id, round(expected_s, 6) AS expected_s FROM ex", *_ALL)),
    "j7_stab_join": (lambda s, d: _stabbed(stored(_facts(s, d, _fleet(s, d)), "facts")), sql(CTE + "SELECT DISTINCT a.collector_id, a.s AS start_ns, a.s + 1000000000 AS end_ns, b.sid AS stable_id FROM f a JOIN f b ON a.collector_id = b.collector_id AND a.pr = 20 AND b.pr = 30 AND b.s <= a.s AND b.e >= a.s + 1000000000", *_ALL)),
    "l6_winners": (lambda s, d: _facts(s, d, _fleet(s, d)).groupBy("collector_id", F.floor((C("start_ns") - T0) / DAY).alias("day")).agg(F.min_by("stable_id", F.struct(-C("priority"), "stable_id")).alias("winner")), sql(CTE + f"SELECT collector_id, CAST(floor((s - {T0}) / {DAY}) AS BIGINT) AS day, arg_min(sid, (-pr, sid)) AS winner FROM f GROUP BY 1, 2", *_ALL)),
    "s8_published_rows": (_published, sql("SELECT id, collector_id, CASE WHEN collector_id < 'c4' THEN 2 ELSE 1 END AS generation FROM hb WHERE collector_id <> 'c0' AND (collector_id < 'c4' OR id % 2 = 0)", "hb")),
    "s8_published_generation": (lambda s, d: _published(s, d).groupBy("collector_id", "generation").agg(F.count("*").alias("n")), sql("SELECT collector_id, CASE WHEN collector_id < 'c4' THEN 2 ELSE 1 END AS generation, count(*) FILTER (WHERE collector_id < 'c4' OR id % 2 = 0) AS n FROM hb WHERE collector_id <> 'c0' GROUP BY 1", "hb")),
    "t7_affected_days": (_late, sql(CTE + AFFECTED, *_ALL)),
    "q8_overlaps": (lambda s, d: intervals.overlaps(frame(s, d, "hb").select("collector_id", "id", C("device_start_ns").alias("start_ns"), C("device_end_ns").alias("end_ns")), "collector_id").select("id", "next_start_ns"), sql("SELECT id, nx AS next_start_ns FROM (SELECT *, lead(device_start_ns) OVER (PARTITION BY collector_id ORDER BY device_start_ns, device_end_ns) AS nx FROM hb) AS x WHERE nx < device_end_ns", "hb")),
    "q8_coverage_has_no_overlap": (lambda s, d: intervals.overlaps(_coverage(s, d)[0], "collector_id").agg(F.count("*").alias("n")), sql(CTE + "SELECT count(*) FILTER (WHERE nx < end_ns) AS n FROM (SELECT end_ns, lead(start_ns) OVER (PARTITION BY collector_id ORDER BY start_ns, end_ns) AS nx FROM cov) AS x", *_ALL)),
    "w8_longest_bad_run": (lambda s, d: intervals.longest_run(_left(s, d)[0], "collector_id", C("availability").isin("offline", "unknown")), sql(CTE + FREE + LEFT + RUN + "SELECT collector_id, longest_ns FROM rr", *_ALL)),
    "a16_availability": (lambda s, d: _round(audit.availability_seconds(*_left(s, d)), "covered_s", "confirmed_idle_s", "pending_s", "unknown_s", "delayed_s", "offline_s", "total_s", "usable_s", "ratio"), sql(CTE + FREE + LEFT + SEC + "SELECT collector_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in ("covered_s", "confirmed_idle_s", "pending_s", "unknown_s", "delayed_s", "offline_s", "total_s", "usable_s", "ratio")) + " FROM av", *_ALL)),
    "q1_coverage_gate": (_gate, sql(CTE + FREE + LEFT + SEC + RUN + EXP + """SELECT ex.collector_id, round(expected_s, 6) AS planned_s, round(coalesce(total_s, 0), 6) AS classified_s, round(ratio, 6) AS ratio, round(coalesce(longest_ns, 0) / 1e9, 6) AS longest_bad_s,
        coalesce(expected_s > 0 AND abs(coalesce(total_s, 0) - expected_s) <= 0.001 AND ratio >= 0.99 AND coalesce(longest_ns, 0) / 1e9 <= CASE WHEN kind = 'media' THEN 900 ELSE 300 END AND ex.collector_id <> 'c2', false) AS passed
        FROM ex LEFT JOIN av USING (collector_id) LEFT JOIN rr USING (collector_id) JOIN fleet USING (collector_id)""", *_ALL)),
    # kept up as facts come
    "c10_rebuilt_all": (lambda s, d: _flat(_rebuilt(s, d)[0]), sql(CTE + "SELECT cov.*, CASE WHEN collector_id = 'c3' THEN 1 ELSE 5 END AS generation FROM cov", *_ALL)),
    "c10_states_all": (lambda s, d: _rebuilt(s, d)[1], sql(CTE + f"SELECT collector_id, {START} AS start_ns, {END} AS end_ns, CASE WHEN collector_id = 'c3' THEN 1 ELSE 5 END AS generation, 'fresh' AS state, coalesce((SELECT max(CAST(split_part(sid, ':', 2) AS BIGINT)) FROM fr WHERE fr.collector_id = fleet.collector_id), 0) AS watermark FROM fleet", *_ALL)),
    "t7_published_days": (lambda s, d: _flat(_publication(s, d).coverage()), sql(CTE + "SELECT * FROM cov", *_ALL)),
    "t7_published_states": (lambda s, d: _publication(s, d).states().select("collector_id", "day", "generation"), sql(CTE + f""", pd AS (SELECT DISTINCT collector_id, unnest(range(s // {DAY}, (e - 1) // {DAY} + 1)) AS day FROM plans), ad AS ({AFFECTED})
        SELECT pd.collector_id, pd.day, CASE WHEN ad.day IS NULL THEN 1 ELSE 2 END AS generation FROM pd LEFT JOIN ad ON pd.collector_id = ad.collector_id AND pd.day = ad.day""", *_ALL)),
    "t7_repaired_all": (_repaired, sql(CTE + BY_DAY, *_ALL)),
}
