"""Coverage: planned windows cut where evidence or a deadline changes the answer, and each piece classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import NS, epoch_us, weekday_name
from ..sources.paths import stored
from .intervals import BOUNDS, DAY_NS, bucket, merge_adjacent, overlapping, positive, subtract
from .sweep import strongest

STATE = ("availability", "reason_code", "quality_flags")


def expand_schedule(collectors: DataFrame, windows: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """(collector_id, plan_start_ns, start_ns, end_ns): windows clipped to [start, end), then merged where they touch.

    collectors: collector_id, timezone; windows: collector_id, day (english, lower case), start_minute,
    end_minute (1440: 24:00), by local wall clock.  plan_start_ns is where the first window began before clipping.
    A local time that comes twice is the first; one that is skipped is moved on by the gap.
    """
    day = lambda ns, d: F.date_add(F.lit("1970-01-01").cast("date"), ns // (86400 * NS) + d)
    days = collectors.select("collector_id", "timezone").withColumn("day_date", F.explode(F.sequence(day(start_ns, -1), day(end_ns, 1))))
    days = days.withColumn("day", weekday_name(F.col("day_date"))).join(windows, ["collector_id", "day"])

    def at(minute: str) -> Column:
        local = F.date_format(F.date_add("day_date", F.floor(F.col(minute) / 1440).cast("int")), "yyyy-MM-dd")
        clock = F.format_string("%s %02d:%02d:00", local, F.floor(F.col(minute) % 1440 / 60), F.col(minute) % 60)
        utc = F.expr("convert_timezone(timezone, 'UTC', _t)")
        return clock, utc

    out = days
    for name, minute in (("plan_start_ns", "start_minute"), ("plan_end_ns", "end_minute")):
        clock, utc = at(minute)
        out = out.withColumn("_t", clock.cast("timestamp_ntz")).withColumn(name, epoch_us(utc) * 1000)
    out = out.select("collector_id", F.col("plan_start_ns").alias("start_ns"), F.col("plan_end_ns").alias("end_ns")).where(positive() & overlapping(start_ns, end_ns))
    order = W.partitionBy("collector_id").orderBy("start_ns", "end_ns")
    before = F.max("end_ns").over(order.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("_new", F.when(before.isNull() | (F.col("start_ns") > before), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(order))
    out = out.groupBy("collector_id", "_i").agg(F.min("start_ns").alias("plan_start_ns"), F.max("end_ns").alias("end_ns")).drop("_i")
    out = out.withColumn("start_ns", F.greatest("plan_start_ns", F.lit(start_ns))).withColumn("end_ns", F.least("end_ns", F.lit(end_ns)))
    return out.where(positive()).select("collector_id", "plan_start_ns", *BOUNDS)


def by_day(df: DataFrame) -> DataFrame:
    """df with ``day`` (since 1970), each interval cut at midnight UTC."""
    cut = df.withColumn("day", F.explode(F.sequence(bucket(F.col("start_ns"), DAY_NS), bucket(F.col("end_ns") - 1, DAY_NS))))
    return cut.withColumns({"start_ns": F.greatest("start_ns", F.col("day") * DAY_NS), "end_ns": F.least("end_ns", (F.col("day") + 1) * DAY_NS)})


def plan_days(plans: DataFrame) -> DataFrame:
    """plans (see expand_schedule) cut at midnight, with ``plan``, the start of the window that a part belongs to, and ``day``."""
    return by_day(plans.withColumn("plan", F.col("start_ns")))


def build_coverage(collectors: DataFrame, plans: DataFrame, facts: DataFrame, start_ns: int, end_ns: int, now_ns: int) -> DataFrame:
    """(collector_id, start_ns, end_ns, availability, reason_code, quality_flags) for all planned time.

    collectors: collector_id, heartbeat_period_ns, allowed_lateness_ns, offline_after_ns; plans as from
    expand_schedule; facts as from coverage_facts, of which those count that overlap the range widened by
    offline_after before it.  All collectors in one job, and each by days (see build_days); pieces that meet at
    midnight are merged at the end.
    """
    return met_at_midnight(build_days(collectors, plan_days(plans), facts, start_ns, end_ns, now_ns))


def build_days(collectors: DataFrame, windows: DataFrame, facts: DataFrame, start_ns: int, end_ns: int, now_ns: int, carried: DataFrame | None = None) -> DataFrame:
    """(collector_id, plan, day, start_ns, end_ns, availability, reason_code, quality_flags) of windows (see plan_days).

    Facts are swept once (see sweep.strongest); where none holds, the last end of evidence is where the stretch before ends.
    carried: (collector_id, day, carried), the last end of evidence before each day; without it, that of the facts,
    as one row a day.  With it, facts need only be those that reach into the days widened by offline_after before them.
    """
    limits = collectors.select("collector_id", F.col("heartbeat_period_ns").alias("period"), F.col("allowed_lateness_ns").alias("late"), F.col("offline_after_ns").alias("off"))
    reach = F.lit(start_ns) - F.col("off")
    facts = facts.join(limits.select("collector_id", "off"), "collector_id").where((F.col("start_ns") < end_ns) & (F.col("end_ns") > reach))
    facts = facts.withColumns({"start_ns": F.greatest("start_ns", reach), "end_ns": F.least("end_ns", F.lit(end_ns))})
    busy = stored(by_day(strongest(facts, "collector_id")), "busy")  # read three times
    key = ("collector_id", "plan", "plan_start_ns", "day")
    windows = windows.select(*key, F.col("start_ns").alias("from_ns"), F.col("end_ns").alias("to_ns"))
    held = busy.join(windows, ["collector_id", "day"]).where((F.col("start_ns") < F.col("to_ns")) & (F.col("end_ns") > F.col("from_ns")))
    held = held.withColumns({"start_ns": F.greatest("start_ns", "from_ns"), "end_ns": F.least("end_ns", "to_ns")})

    # the last end of evidence before each window, ends before starts where they meet: of its own day, or of the days before
    ends = busy.select("collector_id", "day", F.col("end_ns").alias("t"))
    starts = windows.select("collector_id", "day", F.col("from_ns").alias("t")).distinct()
    before = W.partitionBy("collector_id", "day").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    none = F.lit(None).cast("long")
    both = ends.select("*", F.lit(0).alias("kind"), F.col("t").alias("last")).unionByName(starts.select("*", F.lit(1).alias("kind"), none.alias("last")))
    both = both.withColumn("last", F.max("last").over(before)).where("kind = 1").select("collector_id", "day", F.col("t").alias("from_ns"), "last")
    days = ends.unionByName(starts.withColumn("t", none)).groupBy("collector_id", "day").agg(F.max("t").alias("t"))
    earlier = days.select("collector_id", "day", F.max("t").over(W.partitionBy("collector_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    last = both.join(earlier, ["collector_id", "day"], "left")
    if carried is not None:
        last = last.join(carried, ["collector_id", "day"], "left").withColumn("earlier", F.greatest("earlier", "carried"))
    last = last.select("collector_id", "from_ns", F.greatest("last", "earlier").alias("last"))

    # what no evidence holds: from a window's start or the end of evidence, which then is the last one, to the next
    free = windows.join(last, ["collector_id", "from_ns"], "left").select(*key, "to_ns", F.col("from_ns").alias("start_ns"), F.col("from_ns").alias("end_ns"), "last")
    free = free.unionByName(held.select(*key, "to_ns", *BOUNDS, F.col("end_ns").alias("last")))
    after = F.lead("start_ns").over(W.partitionBy(*key).orderBy(*BOUNDS))
    free = free.select(*key, "last", F.col("end_ns").alias("start_ns"), F.coalesce(after, "to_ns").alias("end_ns")).where(positive()).join(limits, "collector_id")
    ref = F.coalesce("last", "plan_start_ns")
    cuts = F.array(F.lit(now_ns).cast("long"), ref + F.col("period"), ref + F.col("period") + F.col("late"), ref + F.col("off"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(*BOUNDS), F.filter(cuts, lambda t: (t > F.col("start_ns")) & (t < F.col("end_ns"))))))
    free = free.withColumn("_cuts", cuts).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_cuts") - 2)))
    free = free.withColumns({"start_ns": F.get("_cuts", F.col("_i")), "end_ns": F.get("_cuts", F.col("_i") + 1)})
    ladder = (
        F.when(F.col("start_ns") >= now_ns, _state("pending", "SCHEDULED_FUTURE"))
        .when(F.lit(now_ns) < ref + F.col("period") + F.col("late"), _state("pending", "AWAITING_HEARTBEAT"))
        .when(F.col("start_ns") < ref + F.col("period"), _state("unknown", "HEARTBEAT_MISSING"))
        .when(F.col("start_ns") < ref + F.col("off"), _state("delayed", "HEARTBEAT_LATE"))
        .otherwise(_state("offline", "HEARTBEAT_OFFLINE"))
    )
    columns = ["collector_id", "plan", "day", *BOUNDS]
    free = free.withColumn("state", ladder).select(*columns, "state.availability", "state.reason_code", F.array().cast("array<string>").alias("quality_flags"))
    return merge_adjacent(held.select(*columns, *STATE).unionByName(free), ("collector_id", "plan", "day"), STATE)


def met_at_midnight(days: DataFrame) -> DataFrame:
    """Coverage (collector_id, start_ns, end_ns, STATE) from that of days: parts of a window that agree across midnight are one."""
    columns = ["collector_id", *BOUNDS, *STATE]
    midnight = (F.col("start_ns") % DAY_NS == 0) | (F.col("end_ns") % DAY_NS == 0)
    met = merge_adjacent(days.where(midnight), ("collector_id", "plan"), STATE)  # two rows a day at most
    return days.where(~midnight).select(columns).unionByName(met.select(columns))


def rebuild(collectors: DataFrame, plans: DataFrame, facts: DataFrame, old: DataFrame, start_ns: int, end_ns: int, now_ns: int) -> tuple[DataFrame, DataFrame]:
    """A new generation of coverage of a range, and its state rows (collector_id, start_ns, end_ns, generation, state, watermark).

    facts have ``projection_id``; the watermark is the largest of those that the build used, looking back
    offline_after before the range; 0 if there is none.  old: (collector_id, generation).
    """
    used = facts.join(collectors.select("collector_id", F.col("offline_after_ns").alias("_off")), "collector_id").where((F.col("start_ns") < end_ns) & (F.col("end_ns") > F.lit(start_ns) - F.col("_off")))
    marks = used.groupBy("collector_id").agg(F.max("projection_id").alias("watermark"))
    states = collectors.select("collector_id").join(old, "collector_id", "left").join(marks, "collector_id", "left")
    states = states.select("collector_id", F.lit(start_ns).cast("long").alias("start_ns"), F.lit(end_ns).cast("long").alias("end_ns"), (F.coalesce("generation", F.lit(0)) + 1).cast("long").alias("generation"), F.lit("fresh").alias("state"), F.coalesce("watermark", F.lit(0)).cast("long").alias("watermark"))
    rows = build_coverage(collectors, plans, facts.drop("projection_id"), start_ns, end_ns, now_ns)
    return rows.join(states.select("collector_id", "generation"), "collector_id"), states


def repaired(collectors: DataFrame, plans: DataFrame, facts: DataFrame, late: DataFrame, old: DataFrame, start_ns: int, end_ns: int, now_ns: int) -> DataFrame:
    """old (coverage by day, before the late facts came) with the days that they can change built anew from all facts.

    Nothing is computed for other days; plans, old and the result are cut at midnight.
    """
    days = affected_days(late, collectors)
    anew = by_day(build_coverage(collectors, by_day(plans).join(days, ["collector_id", "day"], "left_semi").drop("day"), facts, start_ns, end_ns, now_ns))
    return old.join(days, ["collector_id", "day"], "left_anti").unionByName(anew.select(old.columns))


def _state(availability: str, reason: str) -> Column:
    return F.struct(F.lit(availability).alias("availability"), F.lit(reason).alias("reason_code"))


def split_stale(collectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collectors whose timezone is known, and a stale state row for each other one, which keeps its old generation."""
    zones = collectors.withColumn("_ok", F.expr("try_to_timestamp(concat('2024-01-01 00:00:00 ', timezone), 'yyyy-MM-dd HH:mm:ss VV')").isNotNull())
    bad = zones.where(~F.col("_ok")).select("collector_id", F.lit("stale").alias("state"), F.lit("COVERAGE_TIMEZONE_INVALID").alias("error_code"))
    return zones.where("_ok").drop("_ok"), bad


def projection_state(facts: DataFrame, collectors: DataFrame, stale: DataFrame, old: DataFrame) -> DataFrame:
    """(collector_id, generation, state, error_code, watermark): one more generation for each fresh collector, the old one (1 at least) for a stale one.

    facts: collector_id, projection_id; old: collector_id, generation.
    """
    marks = facts.groupBy("collector_id").agg(F.max("projection_id").alias("watermark"))
    fresh = collectors.select("collector_id").join(old, "collector_id", "left").join(marks, "collector_id", "left")
    fresh = fresh.select("collector_id", (F.coalesce("generation", F.lit(0)) + 1).alias("generation"), F.lit("fresh").alias("state"), F.lit(None).cast("string").alias("error_code"), F.coalesce("watermark", F.lit(0)).alias("watermark"))
    bad = stale.join(old, "collector_id", "left").select("collector_id", F.coalesce("generation", F.lit(1)).alias("generation"), "state", "error_code", F.lit(0).alias("watermark"))
    return fresh.unionByName(bad)


def affected_days(new_facts: DataFrame, collectors: DataFrame) -> DataFrame:
    """(collector_id, day): days since 1970 whose coverage late facts can change, up to offline_after past their ends."""
    off = collectors.select("collector_id", F.col("offline_after_ns").alias("_off"))
    day = lambda ns: bucket(ns, DAY_NS)
    return new_facts.join(off, "collector_id").select("collector_id", F.explode(F.sequence(day(F.col("start_ns")), day(F.col("end_ns") + F.col("_off")))).alias("day")).distinct()


def expected_seconds(plans: DataFrame, exclusions: DataFrame, *by: str) -> DataFrame:
    """(collector_id, expected_s): planned seconds without exclusion windows."""
    left = subtract(plans, exclusions)
    return left.groupBy("collector_id", *by).agg((F.sum(F.col("end_ns") - F.col("start_ns")) / float(NS)).alias("expected_s"))
