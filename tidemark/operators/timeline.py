"""The unified timeline: events, heartbeats and media as entries of one schema, ordered by corrected time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import NS, clock_uncertain, corrected_ns, duration_end_ns, json_number, json_text, merged_flags, valid_identifier
from .intervals import bucket

ACTIVITY = "activitywatch.event"
ORDER = ("start_ns", "received_ns", "source_type", "source_id", "stable_id")
COLUMNS = ("stable_id", "source_type", "source_id", "collector_id", "event_type", "start_ns", "end_ns", "received_ns", "clock_uncertain", "quality_flags", "payload")


def with_duration(df: DataFrame, name: str = "seconds", payload: str = "payload") -> DataFrame:
    """df with the seconds of a well-formed activity payload; null for any other.  The payload is parsed once."""
    df = df.withColumn("_v", F.try_parse_json(payload))
    v = F.col("_v")
    data = F.schema_of_variant(F.try_variant_get(v, "$.data", "variant"))
    fields = F.struct(json_number(v, "$.duration_seconds").alias("n"), json_number(v, "$.source_event_id").alias("id"), json_text(v, "$.bucket_id").alias("b"), json_text(v, "$.bucket_type").alias("t"), data.startswith("OBJECT").alias("d"))
    df = df.withColumn("_f", fields).drop("_v")
    df = df.withColumn("_f", F.explode(F.array("_f")))  # one row for one; a filter on the seconds stays above it, else each use in it would parse anew
    f = F.col("_f")
    ok = valid_identifier(f["b"], 256) & valid_identifier(f["t"], 128) & (f["id"] >= 0) & (f["id"] == F.floor(f["id"])) & (f["n"] >= 0) & (f["n"] <= 366 * 24 * 3600) & f["d"]
    return df.withColumn(name, F.when(ok, f["n"])).drop("_f")


def _flags(base: Column, uncertain: Column) -> Column:
    return merged_flags(base, F.when(uncertain, F.array(F.lit("clock_uncertain"))))


def project_events(events: DataFrame, uncertain_after_ns: int = NS) -> DataFrame:
    """Facts (id, collector_id, event_type, device_ns, clock_offset_ms, clock_error_ms, received_ns, payload) as entries.

    An activity event with a well-formed payload is an interval; one without stays a point, flagged incomplete.
    """
    uncertain = clock_uncertain(F.col("clock_error_ms"), uncertain_after_ns)
    df = with_duration(events.withColumn("_p", F.when(F.col("event_type") == ACTIVITY, F.col("payload"))), "_s", "_p")
    start = corrected_ns(F.col("device_ns"), F.col("clock_offset_ms"))
    broken = (F.col("event_type") == ACTIVITY) & F.col("_s").isNull()
    return df.select(
        F.concat(F.lit("event:"), F.col("id").cast("string")).alias("stable_id"), F.lit("raw_event").alias("source_type"), F.col("id").alias("source_id"), "collector_id", "event_type",
        start.alias("start_ns"), duration_end_ns(start, F.col("_s")).alias("end_ns"), "received_ns", uncertain.alias("clock_uncertain"),
        _flags(F.when(broken, F.array(F.lit("incomplete"))), uncertain).alias("quality_flags"), "payload",
    )


def _intervals(df: DataFrame, kind: str, prefix: str, event_type: Column, payload: Column, uncertain_after_ns: int) -> DataFrame:
    uncertain = clock_uncertain(F.col("clock_error_ms"), uncertain_after_ns)
    at = lambda c: corrected_ns(F.col(c), F.col("clock_offset_ms"))
    return df.select(
        F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string")).alias("stable_id"), F.lit(kind).alias("source_type"), F.col("id").alias("source_id"), "collector_id", event_type.alias("event_type"),
        at("device_start_ns").alias("start_ns"), at("device_end_ns").alias("end_ns"), "received_ns", uncertain.alias("clock_uncertain"), _flags(F.col("quality_flags"), uncertain).alias("quality_flags"), payload.alias("payload"),
    )


def project_heartbeats(df: DataFrame, uncertain_after_ns: int = NS) -> DataFrame:
    return _intervals(df, "heartbeat", "heartbeat", F.lit("collector.heartbeat"), F.to_json(F.struct("state")), uncertain_after_ns)


def project_media(df: DataFrame, uncertain_after_ns: int = NS) -> DataFrame:
    df = df if "quality_flags" in df.columns else df.withColumn("quality_flags", F.array().cast("array<string>"))
    return _intervals(df, "media_segment", "media", F.lit("media.segment"), F.to_json(F.struct("sha256", "size_bytes")), uncertain_after_ns)


def build_timeline(events: DataFrame, heartbeats: DataFrame, media: DataFrame, uncertain_after_ns: int = NS) -> DataFrame:
    """All entries of the three sources (unordered; ``ordered`` sorts)."""
    return project_events(events, uncertain_after_ns).unionByName(project_heartbeats(heartbeats, uncertain_after_ns)).unionByName(project_media(media, uncertain_after_ns))


def ordered(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy(*ORDER)


def page(df: DataFrame, keys: tuple[str, ...], after: tuple | None, limit: int, snapshot: tuple[str, int] | None = None) -> DataFrame:
    """The next ``limit`` + 1 rows after a key (the last tells that there is more), none newer than the snapshot id."""
    if snapshot is not None:
        df = df.where(F.col(snapshot[0]) <= snapshot[1])
    if after is not None:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        df = df.where(F.struct(*keys) > F.struct(*(F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, after, strict=True))))
    return df.orderBy(*keys).limit(limit + 1)


def guarded(df: DataFrame, most: int) -> DataFrame:
    """df, unless it has more than ``most`` rows: then ValueError, as a result is never cut short."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} facts in range")
    return df


def key_family(df: DataFrame, base: str, most: int = 1024) -> DataFrame:
    """Rows of a base idempotency key and of its duration revisions; ValueError if there are over ``most``."""
    return guarded(df.where((F.col("idempotency_key") == base) | F.col("idempotency_key").startswith(f"{base}:duration:")), most)


def base_key(key: Column) -> Column:
    return F.regexp_replace(key, ":duration:[^:]*$", "")


def coverage_facts(timeline: DataFrame) -> DataFrame:
    """Positive intervals of entries as coverage facts: availability, reason, priority; other entries cover nothing."""
    kind = F.col("source_type")
    timeline = timeline.where((F.col("end_ns") > F.col("start_ns")) & ((kind != "raw_event") | (F.col("event_type") == ACTIVITY))).withColumn("_v", F.try_parse_json("payload"))
    v = F.col("_v")
    texts = F.struct(json_text(v, "$.data.status").alias("s"), json_text(v, "$.bucket_type").alias("t"), json_text(v, "$.state").alias("h"))
    timeline = timeline.withColumn("_t", texts)
    t = F.col("_t")
    afk = F.coalesce((kind == "raw_event") & (t["s"] == "afk") & t["t"].isin("afkstatus", "currentafkstatus"), F.lit(False))
    idle = F.coalesce((kind == "heartbeat") & (t["h"] == "idle"), F.lit(False))
    reason = F.when(afk, "ACTIVITYWATCH_AFK").when(idle, "HEARTBEAT_IDLE").when(kind == "heartbeat", "HEARTBEAT_ACTIVE").when(kind == "media_segment", "MEDIA_ACCEPTED").otherwise("ACTIVITYWATCH_EVENT")
    priority = F.when(afk, 40).when(kind == "raw_event", 20).otherwise(30)
    return timeline.select("collector_id", "start_ns", "end_ns", F.when(afk | idle, "confirmed_idle").otherwise("covered").alias("availability"), "quality_flags", reason.alias("reason_code"), priority.alias("priority"), "stable_id")


def changed(new: DataFrame, old: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of new that are not in old with the same values in all columns: what an upsert has to write."""
    values = [c for c in new.columns if c not in keys]
    mark = lambda df: F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)
    o = old.select(*keys, mark(old).alias("_old"))
    return new.withColumn("_new", mark(new)).join(o, list(keys), "left").where(~F.col("_new").eqNullSafe(F.col("_old"))).drop("_new", "_old")


def upserted(new: DataFrame, old: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old with new's rows put in by key: the next generation."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def liveness_changes(heartbeats: DataFrame, collectors: DataFrame, until_ns: int) -> DataFrame:
    """(collector_id, at_ns, state): when a collector went missing, delayed and offline for want of a next heartbeat.

    The event-time form of the streaming timers: after each heartbeat (collector_id, start_ns, end_ns), the
    deadlines that pass before the next one starts, or before until_ns after the last.  The next one is found
    within the day, or is the first of the next day that has any.
    """
    day = 86400 * NS
    hb = heartbeats.select("collector_id", "start_ns", "end_ns", bucket(F.col("end_ns"), day).alias("_day"))
    order = W.partitionBy("collector_id", "_day").orderBy("end_ns", "start_ns")
    first = hb.groupBy("collector_id", "_day").agg(F.min(F.struct("end_ns", "start_ns"))["start_ns"].alias("_first"))
    first = first.withColumn("_later", F.lead("_first").over(W.partitionBy("collector_id").orderBy("_day"))).drop("_first")
    hb = hb.withColumn("_next", F.lead("start_ns").over(order)).join(first, ["collector_id", "_day"]).withColumn("_next", F.coalesce("_next", "_later", F.lit(until_ns)))
    hb = hb.join(collectors, "collector_id")
    period, end = F.col("heartbeat_period_ns"), F.col("end_ns")
    marks = F.array(*(F.struct((end + wait).alias("at_ns"), F.lit(state).alias("state")) for wait, state in ((period, "missing"), (period + F.col("allowed_lateness_ns"), "delayed"), (F.col("offline_after_ns"), "offline"))))
    return hb.select("collector_id", "_next", F.explode(marks).alias("m")).where(F.col("m.at_ns") < F.col("_next")).select("collector_id", "m.at_ns", "m.state")
