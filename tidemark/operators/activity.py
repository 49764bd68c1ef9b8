"""Import of paged activity exports: merging pages, stable prefixes, revisions and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import activity_base_key


def merge_pages(pages: DataFrame) -> DataFrame:
    """(bucket_id, id, timestamp, data, duration, error): one row an event; the longest duration wins.

    Pages that disagree on timestamp or data of an event give an error row, never a silent choice.
    """
    out = pages.groupBy("bucket_id", "id").agg(F.max("duration").alias("duration"), F.min("timestamp").alias("timestamp"), F.max("timestamp").alias("_t"), F.min("data").alias("data"), F.max("data").alias("_d"))
    error = F.when((F.col("timestamp") != F.col("_t")) | (F.col("data") != F.col("_d")), "ACTIVITY_PAGES_CONFLICT")
    return out.withColumn("error", error).drop("_t", "_d")


def stable_prefix(df: DataFrame, by: str, order: tuple[str, ...], end_ns: str, cutoff_ns: int | Column) -> DataFrame:
    """Rows before the first one, in order, whose end reaches the cutoff: what can still grow is left for later.

    That first row is an aggregate, so no log is sorted.
    """
    first = df.where(F.col(end_ns) >= cutoff_ns).groupBy(F.col(by).alias("_by")).agg(F.min(F.struct(*order)).alias("_first"))
    out = df.join(first, F.col(by).eqNullSafe(F.col("_by")), "left")
    return out.where(F.col("_first").isNull() | (F.struct(*order) < F.col("_first"))).drop("_by", "_first")


def rescanned(df: DataFrame, start: Column) -> DataFrame:
    """Rows from the rescan's start on; a copy clipped by the boundary begins before it and is ignored."""
    return df.where(F.col("timestamp_ns") >= start)


def revisions(df: DataFrame, keys: tuple[str, ...] = ("bucket_id", "id"), order: str = "seq") -> DataFrame:
    """df (keys, order, content, duration) with ``status`` and ``idempotency_key``.

    A key's first row is its base; the same duration again is a duplicate; a longer one is a revision with
    a key of its own; a shorter one or other content is an error.  The suffix is the shortest decimal text
    of the duration.
    """
    w = W.partitionBy(*keys).orderBy(order)
    first = F.first("content").over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_same", F.col("content").eqNullSafe(first))
    longest = F.max(F.when(F.col("_same"), F.col("duration"))).over(w.rowsBetween(W.unboundedPreceding, -1))  # what errors say is not stored
    status = F.when(longest.isNull(), "base").when(~F.col("_same"), "error").when(F.col("duration") > longest, "revision").when(F.col("duration") == longest, "duplicate").otherwise("error")
    base = activity_base_key(F.col(keys[0]), F.col(keys[1]))
    key = F.when(F.col("status") == "base", base).when(F.col("status") == "revision", F.concat(base, F.lit(":duration:"), F.col("duration").cast("string")))
    return df.withColumn("status", status).withColumn("idempotency_key", key).drop("_same")


def advance_checkpoint(old: DataFrame, new: DataFrame) -> DataFrame:
    """(collector_id, bucket_id, source_time_ns, source_event_id, error): the greater position of each collector.

    A collector that changes its bucket keeps the old position and gets an error.
    """
    at = F.max(F.struct("source_time_ns", "source_event_id")).alias("p")
    n = new.groupBy("collector_id").agg(F.max("bucket_id").alias("nb"), F.min("bucket_id").alias("nb2"), at)
    o = old.select("collector_id", F.col("bucket_id").alias("ob"), F.struct("source_time_ns", "source_event_id").alias("o"))
    both = o.join(n, "collector_id", "full_outer")
    moved = (F.col("nb") != F.col("nb2")) | (F.col("ob").isNotNull() & F.col("nb").isNotNull() & (F.col("ob") != F.col("nb")))
    moved = F.coalesce(moved, F.lit(False))
    at = F.when(moved & F.col("o").isNotNull(), F.col("o")).otherwise(F.greatest(F.coalesce("o", "p"), F.coalesce("p", "o")))
    return both.select("collector_id", F.coalesce("ob", "nb").alias("bucket_id"), at["source_time_ns"].alias("source_time_ns"), at["source_event_id"].alias("source_event_id"), F.when(moved, "ACTIVITY_BUCKET_CHANGED").alias("error"))


def poll_heartbeat(polls: DataFrame) -> DataFrame:
    """polls (collector_id, start_ns, end_ns, period_ns) with an active interval: one nanosecond at least, a period at most."""
    end = F.least(F.greatest("end_ns", F.col("start_ns") + 1), F.col("start_ns") + F.col("period_ns"))
    return polls.select("collector_id", "start_ns", end.alias("end_ns"), F.lit("active").alias("state"))


def source_errors(rows: DataFrame, error: Column) -> DataFrame:
    """(collector_id, rows, failed, status): a source with a bad row is degraded, the others go on."""
    out = rows.groupBy("collector_id").agg(F.count("*").alias("rows"), F.count_if(error).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "degraded").otherwise("healthy"))
