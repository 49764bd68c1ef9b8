"""State from transition logs: latest rows, changes, edges, levels and bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scan


def latest(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The row of each key with the largest ``order``: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return out.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def incremental(current: DataFrame, new: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The latest rows after new events: the greater ``order`` stays, so that replay changes nothing."""
    return latest(current.unionByName(new), keys, order)


def change_points(df: DataFrame, keys: tuple[str, ...], order: str, state: tuple[str, ...]) -> DataFrame:
    """Rows that differ in ``state`` from the one before with the same keys."""
    w = W.partitionBy(*keys).orderBy(order)
    now = F.struct(*state)
    return df.withColumn("_before", F.lag(now).over(w)).where(F.col("_before").isNull() | (F.col("_before") != now)).drop("_before")


def ingest_changes(df: DataFrame, key: str, order: str, state: tuple[str, ...], status: str = "status") -> DataFrame:
    """Change points of an ingest log; ``discovered`` counts only as a key's first row."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    kept = df.withColumn("_n", n).where((F.col("_n") == 1) | (F.col(status) != "discovered")).drop("_n")
    return change_points(kept, (key,), order, state)


def chained_key(df: DataFrame, key: str, order: str, id_: str = "id") -> DataFrame:
    """df with event_key: SHA-256 of the key, NUL and the predecessor's id (0 for none)."""
    before = F.coalesce(F.lag(id_).over(W.partitionBy(key).orderBy(order)), F.lit(0))
    return df.withColumn("event_key", F.sha2(F.concat(F.col(key).cast("string"), F.lit("\0"), before.cast("string")), 256))


def mode_transitions(df: DataFrame, keys: tuple[str, ...], order: str, mode: str = "mode", width: int = scan.IDS) -> DataFrame:
    """Rows whose mode differs from the one before (unknown at first), with old_mode; a key's log goes in pieces of ``width`` of its order."""
    df = scan.with_previous(df, keys, (order,), {"old_mode": F.col(mode)}, width)
    return df.withColumn("old_mode", F.coalesce("old_mode", F.lit("unknown"))).where(F.col(mode) != F.col("old_mode"))


def fault_edges(df: DataFrame, keys: tuple[str, ...], order: str, down: Column, code: str, width: int = scan.IDS) -> DataFrame:
    """Rows on which a fault begins or changes its code (degraded) or ends (recovered), as ``edge``."""
    df = scan.with_previous(df.withColumn("_down", down), keys, (order,), {"_was": F.col("_down"), "_old": F.col(code)}, width)
    was = F.coalesce("_was", F.lit(False))
    edge = F.when(F.col("_down") & (~was | ~F.col("_old").eqNullSafe(F.col(code))), "degraded").when(~F.col("_down") & was, "recovered")
    return df.withColumn("edge", edge).where(F.col("edge").isNotNull()).drop("_down", "_was", "_old")


def disk_level(free: Column, warning: float, critical: float, reserve: float) -> Column:
    return F.when(free <= reserve, "reserve").when(free <= critical, "critical").when(free <= warning, "warning").otherwise("normal")


def level_changes(df: DataFrame, keys: tuple[str, ...], order: str, level: str = "level", width: int = scan.IDS) -> DataFrame:
    """Rows whose level differs from the one before (normal at first), with severity."""
    df = scan.with_previous(df, keys, (order,), {"old_level": F.col(level)}, width).withColumn("old_level", F.coalesce("old_level", F.lit("normal")))
    severity = F.when(F.col(level) == "normal", "info").when(F.col(level) == "warning", "warning").otherwise("critical")
    return df.where(F.col(level) != F.col("old_level")).withColumn("severity", severity)


def bursts(df: DataFrame, keys: tuple[str, ...], seconds: str, window_s: int = 600, n: int = 5) -> DataFrame:
    """Rows with at least n rows of the same keys in the window_s seconds up to them, with that number as ``recent``."""
    return scan.windowed_count(df, keys, seconds, window_s, "recent", max(86400, window_s)).where(F.col("recent") >= n)


def top_recent(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The n newest rows, without details."""
    return df.orderBy(F.desc(order)).limit(n).drop("detail")


def ingest_summary(current: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: keys by status, backlog, segments, and the error code of the last event that has one."""
    kinds = ("discovered", "pending", "validated", "accepted", "quarantined", "failed")
    counts = [F.count_if(F.col("status") == k).alias(k) for k in kinds]
    backlog = F.count_if(F.col("status").isin("discovered", "pending", "validated")).alias("backlog")
    last = F.max_by("error_code", F.when(F.col("error_code").isNotNull(), F.col("id"))).alias("last_error_code")
    one = current.agg(*counts, backlog, last)
    return one.crossJoin(segments.agg(F.count("*").alias("segments")))  # a row with a row
