"""Reconciliation of manifests and retention planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .statelog import latest


def three_way(db: DataFrame, manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, in_db, in_manifest, in_metadata, verdict) of the paths of three frames (path, sha256, size_bytes).

    verdict: ok, missing (from the manifest), extra (in a manifest only) or mismatch (sha or size differ).
    """
    side = lambda df, p: df.select("path", F.struct("sha256", "size_bytes").alias(p))
    all_ = side(db, "d").join(side(manifest, "m"), "path", "full_outer").join(side(metadata, "x"), "path", "full_outer")
    d, m, x = F.col("d"), F.col("m"), F.col("x")
    verdict = F.when(d.isNull(), "extra").when(m.isNull() | x.isNull(), "missing").when((d != m) | (d != x), "mismatch").otherwise("ok")
    return all_.select("path", d.isNotNull().alias("in_db"), m.isNotNull().alias("in_manifest"), x.isNotNull().alias("in_metadata"), verdict.alias("verdict"))


def with_status(segments: DataFrame, status: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Segments whose current status is allowed."""
    return segments.join(status.select("media_segment_id", "status"), "media_segment_id").where(F.col("status").isin(*allowed))


def backed_up(candidates: DataFrame, backup: DataFrame) -> DataFrame:
    """Candidates that a verified backup holds: path, sha256 and size agree."""
    return candidates.join(backup.select("path", "sha256", "size_bytes").distinct(), ["path", "sha256", "size_bytes"], "left_semi")


def oldest(df: DataFrame, cutoff_ns: int, k: int) -> DataFrame:
    return df.where(F.col("created_ns") < cutoff_ns).orderBy("created_ns", "media_segment_id").limit(k)


def retention_plan(segments: DataFrame, status: DataFrame, backup: DataFrame, level: str, cutoff_ns: int, k: int) -> DataFrame:
    """Segments to remove: none while storage is normal; accepted or restored, old enough, in a verified full backup, oldest first."""
    if level == "normal":
        return with_status(segments, status, ("accepted", "restored")).limit(0)
    return oldest(backed_up(with_status(segments, status, ("accepted", "restored")), backup), cutoff_ns, k)


def retention_fold(events: DataFrame, files: DataFrame) -> DataFrame:
    """(media_segment_id, path, status): the latest retention event; planned with no file left becomes deleted."""
    now = latest(events, ("media_segment_id", "path"), "id").join(files.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    return now.select("media_segment_id", "path", F.when((F.col("status") == "planned") & F.col("_there").isNull(), "deleted").otherwise(F.col("status")).alias("status"))


def orphans(staging: DataFrame, ingest: DataFrame, live: tuple[str, ...], cutoff_ns: int) -> DataFrame:
    """Staging files older than the cutoff that no live latest ingest event refers to."""
    used = latest(ingest, ("ingest_key",), "id").where(F.col("status").isin(*live)).select("path").where("path is not null").distinct()
    return staging.join(used, "path", "left_anti").where(F.col("modified_ns") < cutoff_ns)


def manifest_errors(files: DataFrame) -> DataFrame:
    """(manifest_id, path, error) of manifest entries (manifest_id, path, kind, included, size_bytes, sha256) that break a rule.

    kind is database, config or media; hex digests; relative paths without ..; no path twice (case aside);
    one database and one config entry.
    """
    rule = (
        F.when(~F.col("kind").isin("database", "config", "media"), "kind")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256")
        .when(F.col("path").isNull() | F.col("path").rlike(r"^/|\\|(^|/)\.\.(/|$)|^[A-Za-z]:"), "path")
        .when(F.coalesce(F.col("size_bytes") < 0, F.lit(True)), "size")
    )
    own = files.withColumn("error", rule).where("error is not null").select("manifest_id", "path", "error")
    twice = files.groupBy("manifest_id", F.lower("path").alias("path")).agg(F.count("*").alias("n")).where("n > 1").select("manifest_id", "path", F.lit("duplicate").alias("error"))
    kinds = files.groupBy("manifest_id").agg(F.count_if(F.col("kind") == "database").alias("d"), F.count_if(F.col("kind") == "config").alias("c"))
    one = kinds.where("d <> 1 or c <> 1").select("manifest_id", F.lit(None).cast("string").alias("path"), F.lit("entries").alias("error"))
    return own.unionByName(twice).unionByName(one)


def media_sample(files: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k included files of each group by digest: the same sample every time."""
    w = W.partitionBy(*by).orderBy("sha256", "path")
    return files.where("included").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
