"""Media ingest: pairing files, the decision table, claims, confirmation and backlog."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def paired(ready: DataFrame, sidecars: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each ready marker with its sidecar (all columns prefixed s_) and body (b_), where there are any."""
    s = sidecars.select(*(F.col(c).alias(c if c == "name" else f"s_{c}") for c in sidecars.columns))
    b = bodies.select(*(F.col(c).alias(c if c == "name" else f"b_{c}") for c in bodies.columns))
    return ready.join(s, "name", "left").join(b, "name", "left")


def decide(pairs: DataFrame, probes: DataFrame, later: DataFrame, max_bytes: int, max_duration_ms: int) -> DataFrame:
    """pairs with ``status`` and ``error_code``: pending, failed, quarantined or validated, by the first rule that fits.

    pairs: as from paired, sidecars validated (s_status, s_error_code, s_size_bytes, s_sha256, s_media_type),
    bodies with size_bytes, modified_ns, sha256; later: a second listing (name, size_bytes, modified_ns);
    probes: name, duration_ms, media_type, probe_error.
    """
    later = later.select("name", F.col("size_bytes").alias("l_size"), F.col("modified_ns").alias("l_mod"))
    p = probes.select("name", F.col("duration_ms").alias("p_ms"), F.col("media_type").alias("p_type"), F.col("probe_error").alias("p_error"))
    df = pairs.join(later, "name", "left").join(p, "name", "left")
    size = F.col("b_size_bytes")
    rules = (
        (F.col("s_raw").isNull(), "pending", "MEDIA_SIDECAR_MISSING"),
        (F.col("s_status") == "pending", "pending", "MEDIA_SIDECAR_INCOMPLETE"),
        (F.col("s_status") == "quarantined", "quarantined", None),
        (size.isNull(), "pending", "MEDIA_SOURCE_MISSING"),
        ((size > max_bytes) | (F.col("s_size_bytes") > max_bytes), "failed", "MEDIA_TOO_LARGE"),
        (F.col("l_size").isNull(), "pending", "MEDIA_SOURCE_MISSING"),
        ((F.col("l_size") != size) | (F.col("l_mod") != F.col("b_modified_ns")), "pending", "MEDIA_FILE_GROWING"),
        (F.col("l_size") != F.col("s_size_bytes"), "quarantined", "MEDIA_SIZE_MISMATCH"),
        (F.col("b_sha256") != F.col("s_sha256"), "quarantined", "MEDIA_HASH_MISMATCH"),
        (F.col("p_error").isNotNull(), "quarantined", "MEDIA_FFPROBE_FAILED"),
        (F.col("p_type") != F.col("s_media_type"), "quarantined", "MEDIA_TYPE_INVALID"),
        (F.col("p_ms") > max_duration_ms, "quarantined", "MEDIA_DURATION_INVALID"),
    )
    state = F.coalesce(*(F.when(rule, F.struct(F.lit(s).alias("status"), (F.col("s_error_code") if c is None else F.lit(c)).alias("error_code"))) for rule, s, c in rules), F.struct(F.lit("validated").alias("status"), F.lit(None).cast("string").alias("error_code")))
    return df.withColumn("_d", state).withColumns({"status": F.col("_d.status"), "error_code": F.col("_d.error_code")}).drop("_d", "l_size", "l_mod", "p_ms", "p_type", "p_error")


def grown(first: DataFrame, second: DataFrame) -> DataFrame:
    """(name, state) of each file of the first listing: stable, growing or missing in the second."""
    b = second.select("name", F.col("size_bytes").alias("_s"), F.col("modified_ns").alias("_m"))
    state = F.when(F.col("_s").isNull(), "missing").when((F.col("_s") != F.col("size_bytes")) | (F.col("_m") != F.col("modified_ns")), "growing").otherwise("stable")
    return first.join(b, "name", "left").select("name", state.alias("state"))


def unchanged_skipped(items: DataFrame, memo: DataFrame) -> DataFrame:
    """Items whose last verified signature is not the same already."""
    return items.join(memo.select("ingest_key", "kind", "signature"), ["ingest_key", "kind", "signature"], "left_anti")


def verified(bodies: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, size_ok, hash_ok) of bodies (name, content binary) against declared (name, size_bytes, sha256)."""
    b = bodies.select("name", F.octet_length("content").cast("long").alias("_n"), F.sha2("content", 256).alias("_h"))
    return declared.join(b, "name", "left").select("name", F.coalesce(F.col("_n") == F.col("size_bytes"), F.lit(False)).alias("size_ok"), F.coalesce(F.col("_h") == F.col("sha256"), F.lit(False)).alias("hash_ok"))


def hashed_files(files: DataFrame, chunk: int = 1 << 22) -> DataFrame:
    """(path, size_bytes, sha256, error) of files (path), however long: each is read in pieces of ``chunk`` bytes with a running hash.

    Paths are those that Spark lists, opened by pyarrow's file systems; a file that can't be read has an error instead.
    Rows go to as many tasks as the session's shuffle has, as one of them may be much work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                total, digest, error = 0, hashlib.sha256(), None
                try:
                    local = re.match(r"file:/*|/", path)  # Spark's paths are not quoted, URIs have to be
                    system, at = (fs.LocalFileSystem(), "/" + path[local.end() :].lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe="/:@"))
                    with system.open_input_file(at) as body:
                        while piece := body.read(chunk):
                            digest.update(piece)
                            total += len(piece)
                except (OSError, pa.ArrowInvalid) as e:
                    error = type(e).__name__
                values = [path], [None if error else total], [None if error else digest.hexdigest()], [error]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "size_bytes", "sha256", "error"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.where("path is not null").select("path").distinct().repartition(parts, "path").mapInArrow(run, "path string, size_bytes long, sha256 string, error string")


def verified_files(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, size_ok, hash_ok) of files (name, path) against declared (name, size_bytes, sha256), bodies of any size."""
    found = files.join(hashed_files(files), "path").select("name", F.col("size_bytes").alias("_n"), F.col("sha256").alias("_h"))
    return declared.join(found, "name", "left").select("name", F.coalesce(F.col("_n") == F.col("size_bytes"), F.lit(False)).alias("size_ok"), F.coalesce(F.col("_h") == F.col("sha256"), F.lit(False)).alias("hash_ok"))


def claims_by_source(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """The claim with the least id of each (collector_id, source_key): direct ones and aliases seen in ingest events."""
    cols = ["collector_id", "source_key", "id", "sha256", "metadata_hash"]
    direct = segments.select(cols)
    more = aliases.join(segments.select("id", "sha256", "metadata_hash"), "id").select(cols)
    return direct.unionByName(more).groupBy("collector_id", "source_key").agg(F.min_by(F.struct("id", "sha256", "metadata_hash"), "id").alias("by_source"))


def resolve_claims(candidates: DataFrame, segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """candidates (collector_id, source_key, sha256, metadata_hash) with claim_id and claim: new, duplicate or conflict.

    A claim by source goes before one by content; the same content and metadata is a duplicate.
    """
    by_sha = segments.groupBy("sha256").agg(F.min_by(F.struct("id", "sha256", "metadata_hash"), "id").alias("by_sha"))
    df = candidates.join(claims_by_source(segments, aliases), ["collector_id", "source_key"], "left").join(by_sha, "sha256", "left")
    found = F.coalesce("by_source", "by_sha")
    same = (found["sha256"] == F.col("sha256")) & (found["metadata_hash"] == F.col("metadata_hash"))
    return df.withColumns({"claim_id": found["id"], "claim": F.when(found.isNull(), "new").when(same, "duplicate").otherwise("conflict")}).drop("by_source", "by_sha")


def accepted(candidates: DataFrame, first_id: int, order: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three append frames of new claims: segments, first states, ingest events; one segment for each content and source.

    Ids follow ``order`` within the sources' hash ranges: unique, not dense.
    """
    new = candidates.where("claim = 'new'")
    one = new.withColumn("_a", F.row_number().over(W.partitionBy("collector_id", "source_key").orderBy(order))).where("_a = 1")
    one = one.withColumn("_b", F.row_number().over(W.partitionBy("sha256").orderBy(order))).where("_b = 1").drop("_a", "_b")
    segments = one.withColumn("id", F.lit(first_id) + F.pmod(F.xxhash64("collector_id", "source_key"), F.lit(1 << 62)))
    states = segments.select(F.sha2(F.concat(F.lit("state\0"), F.col("id").cast("string")), 256).alias("event_key"), F.col("id").alias("media_segment_id"), F.lit("accepted").alias("status"))
    events = segments.select(F.sha2(F.concat(F.lit("ingest\0"), F.col("id").cast("string")), 256).alias("event_key"), F.col("id").alias("media_segment_id"), "source_key", F.lit("accepted").alias("status"))
    return segments, states, events


def confirmed(ready: DataFrame, confirmations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ready files whose confirmation agrees in all ``keys``."""
    return ready.join(confirmations.select(*keys).distinct(), list(keys), "left_semi")


def backlog(ready: DataFrame, valid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(files, bytes) of ready files without a valid confirmation; bytes stop at the largest 64-bit number."""
    rest = ready.join(valid.select(*keys).distinct(), list(keys), "left_anti")
    total = F.least(F.coalesce(F.sum(F.col("size_bytes").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.lit(9223372036854775807).cast("decimal(38,0)"))
    return rest.agg(F.count("*").alias("files"), total.cast("long").alias("bytes"))


def fair_scan(df: DataFrame, key: str, cursor: str, n: int) -> DataFrame:
    """The n smallest keys after the cursor, then from the beginning."""
    return df.orderBy((F.col(key) <= cursor).cast("int"), key).limit(n)


def metadata_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i:02d}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)
