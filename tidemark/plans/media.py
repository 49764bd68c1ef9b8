"""Queries of media ingest, reconciliation and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import media, reconcile, statelog
from ..sources import readers
from ..sources.paths import work_dir
from ..streaming import jobs
from .adapters import T0, frame, sql
from .state import LATEST

C = F.col


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").withColumn("name", F.concat(F.lit("n"), C("doc_id").cast("string")))


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ready markers, validated sidecars and bodies; some partners are missing, some disagree."""
    docs = _docs(s, d)
    k = C("doc_id") % 13
    ready = docs.select("name", "doc_id")
    side = docs.where(k != 1).select("name", F.lit("{}").alias("raw"), F.when(k == 2, "pending").when(k == 3, "quarantined").alias("status"), F.when(k == 2, "MEDIA_SIDECAR_INCOMPLETE").when(k == 3, "MEDIA_TIME_INVALID").alias("error_code"), F.when(k == 4, C("n_chars") + 1).otherwise(C("n_chars")).alias("size_bytes"), F.when(k == 5, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), F.lit("video").alias("media_type"))
    body = docs.where(k != 6).select("name", C("n_chars").alias("size_bytes"), C("doc_id").alias("modified_ns"), F.sha2("text", 256).alias("sha256"))
    return ready, side, body


def _m1(s: SparkSession, d: str) -> DataFrame:
    ready, side, body = _parts(s, d)
    k = C("doc_id") % 13
    later = _docs(s, d).where(k != 7).select("name", C("n_chars").alias("size_bytes"), F.when(k == 8, C("doc_id") + 1).otherwise(C("doc_id")).alias("modified_ns"))
    probe = _docs(s, d).select("name", F.when(k == 9, 700000).otherwise(1000).alias("duration_ms"), F.when(k == 10, "audio").otherwise("video").alias("media_type"), F.when(k == 11, "broken").alias("probe_error"))
    return media.decide(media.paired(ready, side, body), probe, later, 15000, 600000).select("doc_id", "status", "error_code")


M1 = """SELECT doc_id, CASE WHEN k IN (1, 2) OR k = 6 THEN 'pending' WHEN k = 3 THEN 'quarantined' WHEN big THEN 'failed' WHEN k IN (7, 8) THEN 'pending' WHEN k IN (4, 5, 9, 10, 11) THEN 'quarantined' ELSE 'validated' END AS status,
  CASE WHEN k = 1 THEN 'MEDIA_SIDECAR_MISSING' WHEN k = 2 THEN 'MEDIA_SIDECAR_INCOMPLETE' WHEN k = 3 THEN 'MEDIA_TIME_INVALID' WHEN k = 6 THEN 'MEDIA_SOURCE_MISSING' WHEN big THEN 'MEDIA_TOO_LARGE' WHEN k = 7 THEN 'MEDIA_SOURCE_MISSING' WHEN k = 8 THEN 'MEDIA_FILE_GROWING'
    WHEN k = 4 THEN 'MEDIA_SIZE_MISMATCH' WHEN k = 5 THEN 'MEDIA_HASH_MISMATCH' WHEN k = 11 THEN 'MEDIA_FFPROBE_FAILED' WHEN k = 10 THEN 'MEDIA_TYPE_INVALID' WHEN k = 9 THEN 'MEDIA_DURATION_INVALID' END AS error_code
  FROM (SELECT doc_id, doc_id % 13 AS k, n_chars > 15000 OR (doc_id % 13 = 4 AND n_chars + 1 > 15000) AS big FROM documents) AS x"""


def _claims(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = frame(s, d, "media")
    segments = m.where("id % 2 = 0").select("id", "collector_id", "source_key", "sha256", "metadata_hash")
    aliases = m.where("id % 6 = 0").select("id", "collector_id", F.concat(F.lit("a"), C("id").cast("string")).alias("source_key"))
    new = m.select(C("id").alias("cid"), "collector_id", F.when(C("id") % 12 == 0, F.concat(F.lit("a"), C("id").cast("string"))).otherwise(C("source_key")).alias("source_key"), F.when(C("id") % 10 == 4, F.sha2(F.lit("other"), 256)).otherwise(C("sha256")).alias("sha256"), "metadata_hash")
    return new, segments, aliases


J3 = """WITH seg AS (SELECT * FROM media WHERE id % 2 = 0), src AS (SELECT collector_id, source_key, id, sha256, metadata_hash FROM seg UNION ALL SELECT collector_id, 'a' || CAST(id AS STRING), id, sha256, metadata_hash FROM seg WHERE id % 6 = 0),
bs AS (SELECT collector_id, source_key, min(id) AS id FROM src GROUP BY 1, 2), bh AS (SELECT sha256, min(id) AS id FROM seg GROUP BY 1),
nw AS (SELECT id AS cid, collector_id, CASE WHEN id % 12 = 0 THEN 'a' || CAST(id AS STRING) ELSE source_key END AS source_key, CASE WHEN id % 10 = 4 THEN sha('other') ELSE sha256 END AS h, metadata_hash FROM media),
re AS (SELECT nw.*, coalesce(bs.id, bh.id) AS claim_id FROM nw LEFT JOIN bs ON nw.collector_id = bs.collector_id AND nw.source_key = bs.source_key LEFT JOIN bh ON nw.h = bh.sha256),
cl AS (SELECT re.cid, re.claim_id, re.collector_id, re.source_key, re.h, CASE WHEN claim_id IS NULL THEN 'new' WHEN seg.sha256 = re.h AND seg.metadata_hash = re.metadata_hash THEN 'duplicate' ELSE 'conflict' END AS claim FROM re LEFT JOIN seg ON re.claim_id = seg.id)
"""


def _m3(s: SparkSession, d: str) -> DataFrame:
    new = media.resolve_claims(*_claims(s, d))
    segments, states, events = media.accepted(new, 0, C("cid"))
    return segments.agg(F.count("*").alias("segments"), F.sum("cid").alias("cids"), F.count_distinct("id").alias("ids")).crossJoin(states.agg(F.count_distinct("event_key").alias("states"))).crossJoin(events.agg(F.count_distinct("event_key").alias("events")))


def _status(s: SparkSession, d: str) -> DataFrame:
    return statelog.latest(frame(s, d, "slog"), ("media_segment_id",), "id")


def _backup(s: SparkSession, d: str) -> DataFrame:
    m = frame(s, d, "media").where("id % 4 <> 1")
    return m.select("path", F.when(C("id") % 7 == 2, "bad").otherwise(C("sha256")).alias("sha256"), "size_bytes")


def _j6(s: SparkSession, d: str) -> DataFrame:
    m = frame(s, d, "media").select("id", "path", "sha256", "size_bytes")
    manifest = m.where("id % 5 <> 1").select("path", F.when(C("id") % 7 == 2, "bad").otherwise(C("sha256")).alias("sha256"), "size_bytes")
    meta = m.where("id % 11 <> 3").select("path", "sha256", (C("size_bytes") + (C("id") % 13 == 4).cast("long")).alias("size_bytes"))
    return reconcile.three_way(m.where("id % 6 <> 5"), manifest, meta)


J6 = """WITH a AS (SELECT id, path, id % 6 <> 5 AS i, id % 5 <> 1 AS j, id % 11 <> 3 AS k, id % 7 = 2 AS bj, id % 13 = 4 AS bk FROM media)
SELECT path, i AS in_db, j AS in_manifest, k AS in_metadata, CASE WHEN NOT i THEN 'extra' WHEN NOT j OR NOT k THEN 'missing' WHEN bj OR bk THEN 'mismatch' ELSE 'ok' END AS verdict FROM a WHERE i OR j OR k"""


def _r3(s: SparkSession, d: str) -> DataFrame:
    k = C("doc_id") % 17
    files = _docs(s, d).select(F.floor(C("doc_id") / 40).alias("manifest_id"), F.when(k == 1, "../x").when(k == 2, "/abs").when(k == 3, F.lower(F.concat(F.lit("F"), F.floor(C("doc_id") / 40).cast("string")))).otherwise(F.concat(F.lit("f/"), "name")).alias("path"), F.when(k == 4, "other").when(C("doc_id") % 40 == 0, "database").when(C("doc_id") % 40 == 6, "config").otherwise("media").alias("kind"), F.lit(True).alias("included"), C("n_chars").alias("size_bytes"), F.when(k == 5, "XYZ").otherwise(F.sha2("text", 256)).alias("sha256"))
    return reconcile.manifest_errors(files)


R3 = """WITH f AS (SELECT CAST(floor(doc_id / 40) AS BIGINT) AS manifest_id, doc_id % 17 AS k, CASE doc_id % 17 WHEN 1 THEN '../x' WHEN 2 THEN '/abs' WHEN 3 THEN 'f' || CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING) ELSE 'f/n' || CAST(doc_id AS STRING) END AS path,
  CASE WHEN doc_id % 17 = 4 THEN 'other' WHEN doc_id % 40 = 0 THEN 'database' WHEN doc_id % 40 = 6 THEN 'config' ELSE 'media' END AS kind FROM documents)
SELECT manifest_id, path, CASE WHEN kind = 'other' THEN 'kind' WHEN k = 5 THEN 'sha256' ELSE 'path' END AS error FROM f WHERE kind = 'other' OR k IN (1, 2, 5)
UNION ALL SELECT manifest_id, lower(path), 'duplicate' FROM f GROUP BY manifest_id, lower(path) HAVING count(*) > 1
UNION ALL SELECT manifest_id, NULL, 'entries' FROM f GROUP BY manifest_id HAVING count(*) FILTER (WHERE kind = 'database') <> 1 OR count(*) FILTER (WHERE kind = 'config') <> 1"""


def _s4(s: SparkSession, d: str) -> DataFrame:
    """Document texts landed as bodies, sidecars and markers in archives, listed and paired."""
    root = work_dir(s, "inbox")
    suffix = F.when(C("doc_id") % 3 == 0, "").when(C("doc_id") % 3 == 1, ".sidecar.json").otherwise(".ready")
    landed = _docs(s, d).select(F.concat(F.floor(C("doc_id") / 3).cast("string"), suffix).alias("file"), C("doc_id").alias("modified_ns"), F.encode("text", "UTF-8").alias("content"))
    landed.where(F.octet_length("content") > 0).write.parquet(root)
    count = lambda part: F.count_if(C("part") == part).alias(part)
    return readers.drop_archives(s, root).groupBy("name").agg(count("media"), count("sidecar"), count("ready"))


def _l5(s: SparkSession, d: str) -> DataFrame:
    """Four turns of a stream over all media, two fifths of the keys in each: the fourth has gone round once and goes on."""
    rows = frame(s, d, "media")
    ticks, out = work_dir(s, "ticks"), work_dir(s, "scans")
    for i in range(4):
        s.range(i, i + 1).coalesce(1).write.mode("append").parquet(ticks)
    stream = s.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(ticks)
    n = -(-2 * rows.count() // 5)
    jobs.fair_scans(stream, lambda: frame(s, d, "media").select("source_key"), "source_key", n, out, f"{out}/checkpoint").awaitTermination()
    return s.read.schema("source_key string, batch long").parquet(f"{out}/picked")


def _s5(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    path = work_dir(s, "manifests")
    file = F.struct(C("name").alias("relative_path"), F.concat(F.lit("b/"), "name").alias("backup_path"), F.lit("media").alias("kind"), (C("doc_id") % 2 == 0).alias("included"), C("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    docs.groupBy(F.floor(C("doc_id") / 50).alias("g")).agg(F.collect_list(file).alias("files")).select(F.lit(1).alias("schema_version"), F.lit("full").alias("type"), F.lit("verified").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("created_at_utc"), "files").repartition(4).write.option("maxRecordsPerFile", 1).json(path)
    return readers.manifests(s, path).select(C("path").alias("path"), "included", "size_bytes", "sha256")


def _middle(df: DataFrame, column: str) -> int:
    """Half way between the least and the greatest value, so that a cutoff grows with the table; 0 without rows."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    return 0 if r["a"] is None else (r["a"] + r["b"]) // 2


def _staged(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select(F.concat(F.lit("staging/"), C("doc_id").cast("string")).alias("path"), C("doc_id").alias("modified_ns"))


HALF = "(SELECT (min(created_ns) + max(created_ns)) // 2 FROM media)"
ENTRIES = {
    "s4_drop_folder": (_s4, "SELECT CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING) AS name, count(*) FILTER (WHERE doc_id % 3 = 0) AS media, count(*) FILTER (WHERE doc_id % 3 = 1) AS sidecar, count(*) FILTER (WHERE doc_id % 3 = 2) AS ready FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY 1"),
    "s5_manifests": (_s5, "SELECT 'n' || CAST(doc_id AS STRING) AS path, doc_id % 2 = 0 AS included, n_chars AS size_bytes, sha256(text) AS sha256 FROM documents"),
    "j2_segments_by_status": (lambda s, d: reconcile.with_status(frame(s, d, "media"), _status(s, d), ("accepted", "restored")).select("media_segment_id", "status"), sql(LATEST.format(k="media_segment_id", t="slog") + "SELECT media.media_segment_id, cur.status FROM media JOIN cur ON media.media_segment_id = cur.media_segment_id WHERE cur.status IN ('accepted', 'restored')", "media", "slog")),
    "j3_u2_media_claims": (lambda s, d: media.resolve_claims(*_claims(s, d)).select("cid", "claim_id", "claim"), sql(J3 + "SELECT cid, claim_id, claim FROM cl", "media")),
    "j4_pairs": (lambda s, d: media.paired(*_parts(s, d)).select("doc_id", C("s_raw").isNotNull().alias("has_sidecar"), C("b_sha256").isNotNull().alias("has_body")), "SELECT doc_id, doc_id % 13 <> 1 AS has_sidecar, doc_id % 13 <> 6 AS has_body FROM documents"),
    "j5_backed_up": (lambda s, d: reconcile.backed_up(frame(s, d, "media"), _backup(s, d)).select("id"), sql("SELECT id FROM media WHERE id % 4 <> 1 AND id % 7 <> 2", "media")),
    "j6_three_way": (_j6, sql(J6, "media")),
    "m1_decisions": (_m1, M1),
    "m2_verified_bodies": (lambda s, d: media.verified(_docs(s, d).where("doc_id % 8 <> 3").select("name", F.encode("text", "UTF-8").alias("content")), _docs(s, d).select("name", F.octet_length("text").cast("long").alias("size_bytes"), F.when(C("doc_id") % 6 == 1, "bad").otherwise(F.sha2("text", 256)).alias("sha256"))), "SELECT 'n' || CAST(doc_id AS STRING) AS name, doc_id % 8 <> 3 AS size_ok, doc_id % 8 <> 3 AND doc_id % 6 <> 1 AS hash_ok FROM documents"),
    "m3_accepted": (_m3, sql(J3 + ", n1 AS (SELECT *, row_number() OVER (PARTITION BY collector_id, source_key ORDER BY cid) AS a FROM cl WHERE claim = 'new'), n2 AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY cid) AS b FROM n1 WHERE a = 1) SELECT count(*) AS segments, CAST(sum(cid) AS BIGINT) AS cids, count(*) AS ids, count(*) AS states, count(*) AS events FROM n2 WHERE b = 1", "media")),
    "m3_accepted_rows": (lambda s, d: (lambda seg, st, ev: seg.select("id", "cid", "source_key").join(st.select(C("media_segment_id").alias("id"), C("status").alias("state")), "id").join(ev.select(C("media_segment_id").alias("id"), C("status").alias("event")), "id").drop("id"))(*media.accepted(media.resolve_claims(*_claims(s, d)), 0, C("cid"))),
        sql(J3 + ", n1 AS (SELECT *, row_number() OVER (PARTITION BY collector_id, source_key ORDER BY cid) AS a FROM cl WHERE claim = 'new'), n2 AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY cid) AS b FROM n1 WHERE a = 1) SELECT cid, source_key, 'accepted' AS state, 'accepted' AS event FROM n2 WHERE b = 1", "media")),
    "m4_confirmed": (lambda s, d: media.confirmed(frame(s, d, "media"), frame(s, d, "media").withColumn("sha256", F.when(C("id") % 5 == 0, "x").otherwise(C("sha256"))), ("collector_id", "source_key", "sha256", "metadata_hash")).select("id"), sql("SELECT id FROM media WHERE id % 5 <> 0", "media")),
    "m5_x10_fingerprints": (lambda s, d: frame(s, d, "media").withColumn("f", media.metadata_hash(C("sha256"), C("size_bytes"), C("metadata_hash"))).agg(F.count_distinct("f").alias("n")), sql("SELECT count(DISTINCT (sha256, size_bytes, metadata_hash)) AS n FROM media", "media")),
    "m6_grown_files": (lambda s, d: media.grown(_docs(s, d).select("name", C("n_chars").alias("size_bytes"), C("doc_id").alias("modified_ns")), _docs(s, d).where("doc_id % 9 <> 2").select("name", (C("n_chars") + (C("doc_id") % 7 == 3).cast("long")).alias("size_bytes"), C("doc_id").alias("modified_ns"))), "SELECT 'n' || CAST(doc_id AS STRING) AS name, CASE WHEN doc_id % 9 = 2 THEN 'missing' WHEN doc_id % 7 = 3 THEN 'growing' ELSE 'stable' END AS state FROM documents"),
    "m7_unchanged_skipped": (lambda s, d: (lambda x: media.unchanged_skipped(x, x.where("doc_id % 3 = 0")).select("doc_id"))(_docs(s, d).select("doc_id", C("name").alias("ingest_key"), F.lit("terminal").alias("kind"), F.sha2("text", 256).alias("signature"))), "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0"),
    "a22_backlog": (lambda s, d: media.backlog(frame(s, d, "media"), frame(s, d, "media").where("id % 3 = 0"), ("source_key",)), sql("SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM media WHERE id % 3 <> 0", "media")),
    "l4_media_sample": (lambda s, d: reconcile.media_sample(frame(s, d, "media").withColumn("included", C("id") % 2 == 0), 3, "collector_id").select("id"), sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY collector_id ORDER BY sha256, path) AS n FROM media WHERE id % 2 = 0) AS x WHERE n <= 3", "media")),
    "l5_scan_stream": (_l5, sql("""r AS (SELECT source_key, row_number() OVER (ORDER BY source_key) - 1 AS p, count(*) OVER () AS c FROM media), n AS (SELECT max(c) AS c, (2 * max(c) + 4) // 5 AS n FROM r),
        t AS (SELECT b.b AS batch, (b.b * n.n + i.i) % n.c AS p FROM n, (SELECT unnest(range(4)) AS b) AS b, (SELECT unnest(range((2 * max(c) + 4) // 5)) AS i FROM r) AS i)
        SELECT r.source_key, CAST(t.batch AS BIGINT) AS batch FROM t JOIN r ON t.p = r.p""".replace("r AS (", "WITH r AS (", 1), "media")),
    "l5_fair_scan": (lambda s, d: media.fair_scan(frame(s, d, "media"), "source_key", "s150", 60).select("source_key"), sql("SELECT source_key FROM media ORDER BY source_key <= 's150', source_key LIMIT 60", "media")),
    "r2_retention_fold": (lambda s, d: reconcile.retention_fold(frame(s, d, "retention"), frame(s, d, "media").where("id % 2 = 0").select("path")), sql("WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_segment_id, path ORDER BY id DESC) AS rn FROM retention) AS x WHERE rn = 1) SELECT media_segment_id, path, CASE WHEN status = 'planned' AND path NOT IN (SELECT path FROM media WHERE id % 2 = 0) THEN 'deleted' ELSE status END AS status FROM cur", "retention", "media")),
    "r3_manifest_errors": (_r3, R3),
    # the same with cutoffs that follow the table; the queries above keep the cutoffs that their SQL names
    "j9_orphans_all": (lambda s, d: reconcile.orphans(_staged(s, d), frame(s, d, "ilog"), ("pending", "validated"), _middle(_staged(s, d), "modified_ns")), sql(LATEST.format(k="ingest_key", t="ilog") + "SELECT 'staging/' || CAST(doc_id AS STRING) AS path, doc_id AS modified_ns FROM documents WHERE doc_id < (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) AND 'staging/' || CAST(doc_id AS STRING) NOT IN (SELECT path FROM cur WHERE status IN ('pending', 'validated'))", "ilog")),
    "l3_oldest_all": (lambda s, d: reconcile.oldest(frame(s, d, "media"), _middle(frame(s, d, "media"), "created_ns"), 25).select("media_segment_id"), sql(f"SELECT media_segment_id FROM media WHERE created_ns < {HALF} ORDER BY created_ns, media_segment_id LIMIT 25", "media")),
    "r1_retention_plan_all": (lambda s, d: reconcile.retention_plan(frame(s, d, "media"), _status(s, d), _backup(s, d), "critical", _middle(frame(s, d, "media"), "created_ns"), 40).select("media_segment_id"), sql(LATEST.format(k="media_segment_id", t="slog") + f"SELECT media.media_segment_id FROM media JOIN cur ON media.media_segment_id = cur.media_segment_id WHERE cur.status IN ('accepted', 'restored') AND media.id % 4 <> 1 AND media.id % 7 <> 2 AND created_ns < {HALF} ORDER BY created_ns, media.media_segment_id LIMIT 40", "media", "slog")),
}
ENTRIES |= {name: ENTRIES[f"{name}_all"] for name in ("j9_orphans", "l3_oldest", "r1_retention_plan")}  # names of earlier forms, which took some rows only
