"""Queries of activity import and of the streaming jobs, each run to its end over landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, facts
from ..sources import pages, readers
from ..sources.paths import stored, work_dir
from ..streaming import jobs
from .adapters import DAY, T0, frame, sql
from .ingest import RES

C = F.col
CUT = T0 + 20 * DAY


#: Rows of a landed file, about: a larger part is dealt to more files, all of one micro-batch.
FILE_ROWS = 250_000


def _landed(df: DataFrame, what: str, parts: int = 4, order: str = "id") -> tuple[DataFrame, str]:
    """A file stream of df's rows, landed in parts that come in order, one a micro-batch.

    All parts have as many files, as a micro-batch takes a number of files; that goes by the smallest part, so that none is empty.
    """
    spark = df.sparkSession
    path = work_dir(spark, what)
    top = df.agg(F.max(order)).first()[0] or 0
    within = [(C(order) >= i * (top + 1) // parts) & (C(order) < (i + 1) * (top + 1) // parts) for i in range(parts)]
    files = max(1, min(df.agg(*(F.count_if(part) for part in within)).first()) // FILE_ROWS)
    for part in within:
        rows = df.where(part)
        rows = rows.repartition(files, order) if files > 1 else rows.coalesce(1)
        rows.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path), path


def _collected(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """A streaming frame's whole output, written and read back."""
    spark = stream.sparkSession
    out = work_dir(spark, what)
    schema = stream.schema

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data").select(schema.names)


def _t6(s: SparkSession, d: str) -> DataFrame:
    cols = ["id", "collector_id", "idempotency_key", "content_hash", "error_code"]
    stream, path = _landed(stored(frame(s, d, "cand").select(cols), "candidates"), "candidates")  # a join, and landed in parts
    out = work_dir(s, "ingest")
    jobs.ingest(stream, f"{out}/facts", f"{out}/results", f"{out}/checkpoint").awaitTermination()
    return s.read.parquet(f"{out}/results").select("id", "status", "fact_id")


def _positions(s: SparkSession, d: str, changed: bool = False) -> DataFrame:
    """Positions of all events; if changed, collector c3 goes on to other buckets."""
    bucket = F.when(C("collector_id") == "c3", F.concat(F.lit("b"), F.floor(C("id") / 300).cast("string"))).otherwise("b") if changed else F.lit("b")
    return frame(s, d, "raw").select("id", "collector_id", bucket.alias("bucket_id"), C("device_ns").alias("source_time_ns"), C("id").alias("source_event_id"))


def _t2(s: SparkSession, d: str) -> DataFrame:
    """The last checkpoint of a stream, for collectors that keep their bucket."""
    stream, _ = _landed(_positions(s, d), "positions")
    out = work_dir(s, "positions")
    jobs.checkpointed(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    t = s.read.parquet(f"{out}/table")
    last = t.agg(F.max("batch")).first()[0]
    return t.where(C("batch") == last).select("collector_id", "bucket_id", "source_time_ns", "source_event_id", "error")


def _t2_batch(s: SparkSession, d: str) -> DataFrame:
    p = _positions(s, d, changed=True)
    old = activity.advance_checkpoint(p.limit(0), p.where("id < 250")).drop("error")
    return activity.advance_checkpoint(old, p.where("id >= 250"))


def _imported(rows: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """Rows that a stream of rows has released, with a lateness of an hour, and the collectors' checkpoints."""
    stream, _ = _landed(rows.withColumnRenamed("id", "source_event_id"), what, order="source_event_id")
    out = work_dir(rows.sparkSession, what)
    jobs.imported(stream, "seen_ts", "1 hour", f"{out}/rows", f"{out}/positions", f"{out}/checkpoint").awaitTermination()
    given = rows.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows/rows")
    return given.withColumnRenamed("source_event_id", "id"), jobs.positions(rows.sparkSession, f"{out}/positions")


def _seen(ns: str) -> Column:
    return F.timestamp_micros(F.floor(C(ns) / 1000)).alias("seen_ts")


def _t1(s: SparkSession, d: str) -> DataFrame:
    """Rows that the watermark has released: those that end well before the latest end."""
    rows = frame(s, d, "raw").where("event_type = 'activitywatch.event'").select("id", "collector_id", F.lit("b").alias("bucket_id"), C("device_ns").alias("source_time_ns"), C("device_ns").alias("end_ns"), _seen("device_ns"))
    out, _ = _imported(rows, "lateness")
    top = rows.agg(F.max("end_ns").alias("top"))
    return out.join(F.broadcast(top)).where(F.floor(C("end_ns") / 1000) < F.floor(C("top") / 1000) - 2 * 3600 * 10**6).select("id")


def _deferred(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All heartbeats, read when they are received; collector c3 goes on to other buckets."""
    hb = frame(s, d, "hb")
    bucket = F.when(C("collector_id") == "c3", F.concat(F.lit("b"), F.floor(C("id") / 300).cast("string"))).otherwise("b").alias("bucket_id")
    return _imported(hb.select("id", "collector_id", bucket, C("device_start_ns").alias("source_time_ns"), C("device_end_ns").alias("end_ns"), _seen("received_ns"), "state", "quality_flags"), "deferred")


STABLE = """WITH b AS (SELECT *, CASE WHEN collector_id = 'c3' THEN 'b' || CAST(id // 300 AS VARCHAR) ELSE 'b' END AS bucket FROM hb),
o AS (SELECT collector_id, arg_min(bucket, (device_start_ns, id)) AS own, CASE WHEN count(DISTINCT bucket) > 1 THEN 'ACTIVITY_BUCKET_CHANGED' END AS error FROM b GROUP BY 1),
w AS (SELECT b.*, max(CASE WHEN device_end_ns >= (SELECT max(received_ns) // 1000000 - 3600000 FROM hb) * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY b.collector_id ORDER BY device_start_ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS late
  FROM b JOIN o ON b.collector_id = o.collector_id AND b.bucket = o.own)
"""


def _t4(s: SparkSession, d: str) -> DataFrame:
    stream, _ = _landed(frame(s, d, "revs"), "revisions", order="seq")
    with jobs.rocksdb(s):
        return _collected(jobs.revisions(stream), "revised")


REVS = """WITH c AS (SELECT *, first_value(content) OVER (PARTITION BY bucket_id, id ORDER BY seq) AS c0 FROM revs),
v AS (SELECT *, max(CASE WHEN content = c0 THEN duration END) OVER (PARTITION BY bucket_id, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM c),
st AS (SELECT *, CASE WHEN mx IS NULL THEN 'base' WHEN content <> c0 THEN 'error' WHEN duration > mx THEN 'revision' WHEN duration = mx THEN 'duplicate' ELSE 'error' END AS status FROM v)
"""


def _s3(s: SparkSession, d: str) -> DataFrame:
    path = work_dir(s, "pages")
    frame(s, d, "awpages").write.json(path)
    return activity.merge_pages(readers.activity_pages(s, path)).select("bucket_id", "id", "duration", "error")


def _s3_stream(s: SparkSession, d: str) -> DataFrame:
    """Pages read as a stream by their own source, in two runs of one query: the second goes on behind the first's last page."""
    pages.register(s)
    path, out = work_dir(s, "pages"), work_dir(s, "paged")
    rows = frame(s, d, "awpages")
    # what is landed later has later names, as pages are numbered
    for part in range(2):
        rows.where(C("id") % 2 == part).write.json(f"{path}/landed-{part}")
        _moved(s, f"{path}/landed-{part}", f"{path}/pages", part)
        stream = s.readStream.format("activity_pages").load(f"{path}/pages")
        stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/data/batch={n}")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = s.read.schema(readers.ACTIVITY_PAGE).parquet(f"{out}/data").select("bucket_id", "page", "id", "timestamp", "duration", "data")
    return activity.merge_pages(got).select("bucket_id", "id", "duration", "error")


def _moved(s: SparkSession, source: str, target: str, part: int) -> None:
    """The files that Spark wrote below source, renamed into target in the order of their names."""
    jvm = s.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(target)
    system = there.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(there)
    for f in system.listStatus(jvm.org.apache.hadoop.fs.Path(source)):
        if f.getPath().getName().startswith("part-"):
            system.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{target}/{part}-{f.getPath().getName()}"))


PAGES = "SELECT bucket_id, id, max(duration) AS duration, CASE WHEN min(timestamp) <> max(timestamp) OR min(data) <> max(data) THEN 'ACTIVITY_PAGES_CONFLICT' END AS error FROM awpages GROUP BY 1, 2"

ENTRIES = {
    "s3_activity_pages": (_s3, sql(PAGES, "awpages")),
    "s3_page_stream": (_s3_stream, sql(PAGES, "awpages")),
    "u3_merged_pages": (lambda s, d: activity.merge_pages(frame(s, d, "awpages")).select("bucket_id", "id", "duration", "error"), sql(PAGES, "awpages")),
    "w11_t4_revisions": (lambda s, d: activity.revisions(frame(s, d, "revs")).select("seq", "status", C("idempotency_key").isNotNull().alias("has_key")), sql(REVS + "SELECT seq, status, status IN ('base', 'revision') AS has_key FROM st", "revs")),
    "w12_t1_stable_prefix": (lambda s, d: activity.stable_prefix(frame(s, d, "hb"), "collector_id", ("device_start_ns", "id"), "device_end_ns", CUT).select("id"), sql(f"WITH w AS (SELECT id, max(CASE WHEN device_end_ns >= {CUT} THEN 1 ELSE 0 END) OVER (PARTITION BY collector_id ORDER BY device_start_ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS late FROM hb) SELECT id FROM w WHERE late = 0", "hb")),
    "t1_released_stream": (_t1, sql("SELECT id FROM raw WHERE event_type = 'activitywatch.event' AND device_ns // 1000 < (SELECT max(device_ns) // 1000 - 7200000000 FROM raw WHERE event_type = 'activitywatch.event')", "raw")),
    "t2_checkpoint_stream": (_t2, sql("SELECT collector_id, 'b' AS bucket_id, max(device_ns) AS source_time_ns, arg_max(id, (device_ns, id)) AS source_event_id, CAST(NULL AS VARCHAR) AS error FROM raw GROUP BY 1", "raw")),
    "t1_released_rows": (lambda s, d: _deferred(s, d)[0].select("id", "collector_id", "state", F.concat_ws(",", "quality_flags").alias("quality_flags")), sql(STABLE + "SELECT id, collector_id, state, array_to_string(quality_flags, ',') AS quality_flags FROM w WHERE late = 0", "hb")),
    "t2_deferred_stream": (lambda s, d: _deferred(s, d)[1], sql(STABLE + "SELECT o.collector_id, any_value(own) FILTER (WHERE id IS NOT NULL) AS bucket_id, max(device_start_ns) AS source_time_ns, arg_max(id, (device_start_ns, id)) AS source_event_id, any_value(error) AS error FROM o LEFT JOIN (SELECT * FROM w WHERE late = 0) AS r ON o.collector_id = r.collector_id GROUP BY 1", "hb")),
    "t2_checkpoint_batch": (_t2_batch, sql("WITH p AS (SELECT * FROM raw WHERE collector_id <> 'c3' OR id < 250) SELECT collector_id, CASE WHEN collector_id = 'c3' THEN 'b0' ELSE 'b' END AS bucket_id, max(device_ns) AS source_time_ns, arg_max(id, (device_ns, id)) AS source_event_id, CASE WHEN collector_id = 'c3' THEN 'ACTIVITY_BUCKET_CHANGED' END AS error FROM p GROUP BY 1", "raw")),
    "t3_rescan": (lambda s, d: facts.resolve_idempotent(activity.rescanned(frame(s, d, "cand").withColumn("timestamp_ns", C("device_ns")), F.lit(T0 + 5 * DAY)), "id").groupBy("status").agg(F.count("*").alias("n")), sql(RES.replace("FROM cand", f"FROM cand WHERE device_ns >= {T0 + 5 * DAY}") + "SELECT status, count(*) AS n FROM res GROUP BY 1", "cand")),
    "t4_revision_stream": (_t4, sql(REVS + "SELECT bucket_id, id, seq, status FROM st", "revs")),
    "t5_poll_heartbeat": (lambda s, d: activity.poll_heartbeat(frame(s, d, "hb").select("collector_id", C("device_start_ns").alias("start_ns"), F.when(C("id") % 3 == 0, C("device_start_ns")).otherwise(C("device_end_ns")).alias("end_ns"), F.lit(200 * 10**9).alias("period_ns"))).select("start_ns", "end_ns"), sql("SELECT device_start_ns AS start_ns, CASE WHEN id % 3 = 0 THEN device_start_ns + 1 ELSE least(device_end_ns, device_start_ns + 200000000000) END AS end_ns FROM hb", "hb")),
    "t6_ingest_stream": (_t6, sql(RES + "SELECT id, status, fact_id FROM res", "cand")),
    "t9_source_errors": (lambda s, d: activity.source_errors(frame(s, d, "cand"), C("error_code").isNotNull() & C("collector_id").isin("c1", "c2")), sql("SELECT collector_id, count(*) AS rows, count(*) FILTER (WHERE error_code IS NOT NULL AND collector_id IN ('c1', 'c2')) AS failed, CASE WHEN count(*) FILTER (WHERE error_code IS NOT NULL AND collector_id IN ('c1', 'c2')) > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM cand GROUP BY 1", "cand")),
}
