"""Sources: JSON lines kept verbatim, activity pages, drop folders, manifests and run samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVITY_PAGE = "bucket_id string, page int, id long, timestamp string, duration double, data string"
MANIFEST = "schema_version int, type string, status string, created_at_utc string, files array<struct<relative_path:string,backup_path:string,kind:string,included:boolean,size_bytes:bigint,sha256:string>>"
SAMPLE = (
    "host_id string, sampled_at_utc string, system_boot_utc string, live struct<status:string,version:string,mode:string>, ready struct<status:string>, "
    "operations struct<free_bytes:bigint,runtime:struct<goroutines:int,heap_alloc_bytes:bigint,runtime_system_bytes:bigint>>, media struct<filesystem_ready_backlog:bigint>, "
    "collectors array<struct<collector_id:string,imported:bigint,duplicates:bigint>>, supervisor struct<status:string,crash_times_utc:array<string>>, "
    "process struct<pid:int,cpu_total_seconds:double,cpu_percent:double,working_set_bytes:bigint,private_bytes:bigint,handles:int,threads:int>, "
    "files struct<database_bytes:bigint,wal_bytes:bigint,logs:struct<files:int,bytes:bigint>,staging:struct<files:int,bytes:bigint>,data:struct<files:int,bytes:bigint>>"
)
SUFFIXES = (".sidecar.json", ".ready")


def json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(raw, source_file): one record a line, its text as it came, so that validation sees what was sent."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"))


def with_batch(raw: DataFrame, batch_id: str, index: str) -> DataFrame:
    """raw with batch_id and idx from its own columns: the order in which the first writer wins travels in the data."""
    return raw.withColumns({"batch_id": F.col(batch_id), "idx": F.col(index)})


def activity_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of an activity export, a JSON object a line; data stays text."""
    return spark.read.schema(ACTIVITY_PAGE).json(path)


def _named(file: Column) -> tuple[Column, Column]:
    """name and part (media, sidecar or ready) of a file of a drop folder."""
    part = F.when(file.endswith(SUFFIXES[0]), "sidecar").when(file.endswith(SUFFIXES[1]), "ready").otherwise("media")
    return F.regexp_replace(file, r"(\.sidecar\.json|\.ready)$", "").alias("name"), part.alias("part")


def drop_archives(spark: SparkSession, path: str, stream: bool = False, bodies: bool = False) -> DataFrame:
    """The rows of drop_folder from archives: Parquet files with a row (file, modified_ns, content) for each landed file.

    So very many small bodies are some large files to list; without bodies their column is not read, but for its length.
    """
    schema = "file string, modified_ns long, content binary"
    files = (spark.readStream if stream else spark.read).schema(schema).parquet(path)
    keep = [F.col("content")] if bodies else []
    return files.select(*_named(F.col("file")), F.concat(F.col("_metadata.file_path"), F.lit("#"), "file").alias("path"), F.octet_length("content").cast("long").alias("size_bytes"), "modified_ns", *keep)


def drop_folder(spark: SparkSession, path: str, stream: bool = False, bodies: bool = False) -> DataFrame:
    """(name, part, path, size_bytes, modified_ns[, content]) of a folder of name, name.sidecar.json, name.ready."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    files = reader.format("binaryFile").load(path)
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    keep = [F.col("content")] if bodies else []
    return files.select(*_named(file), "path", F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), *keep)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(manifest_id, type, status, created_at_utc, path, kind, included, size_bytes, sha256), a row for each file of each manifest."""
    df = spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("manifest_id", F.col("_metadata.file_path"))
    return df.select("manifest_id", "type", "status", "created_at_utc", F.explode("files").alias("f")).select("manifest_id", "type", "status", "created_at_utc", F.col("f.relative_path").alias("path"), "f.kind", "f.included", "f.size_bytes", "f.sha256")


def run_samples(spark: SparkSession, path: str) -> DataFrame:
    """Nested samples, a JSON object a line, with the local day from the file's name."""
    df = spark.read.schema(SAMPLE).json(path)
    return df.withColumn("date_local", F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))
