"""Sinks: append-only facts and projections that are published by generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import NS


def append_facts(df: DataFrame, path: str, time_ns: str = "device_ns") -> None:
    """Accepted rows, appended by day.  Facts are never rewritten."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(time_ns) / (86400 * NS)).cast("int"))
    df.withColumn("event_date", day).write.mode("append").partitionBy("event_date").parquet(path)


def write_generation(df: DataFrame, path: str, generation: int, by: str = "collector_id") -> None:
    """A whole generation below its own folder; readers do not see it before publish."""
    df.write.mode("overwrite").partitionBy(by).parquet(f"{path}/data/generation={generation}")


def publish(spark: SparkSession, path: str, state: DataFrame, serial: int) -> None:
    """The state rows (collector_id, generation, ..), written last: what they name is what readers see."""
    state.withColumn("serial", F.lit(serial)).write.mode("append").parquet(f"{path}/state")


def published(spark: SparkSession, path: str, by: str = "collector_id") -> DataFrame:
    """Rows of each collector's published generation, for collectors that are fresh."""
    state = spark.read.parquet(f"{path}/state")
    now = state.groupBy(by).agg(F.max_by(F.struct("generation", "state"), "serial").alias("s")).where(F.col("s.state") == "fresh").select(by, F.col("s.generation").cast("int").alias("generation"))
    data = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return data.join(now, [by, "generation"])
