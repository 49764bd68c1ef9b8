"""Idempotent append: which candidate becomes a fact, which repeats one, which contradicts one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("collector_id", "idempotency_key")


def resolve_idempotent(candidates: DataFrame, order: str | Column, existing: DataFrame | None = None, conflict: str = "EVENT_IDEMPOTENCY_CONFLICT", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """candidates with ``status`` (accepted, duplicate, conflict, rejected), ``fact_id`` (the surviving row's) and ``error_code``.

    candidates: id, the keys, content_hash and error_code; existing: the keys, id and content_hash of facts.
    The first valid row of a key in ``order`` becomes a fact unless one exists already.  ids are unique; keys of
    valid rows are not null.  candidates are read twice.
    """
    order = F.col(order) if isinstance(order, str) else order
    first = F.struct(F.col("id").cast("long").alias("id"), F.col("content_hash").alias("hash"))
    valid = candidates.where("error_code is null").withColumn("_order", order)
    # combined before the shuffle; rejected rows take no part, whatever their keys
    winners = valid.groupBy(*keys).agg(F.min_by(first, "_order").alias("_first"))
    if existing is None:
        winners = winners.withColumn("_old", F.lit(None).cast("struct<id:bigint,hash:string>"))
    else:
        winners = winners.join(existing.select(*keys, first.alias("_old")), list(keys), "left")
    out = valid.drop("_order").join(winners, list(keys)).withColumn("_winner", F.coalesce("_old", "_first"))
    status = F.when(F.col("_old").isNull() & (F.col("id") == F.col("_first.id")), "accepted").when(F.col("_winner.hash") == F.col("content_hash"), "duplicate").otherwise("conflict")
    out = out.withColumns({"status": status, "fact_id": F.col("_winner.id")}).withColumn("error_code", F.when(F.col("status") == "conflict", conflict))
    bad = candidates.where("error_code is not null").withColumns({"status": F.lit("rejected"), "fact_id": F.lit(None).cast("long")})
    columns = [*candidates.columns, "status", "fact_id"]
    return out.select(columns).unionByName(bad.select(columns))


def import_counters(results: DataFrame) -> DataFrame:
    """(collector_id, imported, duplicates)."""
    return results.groupBy("collector_id").agg(F.count_if(F.col("status") == "accepted").alias("imported"), F.count_if(F.col("status") == "duplicate").alias("duplicates"))
