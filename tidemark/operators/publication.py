"""Coverage that is published by collector and day, and kept up as facts come in.

Below one folder: ``facts`` by collector, day and batch (a fact is in each day that it touches), ``ends`` with the last end
of evidence of each collector and day, ``coverage`` by collector, day and generation, and ``state``, which names the
generation of each day that readers see and is written last.  A batch of facts reads and writes the days that it can
change; a step that is repeated after a failure writes the same folders again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.paths import stored, table_at
from .coverage import BOUNDS, DAY_NS, STATE, affected_days, build_days, met_at_midnight, plan_days
from .intervals import bucket

FACT = "stable_id string, projection_id long, start_ns long, end_ns long, availability string, reason_code string, priority int, quality_flags array<string>, collector_id string, day long, batch long"
END = "collector_id string, day long, t long, batch long"
DAY = "plan long, start_ns long, end_ns long, availability string, reason_code string, quality_flags array<string>, collector_id string, day long, generation long"
STATE_ROW = "collector_id string, day long, generation long, watermark long, batch long"
KEY = ["collector_id", "day"]


class Publication:
    """collectors (collector_id, heartbeat_period_ns, allowed_lateness_ns, offline_after_ns) and plans (see expand_schedule) of a range of whole days."""

    def __init__(self, spark: SparkSession, path: str, collectors: DataFrame, plans: DataFrame, start_ns: int, end_ns: int):
        self.spark, self.path, self.collectors, self.range = spark, path.rstrip("/"), collectors, (start_ns, end_ns)
        self.windows = plan_days(plans)

    def _table(self, name: str, schema: str) -> DataFrame:
        return table_at(self.spark, f"{self.path}/{name}", schema)

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        df.repartition(*KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def add(self, facts: DataFrame, batch: int) -> None:
        """Store a batch of facts (the columns of FACT but day and batch); the same number again replaces them."""
        touched = F.sequence(bucket(F.col("start_ns"), DAY_NS), bucket(F.col("end_ns") - 1, DAY_NS))
        rows = facts.where("end_ns > start_ns").withColumns({"day": F.explode(touched), "batch": F.lit(batch).cast("long")})
        names = [c.split()[0] for c in FACT.split(", ")]
        self._write(rows.select(names), "facts", "collector_id", "day", "batch")
        off = self.collectors.select("collector_id", F.col("offline_after_ns").alias("off"))
        counted = facts.join(off, "collector_id").where((F.col("end_ns") > F.col("start_ns")) & (F.col("start_ns") < self.range[1]) & (F.col("end_ns") > self.range[0] - F.col("off")))
        ends = counted.groupBy("collector_id", bucket(F.col("end_ns"), DAY_NS).alias("day")).agg(F.max("end_ns").alias("t"))
        self._write(ends.withColumn("batch", F.lit(batch).cast("long")), "ends", "batch")

    def changed_days(self, batch: int) -> DataFrame:
        """(collector_id, day) of the planned days that a batch can change.

        Those that its facts reach, up to offline_after past their ends; and, where it has a collector's earliest
        evidence so far, the days from there on to what was the earliest: they had no last evidence, and now have.
        """
        new = self._table("facts", FACT).where(F.col("batch") == batch)
        reached = affected_days(new.select("collector_id", *BOUNDS), self.collectors)
        ends = self._table("ends", END).where(F.col("batch") <= batch)
        first = ends.groupBy("collector_id").agg(F.min("day").alias("now"), F.min(F.when(F.col("batch") < batch, F.col("day"))).alias("was"))
        days = self.windows.select(KEY).distinct()
        led = days.join(first, "collector_id").where("day > now and (was is null or day <= was) and (was is null or now < was)").select(KEY)
        return days.join(reached.unionByName(led).distinct(), KEY, "left_semi")

    def publish(self, batch: int, now_ns: int, days: DataFrame | None = None) -> None:
        """Build the days that a batch can change (or those given, as for the first time or a later now) from all facts up to it, and publish them."""
        days = stored((self.changed_days(batch) if days is None else days).select(KEY).distinct(), "days")
        back = self.collectors.agg(F.max("offline_after_ns")).first()[0] or 0
        back = -(-back // DAY_NS)
        numbers = sorted(r.day for r in days.select("day").distinct().collect())  # days of the calendar
        if not numbers:
            return
        read = sorted({d - i for d in numbers for i in range(back + 1)})
        facts = self._table("facts", FACT).where(F.col("day").isin(read) & (F.col("batch") <= batch))  # only their folders are read
        wanted = days.select("collector_id", F.explode(F.sequence(F.col("day") - back, F.col("day"))).alias("day")).distinct()
        facts = stored(facts.join(wanted, KEY, "left_semi").drop("day", "batch").dropDuplicates(["collector_id", "stable_id"]), "day-facts")
        ends = self._table("ends", END).where(F.col("batch") <= batch).select(*KEY, "t").unionByName(days.withColumn("t", F.lit(None).cast("long"))).groupBy(KEY).agg(F.max("t").alias("t"))
        before = W.partitionBy("collector_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # one row a day
        carried = ends.select(*KEY, F.max("t").over(before).alias("carried"))
        windows = self.windows.join(days, KEY, "left_semi")
        built = build_days(self.collectors, windows, facts.drop("projection_id"), *self.range, now_ns, carried)

        old = self._table("state", STATE_ROW).where(F.col("batch") < batch).groupBy(KEY).agg(F.max("generation").alias("old"))
        off = self.collectors.select("collector_id", F.col("offline_after_ns").alias("off"))
        used = facts.join(off, "collector_id").select("collector_id", "projection_id", F.explode(F.sequence(bucket(F.col("start_ns"), DAY_NS), bucket(F.col("end_ns") + F.col("off") - 1, DAY_NS))).alias("day"))
        marks = used.groupBy(KEY).agg(F.max("projection_id").alias("watermark"))
        state = days.join(old, KEY, "left").join(marks, KEY, "left").select(*KEY, (F.coalesce("old", F.lit(0)) + 1).cast("long").alias("generation"), F.coalesce("watermark", F.lit(0)).cast("long").alias("watermark"), F.lit(batch).cast("long").alias("batch"))
        state = stored(state, "state")
        self._write(built.join(state.select(*KEY, "generation"), KEY), "coverage", "collector_id", "day", "generation")
        self._write(state, "state", "batch")

    def states(self) -> DataFrame:
        """(collector_id, day, generation, watermark) that readers see."""
        latest = self._table("state", STATE_ROW).groupBy(KEY).agg(F.max_by(F.struct("generation", "watermark"), "generation").alias("s"))
        return latest.select(*KEY, "s.*")

    def coverage(self) -> DataFrame:
        """(collector_id, start_ns, end_ns, STATE) of the generations that readers see."""
        rows = self._table("coverage", DAY).join(self.states().drop("watermark"), [*KEY, "generation"])
        return met_at_midnight(rows.select("collector_id", "plan", *BOUNDS, *STATE))
