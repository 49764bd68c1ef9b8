"""Counts, samples and quality gates; every gate groups by host and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import NS
from ..sources.paths import stored
from . import scan
from .intervals import DAY_NS, bucket, longest_run, outside, subtract

BAD_RUN_S = {"activity": 300, "media": 900}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()))


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """(key_1, .., n): rows of each group; a null key is an empty text."""
    return df.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"key_{i}") for i, k in enumerate(keys, 1))).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    """One row: groups with the same content under different ids."""
    return df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n"))


def most(df: DataFrame, column: str) -> DataFrame:
    """One row: the maximum, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("most"))


def usable(kind: Column) -> Column:
    """Whether a classified interval is evidence that counts, by the kind of its collector."""
    flags = F.col("quality_flags")
    bad = F.array_contains(flags, "corrupt") | F.array_contains(flags, "incomplete") | ((kind == "media") & F.array_contains(flags, "obscured"))
    return ~bad & ((F.col("availability") == "covered") | ((F.col("availability") == "confirmed_idle") & (kind == "activity")))


def availability_seconds(coverage: DataFrame, collectors: DataFrame) -> DataFrame:
    """(collector_id, seconds by state, total_s, usable_s, ratio); coverage joined with collectors (collector_id, kind)."""
    df = coverage.join(collectors.select("collector_id", "kind"), "collector_id").withColumn("s", (F.col("end_ns") - F.col("start_ns")) / float(NS))
    kinds = ("covered", "confirmed_idle", "pending", "unknown", "delayed", "offline")
    by = [F.sum(F.when(F.col("availability") == k, F.col("s")).otherwise(0.0)).alias(f"{k}_s") for k in kinds]
    out = df.groupBy("collector_id").agg(*by, F.sum("s").alias("total_s"), F.sum(F.when(usable(F.col("kind")), F.col("s")).otherwise(0.0)).alias("usable_s"))
    return out.withColumn("ratio", F.when(F.col("total_s") > 0, F.col("usable_s") / F.col("total_s")))


def coverage_gate(coverage: DataFrame, collectors: DataFrame, expected: DataFrame, states: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(collector_id, planned_s, classified_s, ratio, longest_bad_s, passed) of each collector with planned time.

    Passed: classification is whole (to 1 ms), 99 % usable, no long run of offline or unknown, projection fresh.
    """
    left = stored(subtract(coverage, exclusions), "left")
    seconds = availability_seconds(left, collectors)
    runs = longest_run(left, "collector_id", F.col("availability").isin("offline", "unknown"))
    df = expected.join(seconds, "collector_id", "left").join(runs, "collector_id", "left").join(states.select("collector_id", "state"), "collector_id", "left").join(collectors.select("collector_id", "kind"), "collector_id")
    limit = F.when(F.col("kind") == "media", BAD_RUN_S["media"]).otherwise(BAD_RUN_S["activity"])
    bad = F.coalesce(F.col("longest_ns") / float(NS), F.lit(0.0))
    whole = F.abs(F.coalesce("total_s", F.lit(0.0)) - F.col("expected_s")) <= 0.001
    ok = (F.col("expected_s") > 0) & whole & (F.col("ratio") >= 0.99) & (bad <= limit) & (F.col("state") == "fresh")
    return df.select("collector_id", F.col("expected_s").alias("planned_s"), F.coalesce("total_s", F.lit(0.0)).alias("classified_s"), "ratio", bad.alias("longest_bad_s"), F.coalesce(ok, F.lit(False)).alias("passed"))


def daily_peaks(samples: DataFrame, maxima: tuple[str, ...], minima: tuple[str, ...] = ("free_bytes",)) -> DataFrame:
    """(host_id, day, ..): peak of each metric, and least of those that must not fall; nulls aside."""
    return samples.groupBy("host_id", "day").agg(*(F.max(c).alias(c) for c in maxima), *(F.min(c).alias(c) for c in minima))


def resource_gate(peaks: DataFrame, limits: dict[str, float], floors: dict[str, float]) -> DataFrame:
    """(host_id, day, passed): every metric is known and within its limit."""
    ok = reduce(lambda a, b: a & b, [*(F.col(c) <= v for c, v in limits.items()), *(F.col(c) >= v for c, v in floors.items())])
    return peaks.select("host_id", "day", F.coalesce(ok, F.lit(False)).alias("passed"))


def counter_peaks(samples: DataFrame) -> DataFrame:
    """(host_id, day, pid, collector_id, imported, duplicates): counters of a process only grow, so their maxima."""
    one = samples.select("host_id", "day", "pid", F.explode("collectors").alias("c"))
    return one.groupBy("host_id", "day", "pid", F.col("c.collector_id").alias("collector_id")).agg(F.max("c.imported").alias("imported"), F.max("c.duplicates").alias("duplicates"))


def supervisor_summary(samples: DataFrame) -> DataFrame:
    """(host_id, day, crashes, restarts, degraded, boots)."""
    out = samples.groupBy("host_id", "day").agg(F.count_distinct("crash_ns").alias("crashes"), F.greatest(F.count_distinct("pid") - 1, F.lit(0)).alias("restarts"), F.count_if(F.col("status") == "degraded").alias("degraded"), F.count_distinct("boot").alias("boots"))
    return out


def cpu_percent(samples: DataFrame) -> DataFrame:
    """samples with cpu_percent since the sample before of the same process; null after a restart."""
    before = {f"_{c}": F.col(c) for c in ("at_ns", "cpu_s", "pid")}
    df = scan.with_previous(samples, ("host_id",), ("at_ns", "id"), before, DAY_NS)
    passed = (F.col("at_ns") - F.col("_at_ns")) / float(NS)
    ok = (F.col("_pid") == F.col("pid")) & (passed > 0)
    return df.withColumn("cpu_percent", F.when(ok, F.greatest(F.lit(0.0), 100 * (F.col("cpu_s") - F.col("_cpu_s")) / passed))).drop(*before)


def largest_gap(samples: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(host_id, day, gap_s): the longest time without a sample, from the day's start to its end, without exclusion windows."""
    day = 86400 * NS
    edges = samples.select("host_id", "day").distinct()
    points = samples.select("host_id", "day", F.col("at_ns").alias("t")).unionByName(edges.select("host_id", "day", (F.col("day") * day).alias("t"))).unionByName(edges.select("host_id", "day", ((F.col("day") + 1) * day).alias("t")))
    w = W.partitionBy("host_id", "day").orderBy("t")
    gaps = points.distinct().withColumn("end_ns", F.lead("t").over(w)).where("end_ns is not null").withColumnRenamed("t", "start_ns")
    left = subtract(gaps.withColumn("_g", F.col("start_ns")), exclusions).groupBy("host_id", "day", "_g").agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("ns"))
    return left.groupBy("host_id", "day").agg((F.max("ns") / float(NS)).alias("gap_s"))


def sample_gate(samples: DataFrame, windows: DataFrame, interval_s: float) -> DataFrame:
    """(host_id, day, samples, unhealthy, gap_s, passed)."""
    n = samples.groupBy("host_id", "day").agg(F.count("*").alias("samples"))
    bad = outside(samples.where("status <> 'healthy'"), "at_ns", windows).groupBy("host_id", "day").agg(F.count("*").alias("unhealthy"))
    out = n.join(bad, ["host_id", "day"], "left").join(largest_gap(samples, windows), ["host_id", "day"], "left").withColumn("unhealthy", F.coalesce("unhealthy", F.lit(0)))
    return out.withColumn("passed", (F.col("unhealthy") == 0) & F.coalesce(F.col("gap_s") <= 3 * interval_s, F.lit(False)))


def backup_gaps(backups: DataFrame, limit_s: float) -> DataFrame:
    """backups (host_id, created_ns) with gap_s to the one before and rpo_met (null for the first)."""
    df = scan.with_previous(backups, ("host_id",), ("created_ns",), {"_before": F.col("created_ns")}, DAY_NS)
    return df.withColumn("gap_s", (F.col("created_ns") - F.col("_before")) / float(NS)).withColumn("rpo_met", F.col("gap_s") <= limit_s).drop("_before")


def count_deltas(counts: DataFrame) -> DataFrame:
    """counts (day, table_name, n) with delta to the day before and whether it is not negative.

    A table that is missing on a day after one on which it was counted fell by all it had.
    """
    before = counts.select((F.col("day") + 1).alias("day"), "table_name", F.col("n").alias("_n"))
    after = counts.agg((F.max("day") + 1).alias("day"))  # nothing is counted yet
    both = counts.join(before, ["day", "table_name"], "right").join(after, "day", "left_anti").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select("day", "table_name", (F.col("n") - F.col("_n")).alias("delta"), (F.col("n") >= F.col("_n")).alias("passed"))


def delta_gate(deltas: DataFrame) -> DataFrame:
    """(host_id, day, delta, passed) of deltas (host_id, day, delta, passed) of several tables: no table may shrink."""
    return deltas.groupBy("host_id", "day").agg(F.sum("delta").alias("delta"), F.every("passed").alias("passed"))


def interventions(log: DataFrame, kinds: tuple[str, ...], first_day: int, days: int) -> DataFrame:
    """Rows of log (host_id, kind, at_ns) of these kinds in a range of days since 1970, with their day."""
    day = bucket(F.col("at_ns"), 86400 * NS)
    return log.where(F.col("kind").isin(*kinds)).withColumn("day", day).where(F.col("day").between(first_day, first_day + days - 1))


def tree_sizes(files: DataFrame, root: Column) -> DataFrame:
    """(root, files, bytes)."""
    return files.groupBy(root.alias("root")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def exercise_gate(records: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(kind, n, passed) of each required kind: exactly one record, passed within its time."""
    verdict = F.when((F.col("status") == "passed") & (F.col("duration_s") <= F.col("rto_s")), "passed").otherwise("failed")
    kinds = records.sparkSession.range(1).select(F.explode(F.array(*(F.lit(k) for k in required))).alias("kind"))
    n = records.withColumn("_v", verdict).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("_v") == "passed").alias("_p"))
    out = kinds.join(n, "kind", "left")
    return out.select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce((F.col("n") == 1) & (F.col("_p") == 1), F.lit(False)).alias("passed"))


def exercise_results(records: DataFrame) -> DataFrame:
    """records with result: passed only if measured and within the time allowed, else failed, with a code."""
    met = (F.col("status") == "passed") & (F.col("duration_s") <= F.col("rto_s"))
    missed = (F.col("status") == "passed") & ~F.coalesce(F.col("duration_s") <= F.col("rto_s"), F.lit(False))
    return records.withColumn("result", F.when(met, "passed").otherwise("failed")).withColumn("error_code", F.when(missed, "EXERCISE_RTO_MISSED"))


def publisher_gate(runs: DataFrame, segments: int, by: tuple[str, ...] = ("day",)) -> DataFrame:
    """(by.., runs, passed): exactly one passed run a day (of a host), with all its segments, begun in its window."""
    good = (F.col("status") == "passed") & (F.col("segments") == segments) & F.col("in_window")
    out = runs.groupBy(*by).agg(F.count_if(F.col("status") == "passed").alias("runs"), F.count_if(good).alias("_g"))
    return out.select(*by, "runs", ((F.col("runs") == 1) & (F.col("_g") == 1)).alias("passed"))


def rehash_gate(sample: DataFrame, bodies: DataFrame) -> DataFrame:
    """(day, n, passed): every sampled file's body has the digest that its manifest says."""
    b = bodies.select("path", F.sha2("content", 256).alias("_h"))
    ok = F.coalesce(F.col("_h") == F.col("sha256"), F.lit(False))
    return sample.join(b, "path", "left").groupBy("day").agg(F.count("*").alias("n"), F.every(ok).alias("passed"))


def daily_verdict(*gates: DataFrame) -> DataFrame:
    """(host_id, day, gates, passed): the conjunction of all gates (host_id, day, passed)."""
    rows = reduce(DataFrame.unionByName, (g.select("host_id", "day", "passed") for g in gates))
    return rows.groupBy("host_id", "day").agg(F.count("*").alias("gates"), F.every("passed").alias("passed"))


def rollup(days: DataFrame, sums: tuple[str, ...], peaks: tuple[str, ...], floors: tuple[str, ...]) -> DataFrame:
    """One row a host over all days."""
    return days.groupBy("host_id").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in peaks), *(F.min(c).alias(c) for c in floors))


def final_verdict(reports: DataFrame, first_day: int, days: int, interventions: DataFrame) -> DataFrame:
    """(host_id, present, passing, interventions, passed): all days in a row are there and pass, and nobody intervened."""
    span = F.sequence(F.lit(first_day).cast("long"), F.lit(first_day + days - 1).cast("long"))
    grid = reports.select("host_id").distinct().withColumn("day", F.explode(span))
    got = grid.join(reports.groupBy("host_id", "day").agg(F.every("passed").alias("ok")), ["host_id", "day"], "left")
    out = got.groupBy("host_id").agg(F.count("ok").alias("present"), F.count_if("ok").alias("passing"))
    hands = interventions.groupBy("host_id").agg(F.count("*").alias("interventions"))
    out = out.join(hands, "host_id", "left").withColumn("interventions", F.coalesce("interventions", F.lit(0)))
    return out.withColumn("passed", (F.col("passing") == days) & (F.col("interventions") == 0))
