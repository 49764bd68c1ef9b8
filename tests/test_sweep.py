"""The strongest fact of each instant against a search over all facts, and facts that all overlap."""

import random

from pyspark.sql import functions as F
from tidemark.operators import coverage, sweep
from tidemark.operators.publication import Publication
from tidemark.sources.paths import work_dir

DAY, DAY0 = coverage.DAY_NS, 20_000 * coverage.DAY_NS
FACTS = "collector_id string, start_ns long, end_ns long, availability string, quality_flags array<string>, reason_code string, priority int, stable_id string"


def _shuffled(spark):
    """Rows written to shuffles so far."""
    gate, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_short_and_long_facts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        start = DAY0 + rng.randrange(40 * DAY)
        length = rng.choice([1, 10**9, DAY // 24, DAY // 3, DAY, 3 * DAY, 30 * DAY, 0])
        flags = rng.choice([None, [], ["corrupt"], ["incomplete", "a,b"]])
        rows.append((rng.choice("ab"), start, start + length, rng.choice(["covered", "confirmed_idle"]), flags, f"R{i % 3}", rng.choice([20, 30, 40]), f"f{i}"))
    out = sweep.strongest(spark.createDataFrame(rows, FACTS), "collector_id").orderBy("collector_id", "start_ns").collect()
    for name in "ab":
        mine = [r for r in rows if r[0] == name]
        got = [r for r in out if r.collector_id == name]
        assert all(x.end_ns <= y.start_ns for x, y in zip(got, got[1:]))
        for a in sorted({t for r in mine for t in r[1:3]}):
            on = [r for r in mine if r[1] <= a < r[2]]
            held = [(r.availability, r.reason_code, r.quality_flags) for r in got if r.start_ns <= a < r.end_ns]
            best = min(on, key=lambda r: (-r[6], r[7]), default=None)
            assert held == ([(best[3], best[5], sorted({f for r in on for f in r[4] or []}))] if on else [])


def test_facts_that_all_overlap(spark):
    """One collector's facts of one afternoon: rows that are shuffled stay a small multiple of the facts."""
    n = 1500
    facts = spark.range(n, numPartitions=4).select(F.lit("c").alias("collector_id"), (F.lit(DAY0 + DAY // 2) + F.col("id") * 10**9).alias("start_ns"), (F.lit(DAY0 + DAY // 2) + (n + F.col("id")) * 10**9 + 7).alias("end_ns"), F.lit("covered").alias("availability"), F.array(F.lit("corrupt")).alias("quality_flags"), F.lit("R").alias("reason_code"), F.lit(20).alias("priority"), F.col("id").cast("string").alias("stable_id"))
    collectors = spark.createDataFrame([("c", 60 * 10**9, 30 * 10**9, 600 * 10**9, "UTC")], "collector_id string, heartbeat_period_ns long, allowed_lateness_ns long, offline_after_ns long, timezone string")
    plans = spark.createDataFrame([("c", DAY0, DAY0, DAY0 + DAY)], "collector_id string, plan_start_ns long, start_ns long, end_ns long")
    before = _shuffled(spark)
    out = coverage.build_coverage(collectors, plans, facts, DAY0, DAY0 + DAY, DAY0 + 3 * DAY).where("availability = 'covered'").collect()
    assert [(r.start_ns, r.end_ns) for r in out] == [(DAY0 + DAY // 2, DAY0 + DAY // 2 + (2 * n - 1) * 10**9 + 7)]
    assert _shuffled(spark) - before < 10 * n


def test_repairs_and_publications_of_facts_that_all_overlap(spark):
    """Some of them come late: the days are built again, and neither way shuffles more than some rows a fact."""
    n, start = 1500, DAY0 + DAY // 2
    facts = spark.range(n, numPartitions=4).select(F.lit("c").alias("collector_id"), F.col("id").alias("projection_id"), (F.lit(start) + F.col("id") * 10**9).alias("start_ns"), (F.lit(start) + (n + F.col("id")) * 10**9 + 7).alias("end_ns"), F.lit("covered").alias("availability"), F.array(F.lit("corrupt")).alias("quality_flags"), F.lit("R").alias("reason_code"), F.lit(20).alias("priority"), F.col("id").cast("string").alias("stable_id"))
    collectors = spark.createDataFrame([("c", 60 * 10**9, 30 * 10**9, 600 * 10**9, "UTC")], "collector_id string, heartbeat_period_ns long, allowed_lateness_ns long, offline_after_ns long, timezone string")
    plans = spark.createDataFrame([("c", DAY0, DAY0, DAY0 + DAY)], "collector_id string, plan_start_ns long, start_ns long, end_ns long")
    on_time, late, now = facts.where("projection_id % 7 > 0"), facts.where("projection_id % 7 = 0"), DAY0 + 3 * DAY
    want = [(start, start + (2 * n - 1) * 10**9 + 7)]

    before = _shuffled(spark)
    old = coverage.by_day(coverage.build_coverage(collectors, plans, on_time.drop("projection_id"), DAY0, DAY0 + DAY, now))
    out = coverage.repaired(collectors, plans, facts.drop("projection_id"), late.drop("projection_id"), old, DAY0, DAY0 + DAY, now)
    assert [(r.start_ns, r.end_ns) for r in out.where("availability = 'covered'").collect()] == want
    assert _shuffled(spark) - before < 40 * n

    before = _shuffled(spark)
    own = Publication(spark, work_dir(spark, "publication"), collectors, plans, DAY0, DAY0 + DAY)
    for batch, rows in enumerate((on_time, late)):
        own.add(rows, batch)
        own.publish(batch, now, None if batch else own.windows)
    assert [(r.start_ns, r.end_ns) for r in own.coverage().where("availability = 'covered'").collect()] == want
    assert [(r.collector_id, r.day, r.generation) for r in own.states().collect()] == [("c", DAY0 // DAY, 2)]
    assert _shuffled(spark) - before < 40 * n
