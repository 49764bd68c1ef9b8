"""Coverage kept up by collector and day equals coverage built at once, and touches no other day."""

import os
import random

from tidemark.operators import coverage
from tidemark.operators.publication import Publication
from tidemark.sources.paths import work_dir

MIN = 60 * 10**9
DAY, DAY0 = coverage.DAY_NS, 20_000 * coverage.DAY_NS  # a Sunday
FACTS = "collector_id string, projection_id long, start_ns long, end_ns long, availability string, quality_flags array<string>, reason_code string, priority int, stable_id string"


def _files(path):
    """Of each collector and day below coverage: the files and when they were written."""
    out = {}
    for top, _, names in os.walk(path.removeprefix("file://") + "/coverage"):
        for n in names:
            if n.endswith(".parquet"):
                parts = dict(x.split("=") for x in top.split("/") if "=" in x)
                out.setdefault((parts["collector_id"], int(parts["day"])), {})[f"{top}/{n}"] = os.stat(f"{top}/{n}").st_mtime_ns
    return out


def test_batches_of_late_facts(spark):
    rng = random.Random(11)
    start, end, now = DAY0, DAY0 + 12 * DAY, DAY0 + 9 * DAY + 371 * MIN
    names = ["a", "b", "0c"]
    limits = [(n, 30 * MIN, 20 * MIN, off * MIN, "UTC") for n, off in zip(names, (120, 2000, 120), strict=True)]
    collectors = spark.createDataFrame(limits, "collector_id string, heartbeat_period_ns long, allowed_lateness_ns long, offline_after_ns long, timezone string")
    week = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    windows = [(n, d, a, b) for n in names for d in week for a, b in ([(0, 1440)] if n == "a" else [(480, 1000), (1200, 1440)])]
    plans = coverage.expand_schedule(collectors, spark.createDataFrame(windows, "collector_id string, day string, start_minute int, end_minute int"), start, end).cache()

    def fact(i, name, first, last):
        s = DAY0 + int(rng.uniform(first, last) * 1440) * MIN
        e = s + rng.choice([5, 40, 300, 4000]) * MIN
        return (name, i, s, e, rng.choice(["covered", "confirmed_idle"]), rng.choice([[], ["corrupt"]]), "R", rng.choice([20, 30]), f"f{i}")

    batches = [
        [fact(i, "a", -2, 9) for i in range(30)] + [fact(100 + i, "b", 4, 9) for i in range(6)],  # nothing of 0c
        [fact(200 + i, "a", 3.1, 3.4) for i in range(2)],
        [fact(300, "b", 0.2, 0.3), fact(301, "0c", 5, 5.2)],  # earlier than all of b so far; the first of 0c
        [],
    ]
    path = work_dir(spark, "publication")
    own = Publication(spark, path, collectors, plans, start, end)
    seen = []
    for n, rows in enumerate(batches):
        seen += rows
        facts = spark.createDataFrame(rows, FACTS)
        before, old = _files(path), {(r.collector_id, r.day): r.generation for r in own.states().collect()}
        for _ in range(2 if n == 1 else 1):  # a repeated step changes nothing
            own.add(facts, n)
            days = own.windows.select("collector_id", "day").distinct() if n == 0 else own.changed_days(n)
            touched = {(r.collector_id, r.day) for r in days.collect()}
            own.publish(n, now, days if n == 0 else None)
        want = coverage.build_coverage(collectors, plans, spark.createDataFrame(seen, FACTS).drop("projection_id"), start, end, now)
        key = lambda df: sorted(map(str, df.select("collector_id", "start_ns", "end_ns", "availability", "reason_code", "quality_flags").collect()))
        assert key(own.coverage()) == key(want)
        after = _files(path)
        assert all(after[k] == v for k, v in before.items() if k not in touched)  # not even rewritten
        assert all(set(before[k].items()) < set(after[k].items()) for k in before if k in touched)  # generations are never changed
        now_ = {(r.collector_id, r.day): r.generation for r in own.states().collect()}
        assert all(g == old.get(k, 0) + (k in touched) for k, g in now_.items())
        assert len(touched) == {0: len(after), 3: 0}.get(n, len(touched))
        if n == 1:
            assert 0 < len(touched) <= 5
    marks = {(r.collector_id, r.day): r.watermark for r in own.states().collect()}
    assert max(v for (c, _), v in marks.items() if c == "a") <= 201 and max(v for (c, _), v in marks.items() if c == "0c") == 301
