"""Scans in pieces, cells of several widths and subtraction, each against a plain computation."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tidemark.operators import activity, audit, intervals, scan, statelog

DAY, YEAR = intervals.DAY_NS, 365 * intervals.DAY_NS


def _log(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-500, 3000), i, rng.choice(["x", "y", None]), rng.random() < 0.4) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, id long, v string, down boolean")


def _equal(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


@pytest.mark.parametrize("width", [1, 7, 100, 10**6])
def test_neighbours_and_running_values_equal_windows_over_whole_logs(spark, width):
    df = _log(spark)
    w = W.partitionBy("k").orderBy("t", "id")
    _equal(scan.with_previous(df, ("k",), ("t", "id"), {"p": F.col("v"), "q": F.col("t")}, width), df.withColumns({"p": F.lag("v").over(w), "q": F.lag("t").over(w)}))
    _equal(scan.with_next(df, ("k",), ("t", "id"), {"p": F.col("v")}, width), df.withColumn("p", F.lead("v").over(w)))
    for inclusive in (True, False):
        plain = F.max("id").over(w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
        _equal(scan.running_max(df, ("k",), ("t", "id"), "m", F.col("id"), width, inclusive), df.withColumn("m", plain))
    assert scan.with_previous(df.limit(0), ("k",), ("t", "id"), {"p": F.col("v")}, width).count() == 0


def test_counts_that_reach_into_the_piece_before(spark):
    df = _log(spark)
    plain = df.withColumn("n", F.count("*").over(W.partitionBy("k").orderBy("t").rangeBetween(-60, 0)))
    for width in (60, 77, 5000):
        _equal(scan.windowed_count(df, ("k",), "t", 60, "n", width), plain)
    with pytest.raises(ValueError):
        scan.windowed_count(df, ("k",), "t", 60, "n", 59)


def test_log_operators_do_not_depend_on_pieces(spark):
    df = _log(spark).withColumnRenamed("k", "host_id")
    for run in (lambda x: statelog.mode_transitions(df, ("host_id",), "id", "v", x), lambda x: statelog.fault_edges(df, ("host_id",), "id", F.col("down"), "v", x), lambda x: statelog.level_changes(df, ("host_id",), "id", "v", x)):
        _equal(run(9), run(10**9))


def test_no_window_of_a_log_goes_without_its_piece(spark):
    """Windows over all rows have the piece in their key; those without have one row a piece."""
    df = _log(spark)
    samples = df.select(F.col("k").alias("host_id"), (F.col("t") * 10**9).alias("at_ns"), "id", F.lit(1.0).alias("cpu_s"), F.lit(1).alias("pid"), F.col("t").alias("created_ns"))
    spans = df.select("k", F.col("t").alias("start_ns"), (F.col("t") + 5).alias("end_ns"), "down")
    frames = [statelog.mode_transitions(df, ("k",), "id", "v"), statelog.fault_edges(df, ("k",), "id", F.col("down"), "v"), statelog.level_changes(df, ("k",), "id", "v"), statelog.bursts(df, ("k",), "t"), audit.cpu_percent(samples), audit.backup_gaps(samples, 5), intervals.overlaps(spans, "k"), intervals.longest_run(spans, "k", F.col("down"))]
    for frame in frames:
        lines = [x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
        assert lines and all("_piece" in x or "_end" in x for x in lines)
        assert any("_piece" in x.split("windowspecdefinition(")[1].split(" ASC")[0] for x in lines)
    assert "Window" not in activity.stable_prefix(df, "k", ("t", "id"), "t", 5)._jdf.queryExecution().optimizedPlan().toString()


def _spans(rng, n, longest):
    out = []
    for i in range(n):
        start = rng.randrange(-YEAR, 3 * YEAR) if longest > DAY else rng.randrange(0, 4 * 3600 * 10**9)
        out.append((rng.choice(["a", "b"]), start, start + rng.choice([0, 1, rng.randrange(1, longest)]), i))
    return out


@pytest.mark.parametrize("longest", [600 * 10**9, YEAR])
def test_facts_that_hold_a_point_or_a_segment(spark, longest):
    rng = random.Random(longest)
    facts, segments = _spans(rng, 150, longest), _spans(rng, 150, 3600 * 10**9 if longest < DAY else 40 * DAY)
    schema = "c string, start_ns long, end_ns long, id long"
    got = intervals.stab_join(spark.createDataFrame(segments, schema), spark.createDataFrame(facts, schema), "c")
    want = sorted((s[3], f[3]) for s in segments for f in facts if s[0] == f[0] and f[2] > f[1] and f[1] <= s[1] < f[2] and f[2] >= s[2])
    assert sorted((r.id, r.f_id) for r in got.collect()) == want and want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert intervals.stab_join(spark.createDataFrame(segments, schema), spark.createDataFrame([], schema), "c").count() == 0


def test_a_fact_of_a_year_has_few_cells(spark):
    rows = [(0, 1), (0, 10**9), (5, DAY), (7, YEAR), (-YEAR, 50 * YEAR), (-intervals.END_OF_TIME, intervals.END_OF_TIME)]
    cells = intervals._in_cells(spark.createDataFrame(rows, "f_start_ns long, f_end_ns long")).groupBy("f_start_ns", "f_end_ns").count().collect()
    assert len(cells) == len(rows) and all(r["count"] <= 33 for r in cells)


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_subtraction_of_as_many_windows_as_intervals(spark, n):
    rng = random.Random(n)
    a, windows = _spans(rng, 200, 9 * DAY), [(s, e) for _, s, e, _ in _spans(rng, n, 30 * DAY)]
    frame, w = spark.createDataFrame(a, "c string, start_ns long, end_ns long, id long"), spark.createDataFrame(windows, "start_ns long, end_ns long")
    want = []
    for c, s, e, i in a:
        left = [(s, e)] if e > s else []
        for ws, we in windows:
            if we > ws:
                left = [p for x, y in left for p in ((x, min(y, ws)), (max(x, we), y)) if p[0] < p[1] and x <= p[0] and p[1] <= y] if any(ws < y and we > x for x, y in left) else left
        want += [(c, x, y, i) for x, y in _merged(left)]
    got = intervals.subtract(frame, w)
    assert sorted(tuple(r[c] for c in ("c", "start_ns", "end_ns", "id")) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    held = intervals.outside(frame, "start_ns", w)
    assert sorted(r.id for r in held.collect()) == sorted(i for _, s, _, i in a if not any(ws <= s < we for ws, we in windows))
    assert "NestedLoop" not in held._jdf.queryExecution().executedPlan().toString()


def _merged(parts):
    out = []
    for s, e in sorted(set(parts)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def test_runs_and_merged_intervals(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice([0, 0, 0, 3600 * 10**9])
        end = at + rng.randrange(1, 20) * 3600 * 10**9
        rows.append(("a" if i % 2 else "b", at, end, rng.random() < 0.7))
        at = end
    df = spark.createDataFrame(rows, "c string, start_ns long, end_ns long, bad boolean")
    for key in ("a", "b"):
        best = run = 0
        last = None
        for _, s, e, bad in sorted(r for r in rows if r[0] == key):
            run = (run if last == s else 0) + e - s if bad else 0
            last = e if bad else None
            best = max(best, run)
        assert intervals.longest_run(df.where(F.col("c") == key), "c", F.col("bad")).first().longest_ns == best
    mixed = _spans(rng, 300, 3 * DAY)
    got = intervals.merge_touching(spark.createDataFrame(mixed, "c string, start_ns long, end_ns long, id long"), "c")
    assert sorted(map(tuple, got.collect())) == sorted((c, s, e) for c in ("a", "b") for s, e in _merged([x[1:3] for x in mixed if x[0] == c]))
