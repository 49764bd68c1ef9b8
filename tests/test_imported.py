"""Release of rows through tables: late rows, restarts and replays."""

import datetime as dt
import random

import pytest
from tidemark.sources.paths import work_dir
from tidemark.streaming import jobs

ROWS = "collector_id string, bucket_id string, source_time_ns long, source_event_id long, end_ns long, seen_ts timestamp_ltz, payload string"
S, HOUR, START = 10**9, 3600, 1_700_000_000


def _row(collector, bucket, begin, number, end, seen):
    return (collector, bucket, begin * S, number, end * S, dt.datetime.fromtimestamp(seen, dt.UTC), f"payload {number}")


def _plain(batches):
    """Ids given out, positions and ids refused; the cutoff of a micro-batch is that of the rows seen up to it."""
    bucket, kept, at, given, wrong, seen = {}, {}, {}, [], [], 0
    for batch in batches:
        seen = max(seen, *(r[5].timestamp() for r in batch))
        for r in sorted(batch, key=lambda r: (r[2], r[3])):
            if bucket.setdefault(r[0], r[1]) != r[1]:
                wrong.append(r[3])
            else:
                kept.setdefault(r[0], []).append(r)
        for c, held in kept.items():
            held.sort(key=lambda r: (r[2], r[3]))
            while held and held[0][4] < (seen - HOUR) * S:
                r = held.pop(0)
                given.append(r[3])
                at[c] = max(at.get(c, (0, 0)), r[2:4])
    return sorted(given), at, sorted(wrong)


def _land(spark, rows, path):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def _run(spark, src, out, start=jobs.imported):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(src)
    query = start(stream, "seen_ts", "1 hour", f"{out}/rows", f"{out}/positions", f"{out}/checkpoint")
    query.awaitTermination()
    return query


def _result(spark, out):
    rows = sorted(r.source_event_id for r in spark.read.parquet(f"{out}/rows/rows").collect())
    at = {r.collector_id: (r.source_time_ns, r.source_event_id) for r in jobs.positions(spark, f"{out}/positions").collect() if r.source_time_ns is not None}
    return rows, at, sorted(r.source_event_id for r in spark.read.parquet(f"{out}/rows/all").where("kind = 'error'").collect())


def _copies():
    """Four micro-batches of the same ten hours, as in a table that is repeated with shifted ids: all but the first come late."""
    return [[_row(f"c{i % 2}", "b", START + 60 * i, 1000 * b + i, START + 60 * i + 90, START + 60 * i + 400) for i in range(600)] for b in range(4)]


def test_rows_that_come_late_are_given_out(spark):
    src, out = work_dir(spark, "in"), work_dir(spark, "out")
    for batch in _copies():
        _land(spark, batch, src)
    query = _run(spark, src, out)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2400
    given, at, wrong = _result(spark, out)
    cutoff = START + 60 * 599 + 400 - HOUR
    assert given == sorted(r[3] for b in _copies() for r in b if r[4] < cutoff * S) and len(given) > 2000
    assert (given, at, wrong) == _plain(_copies())


def test_a_stream_of_released_rows_has_those_that_come_late(spark):
    src, out = work_dir(spark, "in"), work_dir(spark, "out")
    for batch in _copies():
        _land(spark, batch, src)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(src)
    with jobs.rocksdb(spark):
        given = jobs.released(stream, "seen_ts", "1 hour").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    given.awaitTermination()
    assert sorted(r.source_event_id for r in spark.read.parquet(f"{out}/rows").where("kind = 'row'").collect()) == _plain(_copies())[0]


def test_restarts_and_a_replay_give_what_a_plain_run_gives(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        seen = START + 60 * (i if rng.random() < 0.8 else max(0, i - 150))  # some are seen late
        begin = seen - rng.choice([0, 30, 600, 5000])
        collector = None if i % 5 == 4 else f"c{i % 5}"
        bucket = None if i % 5 == 3 else "other" if i % 5 == 2 and i > 150 and i % 2 else "b"
        rows.append(_row(collector, bucket, begin, i, begin + rng.choice([1, 60, 4000]), seen))
    rows = [r for r in rows if r[0] != "c1" or r[3] > 200]  # one collector comes later
    batches = [[r for r in rows if r[3] // 50 == i] for i in range(6)]
    src, out = work_dir(spark, "in"), work_dir(spark, "out")
    for half in (batches[:3], batches[3:]):
        for batch in half:
            _land(spark, batch, src)
        _run(spark, src, out)
    want = _plain(batches)
    assert _result(spark, out) == want and len(want[0]) > 100 and want[2] and None in want[1]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert system.delete(path(f"{out}/checkpoint/commits/5"), False)  # as if the last micro-batch had been cut off at its end
    _run(spark, src, out)
    assert _result(spark, out) == want
    assert [system.exists(path(f"{out}/rows/held/batch={n}")) for n in range(6)] == [False] * 4 + [True] * 2


def test_state_that_is_missing_is_an_error(spark):
    src, out = work_dir(spark, "in"), work_dir(spark, "out")
    _land(spark, [_row("c", "b", START, 1, START + 1, START)], src)
    _run(spark, src, out)
    jobs.removed(spark, f"{out}/rows/held")
    _land(spark, [_row("c", "b", START + 1, 2, START + 2, START + 1)], src)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        _run(spark, src, out)
