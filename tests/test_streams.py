"""Streaming jobs that keep state by key: outcomes, releases and checkpoints equal a batch, also over restarts."""

import random
import time

from pyspark.sql import functions as F
from tidemark.operators.facts import resolve_idempotent
from tidemark.sources.paths import work_dir
from tidemark.streaming import jobs

CANDIDATES = "id long, collector_id string, idempotency_key string, content_hash string, error_code string"


def _land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_of_twenty_batches_equals_the_batch_and_reads_only_its_own_keys(spark):
    rng = random.Random(3)
    rows = [(i, f"c{rng.randrange(3)}", f"k{rng.randrange(300)}", f"h{rng.randrange(2)}", "EVENT_JSON_INVALID" if rng.random() < 0.1 else None) for i in range(400)]
    rows += [(400 + i, None, None, None, "EVENT_JSON_INVALID") for i in range(5)]
    known = [(9000 + i, "c0", f"k{i}", "h0", None) for i in range(40)]
    existing = spark.createDataFrame(known, CANDIDATES).drop("error_code")
    src, out = work_dir(spark, "in"), work_dir(spark, "out")
    numbers = []
    for part in range(2):  # the second half comes after a restart
        for i in range(part * 10, part * 10 + 10):
            _land(spark, [r for r in rows if r[0] // 21 == i], CANDIDATES, src)
        query = jobs.ingest(_stream(spark, CANDIDATES, src), f"{out}/facts", f"{out}/results", f"{out}/checkpoint", existing=existing)
        query.awaitTermination()
        numbers += [(p["numInputRows"], p["stateOperators"][0]["customMetrics"]["rocksdbGetCount"], p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["numInputRows"]]
    got = spark.read.parquet(f"{out}/results").select("id", "status", "fact_id", "error_code")
    want = resolve_idempotent(spark.createDataFrame(rows, CANDIDATES), "id", existing).select("id", "status", "fact_id", "error_code")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(numbers) == 20 and all(gets <= 3 * n for n, gets, _ in numbers[1:])  # first: the existing facts too
    assert numbers[-1][2] > 200 > 63  # the state has many more keys than a batch touches
    facts = spark.read.parquet(f"{out}/facts")
    assert facts.count() == got.where("status = 'accepted'").count() == facts.select("collector_id", "idempotency_key").distinct().count()


def test_keys_of_a_bucket_share_a_value_of_the_state(spark):
    """2,000 keys in 16 buckets: outcomes are those of a batch, names with signs that JSON quotes too, and the state is read and written by bucket."""
    rng = random.Random(4)
    names = [f'k"\\{i}é' for i in range(2000)]
    rows = [(i, f"c{i % 2}", names[i % 2000] if i < 2400 else rng.choice(names), f"h{rng.randrange(2)}", None) for i in range(3000)]
    known = spark.createDataFrame([(90000 + i, "c1", names[2 * i + 1], "h0" if i % 3 else None, None) for i in range(50)], CANDIDATES).drop("error_code")
    src, out = work_dir(spark, "in"), work_dir(spark, "out")
    numbers = []
    for part in range(2):
        _land(spark, rows[part * 1500 : part * 1500 + 1500], CANDIDATES, src)
        with jobs.rocksdb(spark):
            outcomes = jobs.outcomes(_stream(spark, CANDIDATES, src), existing=known, buckets=16)
            query = outcomes.writeStream.format("parquet").option("path", f"{out}/results").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        numbers += [(p["stateOperators"][0]["customMetrics"]["rocksdbPutCount"], p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["numInputRows"]]
    got = spark.read.parquet(f"{out}/results").select("id", "status", "fact_id", "error_code")
    want = resolve_idempotent(spark.createDataFrame(rows, CANDIDATES), "id", known).select("id", "status", "fact_id", "error_code")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(numbers) == 2 and all(puts <= 64 and total == 16 for puts, total in numbers)


ROWS = "collector_id string, bucket_id string, source_time_ns long, source_event_id long, end_ns long, seen_ts timestamp_ltz, payload string"
S, HOUR = 10**9, 3600


def _plain(rows, batches):
    """Rows given out, positions and refused rows, one micro-batch after the other."""
    bucket, kept, at, given, errors = {}, {}, {}, [], []
    cutoffs = [max(r[5].timestamp() for b in batches[: i + 1] for r in b) - HOUR for i in range(len(batches))]
    for i, batch in enumerate([*batches, []]):
        for r in sorted(batch, key=lambda r: (r[2], r[3])):
            if bucket.setdefault(r[0], r[1]) != r[1]:
                errors.append(r[3])
            else:
                kept.setdefault(r[0], []).append(r)
        cutoff = (cutoffs[i - 1] if i else 0) * S  # the watermark is that of the batches before
        for c, held in kept.items():
            held.sort(key=lambda r: (r[2], r[3]))
            while held and held[0][4] < cutoff:
                r = held.pop(0)
                given.append(r[3])
                at[c] = max(at.get(c, (0, 0)), r[2:4])
    return sorted(given), at, sorted(errors), {c: min((r[2:4] for r in held), default=None) for c, held in kept.items()}


def test_released_rows_and_checkpoints_follow_each_other_with_late_rows_between(spark):
    import datetime as dt

    rng, start = random.Random(5), 1_700_000_000
    rows = []
    for i in range(240):
        seen = start + 60 * i
        begin = seen - rng.choice([0, 30, 600, 5000])  # some come long after they began
        rows.append((f"c{i % 3}", "other" if i % 3 == 2 and i > 150 and i % 2 else "b", begin * S, i, (begin + rng.choice([1, 60, 4000])) * S, dt.datetime.fromtimestamp(seen, dt.UTC), f"payload {i}"))
    batches = [rows[i : i + 30] for i in range(0, 240, 30)]
    src, out = work_dir(spark, "in"), work_dir(spark, "out")
    for half in (batches[:4], batches[4:]):  # with a restart between
        for b in half:
            _land(spark, b, ROWS, src)
        jobs.imported(_stream(spark, ROWS, src), "seen_ts", "1 hour", f"{out}/rows", f"{out}/positions", f"{out}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{out}/rows/rows").collect()
    given, at, errors, _ = _plain(rows, batches)
    assert sorted(r.source_event_id for r in got) == given and len(given) > 100
    assert all(r.payload == f"payload {r.source_event_id}" for r in got)
    positions = {r.collector_id: r for r in jobs.positions(spark, f"{out}/positions").collect()}
    assert {c: (r.source_time_ns, r.source_event_id) for c, r in positions.items()} == at
    assert [positions[c].error for c in ("c0", "c1", "c2")] == [None, None, "ACTIVITY_BUCKET_CHANGED"] and errors
    refused = spark.read.parquet(f"{out}/rows/all").where("kind = 'error'")
    assert sorted(r.source_event_id for r in refused.collect()) == errors


def test_timers_of_a_running_stream_outlive_a_restart(spark):
    src, out = work_dir(spark, "in"), work_dir(spark, "out")

    def started():
        stream = spark.readStream.schema("collector_id string").parquet(src)
        with jobs.rocksdb(spark):
            states = jobs.liveness(stream, 1500, 3000, 9000).withColumn("at", F.current_timestamp())
            return states.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/data/batch={n}")).option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="500 milliseconds").start()

    def awaited(query, state, seconds=60):
        end = time.time() + seconds
        while time.time() < end and query.exception() is None:
            try:
                if spark.read.schema("collector_id string, state string, at timestamp").parquet(f"{out}/data").where(F.col("state") == state).count():
                    return
            except Exception:  # no batch is there yet
                pass
            time.sleep(0.3)
        raise AssertionError(f"{state} did not come: {query.exception()}")

    _land(spark, [("c",)], "collector_id string", src)
    query = started()
    awaited(query, "missing")
    query.stop()
    query = started()  # delayed and offline are due after the restart, by timers set before it
    awaited(query, "offline")
    query.stop()
    rows = spark.read.parquet(f"{out}/data").orderBy("batch", "at").collect()
    assert [r.state for r in rows] == ["live", "missing", "delayed", "offline"]
