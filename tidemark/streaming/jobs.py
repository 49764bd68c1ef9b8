"""Structured Streaming: continuous idempotent ingest, checkpoints, revisions, lateness and liveness."""

from __future__ import annotations

import json
import pickle
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.activity import advance_checkpoint
from ..sources.paths import removed, table_at


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which transformWithState needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Buckets of keys; as the state is kept by them, their number stays for the life of a query's checkpoint.
BUCKETS = 1 << 16


class FirstOfKey(StatefulProcessor):
    """For each key of a bucket the id and hash of its first valid row, for ever; gives out each row's outcome.

    A call into the state store takes a Python worker far longer than a row does, so a bucket's keys are one value, the text of a JSON
    array of [collector_id, idempotency_key, id, content_hash]; a micro-batch has at most one call each way for a bucket.
    It reads and writes the buckets of its own keys only, whatever the number of facts.
    """

    def __init__(self, order: str, conflict: str):
        self.order, self.conflict = order, conflict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "facts string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.first.update((initialState.facts,))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        held = self.first.get()
        known = {(collector, name): (int(number), content) for collector, name, number, content in json.loads(held[0])} if held else {}
        before, out = len(known), Row(*CANDIDATE, "status", "fact_id", "error_code")
        for row in sorted(rows, key=lambda r: r[self.order]):
            first = known.get((row.collector_id, row.idempotency_key))
            if first is None:
                first = known[row.collector_id, row.idempotency_key] = (row.id, row.content_hash)
                status = "accepted"
            else:
                status = "duplicate" if row.content_hash == first[1] else "conflict"
            yield out(row.id, row.collector_id, row.idempotency_key, row.content_hash, status, first[0], self.conflict if status == "conflict" else None)
        if len(known) > before:
            self.first.update((json.dumps([(*k, *v) for k, v in known.items()], ensure_ascii=False, separators=(",", ":")),))

    def close(self) -> None:
        pass


CANDIDATE = ("id", "collector_id", "idempotency_key", "content_hash")
OUTCOME = "id long, collector_id string, idempotency_key string, content_hash string, status string, fact_id long, error_code string"


def outcomes(stream: DataFrame, order: str = "id", existing: DataFrame | None = None, conflict: str = "EVENT_IDEMPOTENCY_CONFLICT", buckets: int = BUCKETS) -> DataFrame:
    """OUTCOME of each row of a stream (CANDIDATE, error_code, order): what resolve_idempotent says of the same rows in a batch.

    Rows with an error code are rejected and touch no state.  Among rows of a micro-batch the least ``order`` is
    first; earlier micro-batches, and before them ``existing`` facts (collector_id, idempotency_key, id, content_hash;
    one row a key, looked at when the query starts for the first time), come before.  State is kept by bucket of keys (see FirstOfKey).
    Needs the RocksDB state store.
    """
    valid = stream.where("error_code is null").select(*CANDIDATE, *([] if order in CANDIDATE else [order]))
    bucket = F.pmod(F.xxhash64("collector_id", "idempotency_key"), F.lit(buckets)).alias("_bucket")
    start = None
    if existing is not None:
        fact = F.array(F.col("collector_id"), F.col("idempotency_key"), F.col("id").cast("string"), F.col("content_hash"))
        start = existing.select(bucket, fact.alias("_fact")).groupBy("_bucket").agg(F.to_json(F.collect_list("_fact")).alias("facts")).groupBy("_bucket")
    valid = valid.withColumn("id", F.col("id").cast("long")).select("*", bucket).groupBy("_bucket")
    resolved = valid.transformWithState(FirstOfKey(order, conflict), OUTCOME, "Append", "None", start)
    bad = stream.where("error_code is not null").select(F.col("id").cast("long").alias("id"), *CANDIDATE[1:], F.lit("rejected").alias("status"), F.lit(None).cast("long").alias("fact_id"), "error_code")
    return resolved.unionByName(bad)


def ingest(stream: DataFrame, facts_path: str, results_path: str, checkpoint: str, order: str = "id", existing: DataFrame | None = None):
    """Start a query that appends accepted candidates to facts and every outcome to results (see outcomes).

    Each micro-batch goes to folders of its own number, overwritten if the batch is replayed: outcomes first, then
    the facts among them, read back from what was written.
    """

    def batch(df: DataFrame, number: int) -> None:
        at = f"{results_path}/batch={number}"
        df.write.mode("overwrite").parquet(at)
        facts = df.sparkSession.read.schema(OUTCOME).parquet(at).where("status = 'accepted'")
        facts.select(*CANDIDATE).write.mode("overwrite").parquet(f"{facts_path}/batch={number}")

    with rocksdb(stream.sparkSession):
        return outcomes(stream, order, existing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpointed(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the furthest position of each collector, as generations of a small table."""
    schema = "collector_id string, bucket_id string, source_time_ns long, source_event_id long, error string"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        old = table_at(spark, path, f"{schema}, batch long")
        old = old.where(F.col("batch") == number - 1) if number else old.where("false")
        advance_checkpoint(old, df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows of a collector that a worker holds at once.
CHUNK = 1000


class Release(StatefulProcessor):
    """Of each collector the rows that may still change, in list state, and its checkpoint: both move together.

    Rows have a position (source_time_ns, source_event_id).  Those before the first one, by position, that ends at the
    watermark or later are given out, in no order, and the checkpoint becomes the position of the last of them, so it never
    passes a row that is kept back.  One timer waits for the end of the first kept row.  Which row that is shows when all have
    been seen, so a call's rows go through a file of its task, and a worker holds CHUNK of them only.
    """

    def __init__(self, schema: StructType):
        self.schema, self.names = schema, schema.names
        self.time, self.event, self.end, self.bucket = (schema.names.index(c) for c in ("source_time_ns", "source_event_id", "end_ns", "bucket_id"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.schema)
        self.at = handle.getValueState("checkpoint", "bucket_id string, source_time_ns long, source_event_id long")

    def _place(self, row: tuple) -> tuple[int, int]:
        return row[self.time], row[self.event]

    def _given(self, key, rows: Iterator, cutoff_ns: int) -> Iterator:
        at, out = self.at.get(), Row("kind", "error", *self.names)
        least, firsts = None, {}  # the first row; of each bucket the first one that ends at the cutoff or later
        with tempfile.TemporaryFile() as file:
            came, size = chain(self.kept.get(), rows), 0
            while chunk := [tuple(row) for row in islice(came, CHUNK)]:
                for row in chunk:
                    place = self._place(row)
                    if least is None or place < least[0]:
                        least = (place, row[self.bucket])
                    if row[self.end] >= cutoff_ns and (at is None or row[self.bucket] == at[0]):
                        firsts[row[self.bucket]] = min((*place, row[self.end]), firsts.get(row[self.bucket], (*place, row[self.end])))
                pickle.dump(chunk, file)
                size += 1
            self.kept.clear()
            if at is None:
                at = (least[1], None, None)
                self.at.update(at)
            bucket, last, first = at[0], None, firsts.get(at[0])
            file.seek(0)
            for _ in range(size):
                chunk = []
                for row in pickle.load(file):
                    if row[self.bucket] != bucket:
                        yield out("error", "ACTIVITY_BUCKET_CHANGED", *row)
                    elif first is None or self._place(row) < first[:2]:
                        last = self._place(row) if last is None else max(last, self._place(row))
                        yield out("row", None, *row)
                    else:
                        chunk.append(row)
                if chunk:
                    self.kept.appendList(chunk)
        if last is not None:
            now = (bucket, *(max(last, at[1:]) if at[1] is not None else last))
            self.at.update(now)
            values = {"collector_id": key[0], "bucket_id": bucket, "source_time_ns": now[1], "source_event_id": now[2]}
            yield out("checkpoint", None, *(values.get(c) for c in self.names))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if first is not None:
            self.handle.registerTimer(first[2] // 1_000_000 + 1)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        yield from self._given(key, rows, timerValues.getCurrentWatermarkInMs() * 1_000_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._given(key, iter(()), timerValues.getCurrentWatermarkInMs() * 1_000_000)

    def close(self) -> None:
        pass


def released(stream: DataFrame, seen_ts: str, lateness: str) -> DataFrame:
    """Rows of a stream that no longer change, and checkpoints that follow them: stream's columns after ``kind`` and ``error``.

    stream: collector_id, bucket_id, source_time_ns, source_event_id, end_ns, ``seen_ts`` (when the row was read) and
    anything else.  The cutoff is the watermark, the latest seen_ts less the lateness; rows that come late are not
    dropped, as they were seen late too.  kind is row, checkpoint (only its position is filled) or error: a row of
    another bucket than its collector began with, which is not given out and moves nothing.  Positions and ends are not
    null.  Needs the RocksDB state store.
    """
    schema = StructType([StructField(f.name, f.dataType) for f in stream.schema])  # without metadata, all nullable
    out = StructType([StructField("kind", StringType()), StructField("error", StringType()), *schema])
    # by the mark that withWatermark leaves on its column, Spark would leave out rows that come late; the alias takes it off
    rows = stream.withWatermark(seen_ts, lateness).withColumn(seen_ts, F.col(seen_ts).alias(seen_ts, metadata={"clock": True}))
    return rows.groupBy("collector_id").transformWithState(Release(schema), out, "Append", "EventTime")


def _held(spark: SparkSession, path: str, schema: StructType | str, number: int, what: str) -> DataFrame:
    """What the micro-batch before this one has left; none before the first, and an error if its folder is missing."""
    return spark.read.schema(schema).parquet(f"{path}/batch={number - 1}/{what}") if number else spark.createDataFrame([], schema)


def _limits(rows: DataFrame, before: DataFrame, cutoff_ns: int) -> DataFrame:
    """(collector_id, bucket_id, at, first) of all collectors so far: the bucket is that of the first row of a collector's first micro-batch,
    at is its checkpoint, and first the place of the bucket's first row that ends at the cutoff or later."""
    place = F.struct("source_time_ns", "source_event_id")
    groups = rows.groupBy("collector_id", "bucket_id").agg(F.min(place).alias("_least"), F.min(F.when(F.col("end_ns") >= cutoff_ns, place)).alias("_first"))
    known = before.select(F.col("collector_id").alias("_c"), F.col("bucket_id").alias("_own"), F.col("at").alias("_at"), F.lit(True).alias("_known"))
    both = groups.join(known, F.col("collector_id").eqNullSafe(F.col("_c")), "full_outer").withColumn("collector_id", F.coalesce("collector_id", "_c"))
    begun = F.min(F.struct("_least", "bucket_id", "_first"))
    of_own = F.min(F.when(F.col("bucket_id").eqNullSafe(F.col("_own")), F.col("_first")))
    out = both.groupBy("collector_id").agg(begun.alias("_b"), of_own.alias("_f"), F.max("_own").alias("_own"), F.max("_at").alias("at"), F.max("_known").alias("_known"))
    return out.select("collector_id", F.when(F.col("_known"), F.col("_own")).otherwise(F.col("_b.bucket_id")).alias("bucket_id"), "at", F.when(F.col("_known"), F.col("_f")).otherwise(F.col("_b._first")).alias("first"))


def imported(stream: DataFrame, seen_ts: str, lateness: str, rows_path: str, positions_path: str, checkpoint: str):
    """Start a query that writes the rows that no longer change, and after them the checkpoints, by number of micro-batch.

    stream is that of released, and so are the rows: a collector's rows before the first one, by position, that ends at the cutoff or later.
    The cutoff is the latest seen_ts so far, this micro-batch's too, less the lateness; rows that come late are rows like others.
    Nothing goes through Python, and a collector's rows are dealt over all tasks.  Below rows_path, rows has what is
    released, all/batch=../kind=error the rows of another bucket than their collector's, and held/batch=.. what the next micro-batch begins
    with: rows kept back, and of each collector its bucket and checkpoint.  A micro-batch reads what the one before has left and
    overwrites its own folders, so one that is replayed writes the same.
    """
    names = ["collector_id", "bucket_id", "source_time_ns", "source_event_id", "error"]
    columns, schema = stream.columns, StructType([StructField(f.name, f.dataType) for f in stream.schema])
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    at = f"struct<source_time_ns: {kinds['source_time_ns']}, source_event_id: {kinds['source_event_id']}>"
    limit = f"collector_id {kinds['collector_id']}, bucket_id {kinds['bucket_id']}, at {at}, first {at}"
    state = f"collector_id {kinds['collector_id']}, bucket_id {kinds['bucket_id']}, at {at}, clock_ms long"
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    wait_ms = stream.sparkSession.range(1).select(F.expr(f"timestampdiff(MILLISECOND, {epoch}, {epoch} + INTERVAL '{lateness}')")).first()[0]

    def batch(df: DataFrame, number: int) -> None:
        spark, held = df.sparkSession, f"{rows_path}/held"
        own = f"{held}/batch={number}"
        removed(spark, f"{held}/batch={number - 2}")  # the one before is whole, so a replay does not go back behind it

        def written(out: DataFrame, path: str, schema: StructType | str) -> DataFrame:
            out.write.mode("overwrite").parquet(path)
            return spark.read.schema(schema).parquet(path)

        came = written(df, f"{own}/came", schema)  # the stream's own plan runs once
        before = _held(spark, held, state, number, "collectors")
        seen = came.select(F.unix_millis(seen_ts).alias("clock_ms")).unionByName(before.select("clock_ms"))
        clock_ms = seen.agg(F.max("clock_ms")).first()[0] or 0
        rows = _held(spark, held, schema, number, "kept").unionByName(came)
        limits = written(_limits(rows, before, max(0, clock_ms - wait_ms) * 1_000_000), f"{own}/limits", limit)
        to = limits.select(F.col("collector_id").alias("_c"), F.col("bucket_id").alias("_own"), F.col("first").alias("_first"))
        rows = rows.join(to, F.col("collector_id").eqNullSafe(F.col("_c")))
        same = F.col("bucket_id").eqNullSafe(F.col("_own"))
        stable = F.col("_first").isNull() | (F.struct("source_time_ns", "source_event_id") < F.col("_first"))
        given = written(rows.where(same & stable).select(columns), f"{rows_path}/rows/batch={number}", schema)
        rows.where(same & ~stable).select(columns).write.mode("overwrite").parquet(f"{own}/kept")
        wrong = rows.where(~same).select(F.lit("ACTIVITY_BUCKET_CHANGED").alias("error"), *columns)
        wrong = written(wrong, f"{rows_path}/all/batch={number}/kind=error", StructType([StructField("error", StringType()), *schema]))
        last = given.groupBy(F.col("collector_id").alias("_c")).agg(F.max(F.struct("source_time_ns", "source_event_id")).alias("_last"))
        now = limits.join(last, F.col("collector_id").eqNullSafe(F.col("_c")), "left").withColumn("at", F.greatest("at", "_last"))
        now.select("collector_id", "bucket_id", "at", F.lit(clock_ms).cast("long").alias("clock_ms")).write.mode("overwrite").parquet(f"{own}/collectors")
        moved = now.where("_last is not null").select(F.lit("checkpoint").alias("kind"), "collector_id", "bucket_id", "at.source_time_ns", "at.source_event_id", F.lit(None).cast("string").alias("error"))
        moved.unionByName(wrong.select(F.lit("error").alias("kind"), *names)).write.mode("overwrite").parquet(f"{positions_path}/batch={number}")

    return stream.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(collector_id, bucket_id, source_time_ns, source_event_id, error) that imported has written: the furthest, and whether the bucket changed."""
    at = F.struct("source_time_ns", "source_event_id", "bucket_id")
    given = spark.read.parquet(path)
    out = given.groupBy("collector_id").agg(F.max(F.when(F.col("kind") == "checkpoint", at)).alias("at"), F.max("error").alias("error"))
    return out.select("collector_id", "at.bucket_id", "at.source_time_ns", "at.source_event_id", "error")


def fair_scans(ticks: DataFrame, listing: Callable[[], DataFrame], key: str, n: int, path: str, checkpoint: str):
    """Start a query that picks, in each micro-batch of ticks, the n next keys of a listing, and goes on from there in the next.

    Picks go to ``picked``, then the last of them to ``cursor``, by number of micro-batch; a batch begins at the cursor of the
    one before, so a replayed one picks the same keys of the same listing.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        found = table_at(spark, f"{path}/cursor", f"{key} string, batch long").where(F.col("batch") == number - 1).first()
        # behind the cursor, then from the beginning: a flag before the key
        turn = F.lit(0) if found is None else (F.col(key) <= found[key]).cast("int")
        picked = listing().select(key, turn.alias("_turn")).orderBy("_turn", key).limit(n)
        picked.write.mode("overwrite").parquet(f"{path}/scans/batch={number}")
        picked = spark.read.schema(f"{key} string, _turn int").parquet(f"{path}/scans/batch={number}")
        picked.select(key).write.mode("overwrite").parquet(f"{path}/picked/batch={number}")
        last = picked.agg(F.max(F.struct("_turn", key))[key].alias(key)).select(F.coalesce(F.col(key), F.lit(found and found[key])).alias(key))
        last.coalesce(1).write.mode("overwrite").parquet(f"{path}/cursor/batch={number}")

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Revisions(StatefulProcessor):
    """For each key the longest duration so far; gives out base, revision, duplicate or error for each row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.longest = handle.getValueState("longest", "duration double, content string")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        found = pd.concat(list(rows)).sort_values("seq")
        now = self.longest.get() if self.longest.exists() else None
        out = []
        for seq, content, duration in zip(found["seq"], found["content"], found["duration"], strict=True):
            if now is None:
                status, now = "base", (duration, content)
            elif content != now[1] or duration < now[0]:
                status = "error"
            else:
                status = "revision" if duration > now[0] else "duplicate"
                now = (duration, content)
            out.append((key[0], key[1], seq, status))
        self.longest.update(now)
        yield pd.DataFrame(out, columns=["bucket_id", "id", "seq", "status"])

    def close(self) -> None:
        pass


def revisions(stream: DataFrame) -> DataFrame:
    """(bucket_id, id, seq, status) of a stream (bucket_id, id, seq, content, duration)."""
    return stream.groupBy("bucket_id", "id").transformWithStateInPandas(Revisions(), "bucket_id string, id long, seq long, status string", "Append", "None")


class Liveness(StatefulProcessor):
    """Keeps a collector's last evidence and three processing-time timers; gives out each change of state."""

    def __init__(self, period_ms: int, lateness_ms: int, offline_ms: int):
        self.waits = ((period_ms, "missing"), (period_ms + lateness_ms, "delayed"), (offline_ms, "offline"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((now,))
        for wait, _ in self.waits:
            self.handle.registerTimer(now + wait)
        yield pd.DataFrame({"collector_id": [key[0]], "state": ["live"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        waited = expiredTimerInfo.getExpiryTimeInMs() - self.last.get()[0]
        state = next((s for w, s in self.waits if w == waited), None)
        yield pd.DataFrame({"collector_id": [key[0]] if state else [], "state": [state] if state else []})

    def close(self) -> None:
        pass


def liveness(stream: DataFrame, period_ms: int, lateness_ms: int, offline_ms: int) -> DataFrame:
    """(collector_id, state) changes of a stream with collector_id; needs the RocksDB state store.

    A restarted query runs no micro-batch, and so looks at no timer, before it sees an offset move; so a source that
    ticks once a second, of which no row is kept, goes with the stream.
    """
    ticks = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0").select(F.col("value").cast("string").alias("collector_id"))
    keyed = stream.select("collector_id").unionByName(ticks).groupBy("collector_id")
    return keyed.transformWithStateInPandas(Liveness(period_ms, lateness_ms, offline_ms), "collector_id string, state string", "Update", "ProcessingTime")
