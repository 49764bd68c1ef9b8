"""The strongest fact at each instant, by a sweep over time: what is open is carried along, so facts that overlap never meet in pairs."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import CELL_BITS, _level

STRETCH = "start_ns long, end_ns long, priority int, stable_id string, availability string, reason_code string, quality_flags array<string>"


@lru_cache(4096)
def _listed(text: str | None) -> tuple:
    return tuple(json.loads(text)) if text else ()


@lru_cache(4096)
def _sorted(flags: tuple) -> list:
    return sorted(flags, key=lambda f: (f is None, f or ""))


def stretches(rows: Iterable[tuple], named: bool) -> Iterator[tuple]:
    """(key, start, end, priority, id, state, flags) for rows of the same form in the order of key and start.

    A stretch has one strongest row (of highest priority, then of least id) and one set of flags, those of all open rows;
    neighbours with the same strongest row, or, if not ``named``, with the same state, are one.  Kept are open rows only.
    """
    key, at, most, last = None, 0, 64, None
    heap: list[tuple] = []  # (-priority, id, end, number, state); those that are over go when they come to the top
    until: dict = {}  # of each flag, the last end of the rows so far
    number = 0
    for new, start, end, priority, name, state, flags in _with_end(rows):
        stop = start if new == key else None
        while heap and (stop is None or at < stop):
            if heap[0][2] <= at:
                heapq.heappop(heap)
                continue
            top = heap[0]
            if any(e <= at for e in until.values()):
                until = {f: e for f, e in until.items() if e > at}
            to = min(top[2], *until.values()) if until else top[2]
            to = to if stop is None else min(to, stop)
            what = (top[4], tuple(until)) if not named else (top[4], tuple(until), top[:2])
            if last is not None and last[1] == at and last[2] == what:
                last[1] = to
            else:
                if last is not None:
                    yield _made(key, *last)
                last = [at, to, what, top[:2]]
            at = to
        if new != key:
            if last is not None:
                yield _made(key, *last)
            key, last, heap, until, most = new, None, [], {}, 64
        at = start
        if not (heap and heap[0][:2] <= (-priority, name) and heap[0][2] >= end):  # else it is hidden as long as it lasts
            number += 1
            heapq.heappush(heap, (-priority, name, end, number, state))
            if len(heap) > most:
                heap = [x for x in heap if x[2] > at]
                heapq.heapify(heap)
                most = max(64, 2 * len(heap))
        for f in flags:
            if until.get(f, at) < end:
                until[f] = end


def _with_end(rows: Iterable[tuple]) -> Iterator[tuple]:
    yield from rows
    yield None, 0, 0, 0, "", None, ()


def _made(key: tuple, start: int, end: int, what: tuple, rank: tuple) -> tuple:
    return (key[0], start, end, -rank[0], rank[1], *what[0], _sorted(what[1]))


def _swept(df: DataFrame, by: str, level: str, named: bool) -> DataFrame:
    """Stretches of df in cells of the width of its level; each cell is one after another in a task."""
    width = f"({CELL_BITS} + {level})"
    cells = df.withColumn("_level", F.expr(level)).withColumn("_cell", F.explode(F.expr(f"sequence(shiftright(start_ns, {width}), shiftright(end_ns - 1, {width}))")))
    begin, end = F.expr(f"shiftleft(_cell, {width})"), F.expr(f"shiftleft(_cell + 1, {width})")
    cells = cells.select(by, "_level", "_cell", F.greatest("start_ns", begin).alias("start_ns"), F.least("end_ns", end).alias("end_ns"), F.col("priority").cast("int").alias("priority"), F.coalesce("stable_id", F.lit("")).alias("stable_id"), "availability", "reason_code", F.to_json("quality_flags").alias("flags"))

    def sweep(batches):
        import pyarrow as pa

        kinds = pa.schema([("by", pa.string()), ("start_ns", pa.int64()), ("end_ns", pa.int64()), ("priority", pa.int32()), ("stable_id", pa.string()), ("availability", pa.string()), ("reason_code", pa.string()), ("quality_flags", pa.list_(pa.string()))])

        def rows():
            for batch in batches:
                for k, lv, cell, start, end, priority, name, availability, reason, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield (k, lv, cell), start, end, priority, name, (availability, reason), _listed(flags)

        out = []
        for x in stretches(rows(), named):
            out.append(x)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], names=kinds.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], names=kinds.names)

    dealt = cells.repartition(by, "_level", "_cell").sortWithinPartitions(by, "_level", "_cell", "start_ns")
    return dealt.mapInArrow(sweep, f"by string, {STRETCH}").withColumnRenamed("by", by)


def strongest(facts: DataFrame, by: str) -> DataFrame:
    """(by, start_ns, end_ns, availability, reason_code, quality_flags) of what facts (by, and STRETCH) cover, in stretches that do not overlap.

    The fact of highest priority decides, then that of least stable_id; flags add up.  A fact is in 33 cells of time at
    most: long facts are swept in wide cells first, and what is left of them, which no longer overlaps, goes
    with the short ones.  The order of facts' starts is all that is sorted, so the cost is that of the facts, however many
    overlap.  Stretches that meet at the edge of a cell may be in the same state.
    """
    names = [by, *(c.split()[0] for c in STRETCH.split(", "))]
    facts = facts.select(names).where("end_ns > start_ns")
    level = _level("start_ns", "end_ns")
    long = facts.withColumn("_own", level).where("_own > 0")
    left = _swept(long, by, "_own", named=True).select(names)
    return _swept(facts.where(level == 0).unionByName(left), by, "0", named=False).drop("priority", "stable_id")
