"""Rows of one collector go through its processor without being held all at once."""

import tracemalloc

from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tidemark.streaming import jobs


class _List:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows = self.rows + list(rows)

    def clear(self):
        self.rows = []


class _Value:
    now = None

    def get(self):
        return self.now

    def update(self, now):
        self.now = now


class _Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, *_):
        return _List()

    def getValueState(self, *_):
        return _Value()

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)


class _Timer:
    def getCurrentWatermarkInMs(self):
        return 1_000_000


def test_rows_are_not_held():
    n = 40_000
    make = Row("collector_id", "bucket_id", "source_time_ns", "source_event_id", "end_ns")
    kinds = StructType([StructField(c, StringType() if i < 2 else LongType()) for i, c in enumerate(make)])
    release = jobs.Release(kinds)
    release.init(handle := _Handle())
    rows = (make("c", "b", n - i, i, 10**12 + 5 if i == 3 else 7) for i in range(n))  # the last positions come first
    tracemalloc.start()
    given = last = 0
    for out in release.handleInputRows(("c",), rows, _Timer()):
        given += out.kind == "row"
        last = out
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert given == n - 4 and (last.kind, last.source_time_ns, last.source_event_id) == ("checkpoint", n - 4, 4)
    assert sorted(r[3] for r in release.kept.get()) == [0, 1, 2, 3] and handle.timers == [10**6 + 1]
    assert peak < 4_000_000
