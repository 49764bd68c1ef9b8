"""Liveness on a stream: evidence makes a collector live; what follows depends on the clock and is not awaited."""

import pandas as pd
from tidemark.streaming.jobs import Liveness


class _State:
    def __init__(self):
        self.value = None

    def update(self, v):
        self.value = v

    def get(self):
        return self.value


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return _State()

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def test_states_follow_the_deadlines():
    handle, p = _Handle(), Liveness(60, 60, 300)
    p.init(handle)
    rows = iter([pd.DataFrame({"collector_id": ["c"]})])
    assert [d.values.tolist() for d in p.handleInputRows(("c",), rows, _Clock(1000))] == [[["c", "live"]]]
    assert handle.timers == [1060, 1120, 1300]
    seen = [d["state"].tolist() for t in handle.timers for d in p.handleExpiredTimer(("c",), _Clock(t), _Clock(t))]
    assert seen == [["missing"], ["delayed"], ["offline"]]
    list(p.handleInputRows(("c",), iter([]), _Clock(1100)))
    assert handle.timers == [1160, 1220, 1400]
    assert [len(d) for d in p.handleExpiredTimer(("c",), _Clock(1120), _Clock(1120))] == [0]
