"""What the stream of bursts keeps per name, and how often it is woken."""

import numpy as np
import pandas as pd

from pagemill.streaming.processors import Bursts


class _State:
    def __init__(self):
        self.rows, self.timers, self.mark = [], [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.mark


def _writes(seconds, seq):
    ts = pd.to_datetime(np.array(seconds, "int64"), unit="s")
    return pd.DataFrame({"name": 1, "first": ts, "last": ts, "seq": seq, "n_writes": 1})


def test_many_open_bursts_need_one_timer():
    state, bursts = _State(), Bursts("500 milliseconds")
    bursts.init(state)
    n = 5000
    out = pd.concat(bursts.handleInputRows((1,), iter([_writes(range(n), range(n))]), state))
    assert len(out) == n and (out["n_writes"] == 1).all() and (out["name"] == 1).all()
    assert state.timers == [501]  # one timer per burst before
    assert len(state.rows) == 2  # one entry per burst before

    state.mark = 100_000  # bursts 0 to 99 ended before 99.5 s
    assert not list(bursts.handleExpiredTimer((1,), state, None))
    assert state.timers == [501, 100_501]
    # The burst at 100 s is still open and grows; nothing else is passed on again.
    out = pd.concat(bursts.handleInputRows((1,), iter([_writes([100], [n])]), state))
    assert out[["seq", "n_writes"]].values.tolist() == [[n, 2]]

    state.mark = 10_000_000
    list(bursts.handleExpiredTimer((1,), state, None))
    assert not state.rows and len(state.timers) == 2


def test_a_late_write_swallows_bursts_and_null_times_stay():
    state, bursts = _State(), Bursts("1 second")
    bursts.init(state)
    list(bursts.handleInputRows((None,), iter([_writes([10, 12], [1, 2])]), state))
    late = pd.concat([_writes([11], [3]), _writes([0], [4]).assign(first=pd.NaT, last=pd.NaT)])
    out = pd.concat(bursts.handleInputRows((None,), iter([late]), state))
    assert out["name"].isna().all()
    assert out[["seq", "n_writes"]].values.tolist() == [[4, 4], [2, 0]]
