"""How often the state machine of watched sources asks for its state."""

import pandas as pd

from sorrel.streaming import outcomes


class _Kept:
    """A value state that counts its messages."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class _Handle:
    def __init__(self):
        self.kept, self.timers = [], []

    def getValueState(self, name, schema):
        self.kept.append(_Kept())
        return self.kept[-1]

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_state_is_read_once_a_batch():
    hour = 3_600_000_000
    w, h = outcomes.Watcher(6 * hour, 72 * hour), _Handle()
    w.init(h)

    def batch(*readings):
        frame = pd.DataFrame([(at * hour, i, status, content) for i, (at, status, content) in enumerate(readings)], columns=["at", "reading", "status", "content"])
        return [tuple(None if x is None else x for x in r) for f in w.handleInputRows(("k",), iter([frame]), None) for r in f.itertuples(index=False)]

    assert batch(*[(i, "ok", "a") for i in range(50)]) == []
    assert sum(k.calls for k in h.kept) <= 5 and sorted(h.timers) == [(49 + 6) * hour // 1000, (49 + 72) * hour // 1000]
    assert batch((50, "blocked", "a"), (51, "blocked", "a"), (52, "ok", "b")) == [("k", 51 * hour, "unreachable", "blocked", "blocked"), ("k", 52 * hour, "content", "a", "b")]
    assert [r[2] for r in batch((52 + 100, "blocked", "b"))] == ["overdue"] and h.kept[1].value is None
