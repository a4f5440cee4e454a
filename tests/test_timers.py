"""Timers of current results: a refresh touches none, and one that fires too early is set anew."""

from types import SimpleNamespace

from pyspark.sql import Row

from poolstrata.streaming.keyed import CHANGE, CurrentResults

CHANGES = Row(*[c.split(" ")[0] for c in CHANGE.split(", ")])


class Held:
    """A handle and its one value, counting what is asked of them."""

    def __init__(self):
        self.value, self.armed, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.armed.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.armed.discard(at)


def member(at, generation):
    return CHANGES("a", "t", at, at, "member", generation, 0, "w", None)


def fired(processor, held, at, watermark):
    held.armed.discard(at)
    return list(processor.handleExpiredTimer(("a", "t"), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: at)))


def test_a_refresh_costs_no_timer():
    """a key's rows of a micro-batch cost two calls, for its state alone."""
    processor, held = CurrentResults(100), Held()
    processor.init(held)
    assert [r.present for r in processor.handleInputRows(("a", "t"), iter([member(0, 1)]), None)] == [True]
    before = held.calls
    assert [r.generation for r in processor.handleInputRows(("a", "t"), iter([member(60, 2)]), None)] == [2]
    assert held.calls - before == 2 and held.armed == {100}
    assert fired(processor, held, 100, 120) == [] and held.armed == {160} and held.value is not None
    assert [r.present for r in fired(processor, held, 160, 161)] == [False]
    assert held.value is None and held.armed == set()


def test_a_late_timer_ends_what_is_due_by_the_watermark():
    processor, held = CurrentResults(100), Held()
    processor.init(held)
    list(processor.handleInputRows(("a", "t"), iter([member(0, 1), member(60, 2)]), None))
    assert [r.present for r in fired(processor, held, min(held.armed), 500)] == [False] and held.value is None and fired(processor, held, 100, 501) == []
