"""Current results kept by prefix: what one state row for each transaction gives, in a call for all of a prefix."""

from types import SimpleNamespace

from pyspark.sql import Row

from poolstrata.streaming.keyed import CHANGE, ResultsByPrefix

CHANGES = Row(*[c.split(" ")[0] for c in CHANGE.split(", ")])


class HeldList:
    """A handle and its one list, counting what is asked of them."""

    def __init__(self):
        self.rows, self.armed, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def registerTimer(self, at):
        self.calls += 1
        self.armed.add(at)


def member(txid, at, generation):
    return CHANGES("a", txid, at, at, "member", generation, 0, "w", None)


def fired(processor, held, at, watermark):
    held.armed.discard(at)
    return [(r.txid, r.present) for r in processor.handleExpiredTimer(("a", "t"), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: at))]


def started():
    processor, held = ResultsByPrefix(100), HeldList()
    processor.init(held)
    return processor, held, lambda *rows: [(r.txid, r.generation, r.present) for r in processor.handleInputRows(("a", "t"), iter(rows), None)]


def test_many_transactions_cost_as_many_calls_as_one():
    """F8: two calls for a prefix and micro-batch, and one timer for the first."""
    processor, held, take = started()
    assert len(take(*(member(f"t{n}", n, 1) for n in range(50)))) == 50 and held.calls == 3 and held.armed == {100}
    held.calls = 0
    assert len(take(*(member(f"t{n}", 60 + n, 2) for n in range(40)))) == 40 and held.calls == 2 and held.armed == {100}
    held.calls = 0
    assert take(member("t3", 99, 1)) == [] and held.calls == 1


def test_each_departs_at_its_own_time():
    processor, held, take = started()
    take(member("t1", 0, 1), member("t2", 40, 1))
    assert fired(processor, held, 100, 120) == [("t1", False)] and held.armed == {140} and [r[0] for r in held.rows] == ["t2"]
    take(member("t2", 130, 2))
    assert fired(processor, held, 140, 150) == [] and held.armed == {230}
    assert take(member("t2", 230, 2)) == [("t2", 2, True)]  # departed by its arrival, and back
    assert fired(processor, held, 230, 300) == [] and held.armed == {330}
    assert fired(processor, held, 330, 331) == [("t2", False)] and held.rows == [] and held.armed == set()
    assert fired(processor, held, 400, 500) == []
