"""Steps whose work must grow no faster than their rows: state calls of streams, pages and JSON texts in few files, tables in key ranges."""

import json
import random
from types import SimpleNamespace

import pandas as pd

from quern.operators import log, messages
from quern.plans import texts
from quern.session import spread
from quern.sources import ranged
from quern.streaming import keyed, projection


class Calls:
    """State of one key that counts its calls."""

    def __init__(self):
        self.calls, self.timers, self.cells = 0, [], {}

    def getValueState(self, name, *_):
        return Cell(self, name)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Cell:
    def __init__(self, owner, name):
        self.owner, self.name = owner, name

    def _now(self):
        self.owner.calls += 1
        return self.owner.cells.setdefault(self.name, {})

    def exists(self):
        return bool(self._now())

    def get(self):
        now = self._now()
        return iter(now["list"]) if "list" in now else now.get("value")

    def update(self, value):
        self._now()["value"] = value

    def clear(self):
        self._now().clear()

    def put(self, rows):
        self._now()["list"] = list(rows)

    def appendList(self, rows):
        self._now().setdefault("list", []).extend(rows)

    def getValue(self, key):
        return self._now().get(key)

    def containsKey(self, key):
        return key in self._now()

    def updateValue(self, key, value):
        self._now()[key] = value

    def removeKey(self, key):
        self._now().pop(key, None)

    def iterator(self):
        return iter(list(self._now().items()))


def test_late_usage_sets_a_timer_a_batch_and_not_an_event():
    rng, state, processor = random.Random(4), Calls(), keyed._Usage("u", 100)
    events = [(rng.randrange(5_000), rng.randrange(9)) for _ in range(400)]
    processor.init(state)
    for i in range(4):
        part = pd.DataFrame(events[i::4], columns=["t", "c"])
        assert list(processor.handleInputRows(("a",), iter([part]), None)) == []
    assert len(state.timers) == 4
    seen, clock = [], 0
    for passed in (700, 2_500, 6_000):
        clock = passed * 1000 + keyed.SHIFT_MS
        for at in sorted(t for t in state.timers if t <= clock):
            state.timers.remove(at)
            now = SimpleNamespace(getCurrentWatermarkInMs=lambda: clock)  # noqa: B023
            seen += [tuple(r)[1:] for out in processor.handleExpiredTimer(("a",), now, None) for r in out.itertuples(index=False)]
    anchor, usage = None, 0
    for t, c in sorted(events):
        anchor, usage = (t, c) if anchor is None or anchor < t - 100 else (anchor, usage + c)
    assert seen[-1] == (anchor, usage) and len(seen) == 3 and state.calls < 80


def test_early_events_and_rows_move_in_parts():
    n, rng, state, processor = 600, random.Random(6), Calls(), projection._Projection(messages.apply, 0)
    events = [(i, f"e{i}", "session.next.prompted", json.dumps({"prompt": {"text": f"t{i}"}, "timestamp": i}), None) for i in range(n)]
    twice = [*events[1:], *events[1:]]
    rng.shuffle(twice)
    batches, table, waiting = [twice[i::4] for i in range(4)] + [[events[0]]], {}, None
    processor.init(state)
    for batch in batches:
        part = pd.DataFrame(batch, columns=["seq", "id", "kind", "data", "metadata"], dtype=object)
        for out in processor.handleInputRows(("k",), iter([part]), None):
            for r in out.itertuples(index=False):
                table[r.position], waiting = json.loads(r.row), r.waiting
    assert [table[i]["text"] for i in range(n)] == [f"t{i}" for i in range(n)] and waiting == 0
    assert not state.cells["early"] and state.calls < 200


def test_a_repeat_of_a_waiting_event_leaves_nothing_behind():
    state, processor = Calls(), projection._Projection(messages.apply, 0)
    processor.init(state)
    event = lambda i: (i, f"e{i}", "session.next.prompted", json.dumps({"prompt": {"text": "t"}, "timestamp": i}), None)
    out = []
    for batch in ([event(1)], [event(0), event(1)]):
        out += [r for part in processor.handleInputRows(("k",), iter([pd.DataFrame(batch, columns=["seq", "id", "kind", "data", "metadata"], dtype=object)]), None) for r in part.itertuples(index=False)]
    assert [r.waiting for r in out] == [0, 0] and not state.cells["early"]


def test_pages_of_one_file_are_parsed_by_many_tasks(spark, data):
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() > 4
    assert "RoundRobinPartitioning" in texts.html_parts(spark, data)._jdf.queryExecution().toString()


def test_json_differences_are_found_without_moving_equal_leaves(spark):
    deep = lambda x, n: x if n == 0 else {"k": deep(x, n - 1)}
    pairs = [
        ({"a": 1, "b": [1, {"c": None}]}, {"a": 1, "b": [1, {"c": 2}, 3]}), (deep(1, 20), deep(2, 20)), ({"a": [], "s": "[[{{"}, {"a": {}, "s": "[[{{"}),
        ({"x": {"y": 1}}, {"x": "é\u0000z"}), (None, {"n": None}), (7, 7), ("s", [1]),
    ]
    text = [(i, None if a is None else json.dumps(a), None if b is None else json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    got = log.deep_diff(spark.createDataFrame(text, "id long, a string, b string"), "id", "a", "b")
    want = {
        (0, "$.b[1].c", "null", "2"), (0, "$.b[2]", None, "3"), (1, "$" + ".k" * 20, "1", "2"), (3, "$.x.y", "1", None), (3, "$.x", None, '"é\\u0000z"'),
        (4, "$.n", None, "null"), (6, "$", '"s"', None), (6, "$[0]", None, "1"),
    }
    assert {tuple(r) for r in got.collect()} == want
    assert "array_except" in got._jdf.queryExecution().toString()


def test_key_ranges_with_a_null_key_and_places_by_file(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    ranged.create(spark.createDataFrame([(None, 1), (3, 2), (5, None), (5, 4)], "k long, n long"), path, ["k"])
    ranged.increment(spark.createDataFrame([(None, 10), (5, 10), (9, 10)], "k long, n long"), path, ["k"], ["n"])
    assert {tuple(r) for r in ranged.read(spark, path).collect()} == {(None, 11), (3, 2), (5, 14), (9, 10)}
    r = ranged.state(spark, path).ranges(spark).collect()
    assert [(x.low.k, x.high.k, x.rows) for x in r] == [(None, 9, 4)]
    plan = ranged._ranges(spark, path, r[0].file.split("/")[0], ["k"], ranged.state(spark, path).schema)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan
