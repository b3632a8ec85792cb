"""Keyed state over several batches in any order, and projections that take each event once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import log, messages
from quern.streaming import counters, flow, keyed, projection

UTC = "u string, s long, c long"


def feed(spark, source, build, rows, schema, checkpoint, sink, mode="append", change=lambda df: df):
    """Writes one more batch and lets the stream take it in; the rows of state afterwards."""
    df = change(spark.createDataFrame(rows, schema))
    df.coalesce(1).write.mode("append").parquet(str(source))
    q = flow.start(build(spark.readStream.schema(df.schema).parquet(str(source))), sink, str(checkpoint), mode=mode)
    assert q.awaitTermination(180)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return states[-1] if states else None


def test_late_versions_change_nothing(spark, tmp_path):
    """Versions in any order over five batches; a part moves from group to group, another is removed and comes back."""
    schema = "part string, seq int, removed boolean, grp string, n long"
    versions = [("p", 1, False, "g", 5), ("p", 2, False, "h", 7), ("q", 1, False, "g", 3), ("q", 2, True, "g", 3), ("q", 3, None, "g", 4), ("r", 1, False, None, 2), ("r", 2, True, None, 2), ("s", 9, False, "g", None)]
    order, got, folded = [1, 4, 0, 6, 2, 5, 3, 7, 1, 0], {}, []
    for i in range(0, 10, 2):
        sink = lambda b, _: [got.__setitem__(r.grp, got.get(r.grp, 0) + r.n) for r in b.collect()]
        feed(spark, tmp_path / "a", lambda s: keyed.ordered_deltas(s, "part", "seq", "grp", "removed", "n"), [versions[j] for j in order[i : i + 2]], schema, tmp_path / "ca", sink)
    assert {k: v for k, v in got.items() if v} == {"h": 7, "g": 4}
    for part in ([("p", 2, False, "g", 7)], [("p", 1, False, "g", 5)], [("p", 3, True, "g", 5)]):
        feed(spark, tmp_path / "b", lambda s: counters.fold_deltas(s, "grp", "part", "seq", "removed", "n"), part, schema, tmp_path / "cb", lambda b, _: folded.extend(r.n for r in b.collect()))
    assert folded == [7, -7]
    batch = spark.createDataFrame([("p", 2, False, "g", 7), ("p", 1, False, "g", 5)], schema)
    assert [tuple(r) for r in log.running_totals(batch, "part", "seq", "removed", "grp", ["n"]).collect()] == [("g", 7)]


def test_parts_are_forgotten_after_their_time(spark, tmp_path):
    out = keyed.ordered_deltas(spark.readStream.schema("part string, seq int, removed boolean, grp string, n long").parquet(str(tmp_path)), "part", "seq", "grp", "removed", "n", ttl_seconds=60)
    assert out.isStreaming and out.columns == ["grp", "n"]


def test_usage_waits_for_late_events_and_expires(spark, tmp_path):
    """Events at and before the epoch, out of order over four batches; state goes with the watermark."""
    rng = random.Random(4)
    events = [(k, rng.randrange(-400, 400), rng.randrange(9)) for k in "abc" for _ in range(25)] + [("a", 0, 1), ("b", -30, 2)]
    rng.shuffle(events)
    seen, sizes = {}, []
    sink = lambda b, _: [seen.__setitem__(r.u, (r.anchor, r.usage)) for r in b.collect()]
    build = lambda s: keyed.late_usage(s, "u", "t", "c", 100, "1000 seconds")
    time = lambda df: df.select("u", F.timestamp_seconds("s").alias("t"), "c")
    for i in range(4):
        sizes.append(feed(spark, tmp_path / "in", build, events[i::4], UTC, tmp_path / "ck", sink, change=time))
    assert not seen and sizes[-1] >= sizes[0] > 0
    sizes.append(feed(spark, tmp_path / "in", build, [("z", 9_000, 0)], UTC, tmp_path / "ck", sink, change=time))
    want = counters.rolling_usage_batch(time(spark.createDataFrame(events, UTC)), "u", "t", "c", 100)
    assert seen == {r.u: (r.anchor, r.usage) for r in want.collect()}
    feed(spark, tmp_path / "in", build, [("z", 20_000, 0)], UTC, tmp_path / "ck", sink, change=time)
    last = feed(spark, tmp_path / "in", build, [("z", 40_000, 0)], UTC, tmp_path / "ck", sink, change=time)
    assert last < sizes[0] and seen["z"] == (20_000, 0)


def test_times_long_ago_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="1870"):
        feed(spark, tmp_path / "in", lambda s: keyed.late_usage(s, "u", "t", "c", 10, "1 second"), [("a", -200 * 365 * 86_400, 1)], UTC, tmp_path / "ck", lambda b, _: b.collect(), change=lambda df: df.select("u", F.timestamp_seconds("s").alias("t"), "c"))


def test_frames_wait_for_their_chunks(spark, tmp_path):
    schema, out, sizes = "k string, o long, x string, s long", [], []
    build = lambda s: keyed.late_frames(s, "k", "o", "x", "t", lateness="10 seconds", wait_seconds=30)
    sink = lambda b, _: out.extend(tuple(r) for r in b.collect())
    time = lambda df: df.withColumn("t", F.timestamp_seconds("s")).drop("s")
    batches = [
        [("k", 2, "c\n\nd", 2), ("g", 0, "one\n\ntw", 1)],
        [("k", 0, "a\n\n", 0), ("k", 2, "again", 2)],
        [("k", 1, "b", 1), ("g", 2, "four\n\nfi", 3), ("k", 0, "late", 0)],
        [("z", 0, "", 60)],
        [("z", 1, "", 70)],
    ]
    for rows in batches:
        sizes.append(feed(spark, tmp_path / "in", build, rows, schema, tmp_path / "ck", sink, change=time))
    assert sorted(out) == [("g", 0, "one", True), ("g", 1, "twfour", False), ("g", 2, "fi", False), ("k", 0, "a", True), ("k", 1, "bc", True), ("k", 2, "d", False)]
    assert sizes[-1] < max(sizes)


def session_log(seed, sessions=6):
    """Random events of several sessions, numbered without a gap."""
    rng, out = random.Random(seed), []
    kinds = ["prompted", "step.started", "text.started", "text.delta", "text.ended", "step.ended", "compaction.started", "compaction.delta", "shell.started", "shell.ended", "synthetic", "retried"]
    for s in range(sessions):
        for i in range(rng.randrange(5, 40)):
            data = {"timestamp": i, "text": f"t{i}", "delta": "d", "prompt": {"text": f"p{i}"}, "callID": f"c{i % 3}", "sessionID": "s", "finish": "stop"}
            out.append((f"s{s}", i, f"{s}-{i}", "session.next." + rng.choice(kinds), json.dumps(data)))
    return out


LOG = "session string, seq long, id string, kind string, data string"


def test_projected_table_matches_the_batch(spark, tmp_path):
    """Events shuffled over batches and repeated; one session has a gap, and stops there until it is filled."""
    events, path = session_log(8), f"file://{tmp_path}/table"
    rng = random.Random(1)
    gap = ("s2", 3)
    sent = [e for e in events if e[:2] != gap]
    rng.shuffle(sent)
    build = lambda s: projection.changes(s, "session", "seq", "id", "kind", "data")
    ops: list[tuple] = []
    apply = projection.table_sink(path)

    def sink(batch, number):
        batch.persist()
        ops.extend((r.op, r.key, r.position) for r in batch.collect())
        apply(batch, number)
        apply(batch, number)  # sent again
        batch.unpersist()

    def wanted(rows):
        lists = messages.message_lists(spark.createDataFrame(rows, LOG), "session", "seq", "id", "kind", "data")
        return sorted((r.session, r.position, json.loads(r.message)["id"], r.message) for r in lists.collect())

    def table():
        return sorted((r.key, r.position, json.loads(r.row)["id"], r.row) for r in projection.table(spark, path).collect())

    for i in range(4):
        feed(spark, tmp_path / "in", build, sent[i::4] + sent[i::8], LOG, tmp_path / "ck", sink, mode="append")
    assert table() == wanted([e for e in events if e[0] != "s2" or e[1] < 3])
    feed(spark, tmp_path / "in", build, [e for e in events if e[:2] == gap], LOG, tmp_path / "ck", sink)
    assert table() == wanted(events) and {"insert", "update"} <= {o for o, *_ in ops}
    before = len(ops)
    feed(spark, tmp_path / "in", build, events, LOG, tmp_path / "ck", sink)  # a whole replay
    assert len(ops) == before and table() == wanted(events)


def test_rows_that_handlers_delete_leave_the_table(spark, tmp_path):
    handlers = {"put": lambda state, data: {**(state or {}), **data}, "drop": lambda state, data: None}
    path, out = f"file://{tmp_path}/table", []
    build = lambda s: projection.changes(s, "session", "seq", "id", "kind", "data", projection.by_handlers(handlers), first=1)
    apply = projection.table_sink(path)

    def sink(batch, number):
        out.extend((r.op, r.key, r.seq) for r in batch.collect())
        apply(batch, number)

    for rows in ([("a", 1, "", "put", '{"n": 1}'), ("b", 1, "", "put", '{"n": 2}')], [("a", 3, "", "put", '{"m": 5}')], [("a", 2, "", "drop", ""), ("b", 2, "", "drop", None)]):
        feed(spark, tmp_path / "in", build, rows, LOG, tmp_path / "ck", sink)
    assert sorted(out) == [("delete", "b", 2), ("insert", "a", 1), ("insert", "b", 1), ("update", "a", 3)]
    assert [(r.key, r.row) for r in projection.table(spark, path).collect()] == [("a", '{"m": 5}')]
    with pytest.raises(Exception, match="no handler for odd"):
        feed(spark, tmp_path / "in", build, [("a", 4, "", "odd", "")], LOG, tmp_path / "ck", sink)
