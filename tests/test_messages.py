import json

import pytest

from quern.operators import messages

P = messages.PREFIX


def fold(*events):
    out = []
    for i, (kind, data) in enumerate(events):
        messages.apply(out, f"e{i}", P + kind, {"timestamp": i, **data})
    return out


def test_a_new_step_completes_the_one_before():
    got = fold(("step.started", {"agent": "a", "snapshot": "s0"}), ("step.started", {"agent": "b"}), ("step.ended", {"finish": "stop", "cost": 2, "tokens": {"input": 1}, "snapshot": "s1"}), ("text.delta", {"delta": "lost"}))
    assert [m["time"].get("completed") for m in got] == [1, 2] and got[0]["snapshot"] == {"start": "s0"}
    assert got[1]["finish"] == "stop" and got[1]["cost"] == 2 and got[1]["snapshot"] == {"end": "s1"} and got[1]["content"] == []


def test_a_step_that_fails():
    got = fold(("step.started", {}), ("step.failed", {"error": {"name": "x"}}))
    assert got[0]["finish"] == "error" and got[0]["error"] == {"name": "x"} and got[0]["time"]["completed"] == 1


def test_content_is_found_by_kind_and_id():
    got = fold(
        ("step.started", {}), ("text.started", {}), ("reasoning.started", {"reasoningID": "r1"}), ("reasoning.started", {"reasoningID": "r2"}), ("reasoning.delta", {"reasoningID": "r1", "delta": "one"}),
        ("text.delta", {"delta": "a"}), ("text.delta", {"delta": "b"}), ("text.started", {}), ("text.ended", {"text": "whole"}), ("reasoning.ended", {"reasoningID": "r2", "text": "two"}),
    )
    assert [(c["type"], c.get("id"), c["text"]) for c in got[0]["content"]] == [("text", None, "ab"), ("reasoning", "r1", "one"), ("reasoning", "r2", "two"), ("text", None, "whole")]


def test_a_tool_goes_through_its_states():
    call = {"callID": "c"}
    begin = [("step.started", {}), ("tool.input.started", {**call, "name": "n"}), ("tool.input.delta", {**call, "delta": "{"}), ("tool.input.delta", {**call, "delta": "}"}), ("tool.input.ended", call)]
    assert fold(*begin)[0]["content"][0]["state"] == {"status": "pending", "input": "{}"}
    early = fold(*begin, ("tool.success", {**call, "structured": {}, "content": []}))[0]["content"][0]
    assert early["state"]["status"] == "pending"  # nothing that was not called succeeds
    ran = [*begin, ("tool.called", {**call, "input": {"q": 1}, "provider": "p"}), ("tool.input.delta", {**call, "delta": "late"}), ("tool.progress", {**call, "structured": {"n": 1}, "content": ["x"]})]
    ok = fold(*ran, ("tool.success", {**call, "structured": {"n": 2}, "content": ["y"], "provider": "q"}))[0]["content"][0]
    assert ok["state"] == {"status": "completed", "input": {"q": 1}, "structured": {"n": 2}, "content": ["y"]} and ok["provider"] == "q" and ok["time"] == {"created": 1, "ran": 5, "completed": 8}
    bad = fold(*ran, ("tool.failed", {**call, "error": "e"}))[0]["content"][0]
    assert bad["state"] == {"status": "error", "error": "e", "input": {"q": 1}, "structured": {"n": 1}, "content": ["x"]}


def test_other_messages():
    got = fold(
        ("agent.switched", {"agent": "a"}), ("model.switched", {"model": "m"}), ("prompted", {"prompt": {"text": "hi", "files": [1]}}), ("synthetic", {"sessionID": "s", "text": "t"}),
        ("shell.started", {"callID": "1", "command": "ls"}), ("shell.started", {"callID": "2", "command": "pwd"}), ("shell.ended", {"callID": "1", "output": "out"}), ("shell.ended", {"callID": "9", "output": "no"}),
        ("compaction.delta", {"text": "none yet"}), ("compaction.started", {"reason": "auto"}), ("compaction.delta", {"text": "a"}), ("compaction.delta", {"text": "b"}), ("retried", {}),
    )
    assert [m["type"] for m in got] == ["agent-switched", "model-switched", "user", "synthetic", "shell", "shell", "compaction"]
    assert got[2]["text"] == "hi" and got[2]["files"] == [1] and got[3]["sessionID"] == "s"
    assert got[4]["output"] == "out" and got[4]["time"]["completed"] == 6 and got[5]["output"] == "" and got[6]["summary"] == "ab"
    done = fold(("compaction.started", {"reason": "auto"}), ("compaction.ended", {"text": "all", "include": "x"}))
    assert done[0]["summary"] == "all" and done[0]["include"] == "x"
    for kind in ("unheard.of", "step.paused", "tool.input"):
        with pytest.raises(ValueError, match="no handler"):
            fold(("step.started", {}), (kind, {}))


def test_lists_of_many_sessions(spark):
    log = [("b", 2, "y", P + "synthetic", {"text": "2"}, None), ("a", 1, "x", P + "agent.switched", {"agent": "z"}, '{"k": 1}'), ("b", 1, "w", P + "prompted", {"prompt": {"text": "1"}}, None)]
    df = spark.createDataFrame([(s, n, i, k, json.dumps(d), m) for s, n, i, k, d, m in log], "session string, seq int, id string, kind string, data string, metadata string")
    got = sorted((r.session, r.position, r.id, r.type, json.loads(r.message).get("metadata")) for r in messages.message_lists(df, "session", "seq", "id", "kind", "data", "metadata").collect())
    assert got == [("a", 0, "x", "agent-switched", {"k": 1}), ("b", 0, "w", "user", None), ("b", 1, "y", "synthetic", None)]
    assert messages.message_lists(df.limit(0), "session", "seq", "id", "kind", "data").count() == 0
