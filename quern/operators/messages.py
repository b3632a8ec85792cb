"""The message list of a session, folded from its event log.

Each event kind either opens a message, or changes the message it belongs to: the newest assistant message that is not
completed, the newest compaction, or the shell run with its call id.  Content items of an assistant message are found by
their kind and id, newest first.  Events that find nothing to change are without effect; so are kinds that only mark time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What event kinds begin with, and the kinds that open a message: its type, the fields it takes from the event, and fields it starts with.
PREFIX = "session.next."
OPENS: dict[str, tuple[str, tuple[str, ...], dict]] = {
    "agent.switched": ("agent-switched", ("agent",), {}),
    "model.switched": ("model-switched", ("model",), {}),
    "prompted": ("user", ("text", "files", "agents", "references"), {}),
    "synthetic": ("synthetic", ("sessionID", "text"), {}),
    "shell.started": ("shell", ("callID", "command"), {"output": ""}),
    "step.started": ("assistant", ("agent", "model"), {"content": []}),
    "compaction.started": ("compaction", ("reason",), {"summary": ""}),
}
#: Kinds without effect.
IGNORED = ("tool.input.ended", "retried")


def _newest(rows: list[dict], **wanted) -> dict | None:
    return next((r for r in reversed(rows) if all(r.get(k) == v for k, v in wanted.items())), None)


def _open(messages: list[dict], ident: str, name: str, data: dict, metadata) -> None:
    kind, fields, start = OPENS[name]
    source = data.get("prompt", {}) if name == "prompted" else data
    message = {"id": ident, "type": kind, **{f: source[f] for f in fields if f in source}, **json.loads(json.dumps(start)), "time": {"created": data.get("timestamp")}}
    if metadata is not None:
        message["metadata"] = metadata
    if name == "step.started" and data.get("snapshot"):
        message["snapshot"] = {"start": data["snapshot"]}
    messages.append(message)


def _step(message: dict, end: str, data: dict) -> None:
    message["time"]["completed"] = data.get("timestamp")
    if end == "failed":
        message |= {"finish": "error", "error": data.get("error")}
    else:
        message |= {f: data.get(f) for f in ("finish", "cost", "tokens")}
        if data.get("snapshot"):
            message["snapshot"] = {**message.get("snapshot", {}), "end": data["snapshot"]}


def _text(message: dict, kind: str, part: str, data: dict) -> None:
    """Text and reasoning: items that begin empty, grow and are replaced at the end."""
    own = {"id": data.get("reasoningID")} if kind == "reasoning" else {}
    if part == "started":
        message["content"].append({"type": kind, **own, "text": ""})
    elif (item := _newest(message["content"], type=kind, **own)) is not None:
        item["text"] = item["text"] + data.get("delta", "") if part == "delta" else data.get("text")


def _tool(message: dict, part: str, data: dict) -> None:
    if part == "input.started":
        message["content"].append({"type": "tool", "id": data.get("callID"), "name": data.get("name"), "time": {"created": data.get("timestamp")}, "state": {"status": "pending", "input": ""}})
        return
    tool = _newest(message["content"], type="tool", **({"id": data["callID"]} if data.get("callID") is not None else {}))
    if tool is None:
        return
    state, result = tool["state"], {k: data.get(k) for k in ("structured", "content")}
    if part == "input.delta" and state["status"] == "pending":
        state["input"] += data.get("delta", "")
    elif part == "called":
        tool["provider"], tool["time"]["ran"] = data.get("provider"), data.get("timestamp")
        tool["state"] = {"status": "running", "input": data.get("input"), "structured": {}, "content": []}
    elif state["status"] == "running" and part == "progress":
        state |= result
    elif state["status"] == "running" and part in ("success", "failed"):
        tool["provider"], tool["time"]["completed"] = data.get("provider"), data.get("timestamp")
        tool["state"] = {**state, **({"status": "completed", **result} if part == "success" else {"status": "error", "error": data.get("error")})}


def apply(messages: list[dict], ident: str, kind: str, data: dict, metadata=None) -> None:
    """Takes one event into the list; an unknown kind is an error."""
    name = kind.removeprefix(PREFIX)
    topic, _, part = name.partition(".")
    if name in IGNORED:
        return
    if topic in ("step", "text", "reasoning", "tool"):
        assistant = next((m for m in reversed(messages) if m["type"] == "assistant" and m["time"].get("completed") is None), None)
        if name == "step.started":
            if assistant is not None:
                assistant["time"]["completed"] = data.get("timestamp")
            _open(messages, ident, name, data, None)
        elif assistant is None:
            return
        elif topic == "step" and part in ("ended", "failed"):
            _step(assistant, part, data)
        elif topic == "tool" and part in ("input.started", "input.delta", "called", "progress", "success", "failed"):
            _tool(assistant, part, data)
        elif topic in ("text", "reasoning") and part in ("started", "delta", "ended"):
            _text(assistant, topic, part, data)
        else:
            raise ValueError(f"no handler for {kind}")
    elif name in OPENS:
        _open(messages, ident, name, data, metadata if name != "synthetic" else None)
    elif name == "shell.ended":
        if (shell := _newest(messages, type="shell", callID=data.get("callID"))) is not None:
            shell["output"], shell["time"]["completed"] = data.get("output"), data.get("timestamp")
    elif name in ("compaction.delta", "compaction.ended"):
        if (compaction := _newest(messages, type="compaction")) is not None:
            compaction |= {"summary": compaction["summary"] + data.get("text", "")} if part == "delta" else {"summary": data.get("text"), "include": data.get("include")}
    else:
        raise ValueError(f"no handler for {kind}")


_ROWS = "session string, position long, id string, type string, message string"


def message_lists(log: DataFrame, session: str, seq: str, ident: str, kind: str, data: str, metadata: str | None = None) -> DataFrame:
    """(session, position, id, type, message: JSON) of every message that the events of a session, in order, come to.

    Sessions are read in order, one list at hand at a time.
    """

    def rows(name: str, messages: list[dict]) -> pa.RecordBatch:
        found = [(name, i, m["id"], m["type"], json.dumps(m, ensure_ascii=False)) for i, m in enumerate(messages)]
        cols = list(zip(*found, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, messages = None, []
        for batch in batches:
            for name, i, k, d, m in zip(*[batch.column(c).to_pylist() for c in ("session", "id", "kind", "data", "metadata")], strict=True):
                if name != now:
                    if messages:
                        yield rows(now, messages)
                    now, messages = name, []
                apply(messages, i, k, json.loads(d or "{}"), json.loads(m) if m else None)
        if messages:
            yield rows(now, messages)

    extra = F.col(metadata) if metadata else F.lit(None).cast("string")
    named = log.select(F.col(session).cast("string").alias("session"), F.col(seq).alias("seq"), F.col(ident).cast("string").alias("id"), F.col(kind).alias("kind"), F.col(data).alias("data"), extra.alias("metadata"))
    return named.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, _ROWS)
