"""Projections of event logs as streams: events to changes of rows, changes to a table, each exactly once.

:func:`changes` holds one state machine per aggregate: the number of the next event, the rows that the events so far have
come to, and events that came before their turn.  Repeats are without effect, and a gap stops its own aggregate only,
until it is filled.  What comes out of a batch is the difference it made: rows inserted, updated and deleted.
:func:`table_sink` takes such changes into a table in key ranges, whose state names the last batch in it: a batch that is
sent again after a failure is skipped as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators import messages
from quern.operators.log import Handlers
from quern.sources import ranged
from quern.streaming.keyed import with_state

#: Takes an event (id, kind, data, metadata) into an aggregate's list of rows.
Fold = Callable[[list[dict], str, str, dict, object], None]

CHANGES = "key string, position long, op string, row string, seq long, waiting long"


def by_handlers(handlers: Handlers) -> Fold:
    """A fold to one row per aggregate; a handler's None deletes it, an unknown kind is an error."""

    def fold(rows: list[dict], ident: str, kind: str, data: dict, metadata) -> None:
        if kind not in handlers:
            raise ValueError(f"no handler for {kind}")
        state = handlers[kind](rows[0] if rows else None, data)
        rows[:] = [] if state is None else [state]

    return fold


#: Events, and rows, that are one value of the state: a call for each would cost more than what it moves.
EVENTS, ROWS = 256, 16


class _Projection(StatefulProcessor):
    def __init__(self, fold: Fold, first: int):
        self.fold, self.first = fold, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next long, rows long, waiting long")
        self.rows = handle.getMapState("rows", "part long", "rows string")
        self.early = handle.getMapState("early", "part long", "events string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        after, count, waiting = self.place.get() if self.place.exists() else (self.first, 0, 0)
        started, arrived = after, {}
        for part in rows:
            for event in zip(*(part[c].tolist() for c in ("seq", "id", "kind", "data", "metadata")), strict=True):
                if event[0] >= after:
                    arrived.setdefault(event[0], event[1:])
        held: dict[int, dict] = {}
        changed, stored, some = set(), set(), waiting > 0

        def early(seq: int) -> dict:
            """The part of the early events that ``seq`` belongs to."""
            at = seq // EVENTS
            if at not in held:
                text = self.early.getValue((at,)) if some else None
                held[at] = {} if text is None else json.loads(text[0])
                if text is not None:
                    stored.add(at)
            return held[at]

        due = []
        while True:
            waited = early(after).pop(str(after), None) if waiting else None
            if waited is not None:
                arrived.pop(after, None)
                changed.add(after // EVENTS)
                waiting -= 1
                due.append(waited)
            elif after in arrived:
                due.append(arrived.pop(after))
            else:
                break
            after += 1
        for seq, event in arrived.items():
            if str(seq) not in early(seq):
                early(seq)[str(seq)] = event
                changed.add(seq // EVENTS)
                waiting += 1
        for at in changed:
            if held[at]:
                self.early.updateValue((at,), (json.dumps(held[at]),))
            elif at in stored:
                self.early.removeKey((at,))
        out: list[tuple] = []
        if due:
            parts = sorted((k[0], json.loads(v[0])) for k, v in self.rows.iterator()) if count else []
            before = [text for _, part in parts for text in part]
            now = [json.loads(text) for text in before]
            for ident, kind, data, metadata in due:
                self.fold(now, ident, kind, json.loads(data or "{}"), json.loads(metadata) if metadata else None)
            texts = [json.dumps(r, ensure_ascii=False) for r in now]
            for i, text in enumerate(texts):
                if i >= count or before[i] != text:
                    out.append((key[0], i, "update" if i < count else "insert", text, after - 1, waiting))
            out += [(key[0], i, "delete", None, after - 1, waiting) for i in range(len(now), count)]
            for at in sorted({i // ROWS for _, i, *_ in out}):
                part = texts[at * ROWS : (at + 1) * ROWS]
                self.rows.updateValue((at,), (json.dumps(part),)) if part else self.rows.removeKey((at,))
            count = len(now)
        if due or arrived or after != started:
            self.place.update((after, count, waiting))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def changes(log: DataFrame, key: str, seq: str, ident: str, kind: str, data: str, fold: Fold = messages.apply, metadata: str | None = None, first: int = 0) -> DataFrame:
    """(key, position, op, row: JSON, seq, waiting) for every row that a batch of events has inserted, updated or deleted.

    Events are numbered by ``seq`` from ``first`` without a gap in each aggregate; ``seq`` of a change is the last event in it, and
    ``waiting`` the number of events that came early and wait for one that is missing.
    """
    extra = F.col(metadata) if metadata else F.lit(None)
    named = log.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(ident).cast("string").alias("id"), F.col(kind).alias("kind"), F.col(data).alias("data"), extra.cast("string").alias("metadata"))
    return with_state(named, "key", _Projection(fold, first), CHANGES)


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: changes go into the table at ``path`` (key, position, row, seq), each batch once."""

    def run(batch: DataFrame, number: int) -> None:
        known = ranged.state(batch.sparkSession, path)
        if known is not None and known.note.get("batch", -1) >= number:
            return  # it is in the table already
        ranged.merge(batch.select("key", "position", "row", "seq", "op"), path, ["key", "position"], remove=F.col("new.op") == "delete", note={"batch": number})

    return run


def table(spark, path: str) -> DataFrame:
    """What the changes have come to: (key, position, row, seq)."""
    return ranged.read(spark, path).drop("op")
