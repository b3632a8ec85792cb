"""Keyed state in which order counts: whatever order rows arrive in, over any number of batches, results are those of the table.

Each function is a ``transformWithStateInPandas`` over a stream: value, list and map state in RocksDB, which spills to disk and
is checkpointed by its changes, and event-time timers that close what the watermark has passed.  The session's state
store is set to RocksDB by the call.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.counters import EPOCH_SHIFT, shifted

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHIFT_MS = EPOCH_SHIFT * 1000


def with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, timed: bool = False, mode: str = "Append") -> DataFrame:
    """``processor`` over ``rows`` by key, in the state store that it needs."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, "EventTime" if timed else "None")


class _Deltas(StatefulProcessor):
    def __init__(self, order: str, group: str, ttl: int | None):
        self.kinds, self.ttl = f"o {order}, g {group}, amount long", ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.kinds, self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        now = before
        for part in rows:
            for o, g, gone, m in zip(*(part[c].tolist() for c in ("o", "g", "r", "m")), strict=True):
                if now is None or o > now[0]:
                    now = o, g, 0 if gone else int(m)
        if now is before:
            return
        self.last.update(now)
        out: dict = {}
        for sign, v in ((-1, before), (1, now)):
            if v is not None:
                out[v[1]] = out.get(v[1], 0) + sign * v[2]
        yield pd.DataFrame({"g": list(out), "m": list(out.values())})

    def close(self) -> None:
        pass


def ordered_deltas(stream: DataFrame, part: str, order: str, group: str, removed: str, measure: str, ttl_seconds: int | None = None) -> DataFrame:
    """(group, measure): by how much a part's newest version changes its group's total; totals are sums over what was appended.

    State is (order, group, amount) of each part's newest version: an older version changes nothing, in whatever batch it
    comes, and a part that moves takes its amount from one group to the other.  Equal orders are repeats.  With
    ``ttl_seconds`` a part is forgotten so long after its last change (by the clock); a version that comes later counts as new.
    """
    kind = lambda c: stream.schema[c].dataType.simpleString()
    rows = stream.select(F.col(part).cast("string").alias("p"), F.col(order).alias("o"), F.col(group).alias("g"), F.coalesce(F.col(removed), F.lit(False)).alias("r"), F.coalesce(F.col(measure).cast("long"), F.lit(0)).alias("m"))
    processor = _Deltas(kind(order), kind(group), None if ttl_seconds is None else ttl_seconds * 1000)
    if ttl_seconds is None:
        out = with_state(rows, "p", processor, f"g {kind(group)}, m long")
    else:  # time to live is by the clock
        rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        out = rows.groupBy("p").transformWithStateInPandas(processor, f"g {kind(group)}, m long", "Append", "ProcessingTime")
    return out.select(F.col("g").alias(group), F.col("m").alias(measure))


class _Usage(StatefulProcessor):
    def __init__(self, key: str, seconds: int):
        self.key, self.seconds = key, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, c long")
        self.window = handle.getValueState("window", "anchor long, usage long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            events = list(zip(part["t"].tolist(), part["c"].tolist(), strict=True))
            if events:
                self.waiting.appendList(events)
                first = min(t for t, _ in events)
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:  # one timer for all: when it fires, those that are left get the next
            self.handle.registerTimer(earliest * 1000 + SHIFT_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        every = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted(e for e in every if e[0] * 1000 + SHIFT_MS <= passed)
        if due:
            left = [e for e in every if e[0] * 1000 + SHIFT_MS > passed]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(t for t, _ in left) * 1000 + SHIFT_MS)
            else:
                self.waiting.clear()
            anchor, usage = self.window.get() if self.window.exists() else (None, 0)
            for t, c in due:
                anchor, usage = (t, c) if anchor is None or anchor < t - self.seconds else (anchor, usage + c)
            self.window.update((anchor, usage))
            self.handle.registerTimer((anchor + self.seconds + 1) * 1000 + SHIFT_MS)
            yield pd.DataFrame({self.key: [key[0]], "anchor": [anchor], "usage": [usage]})
        elif not every and self.window.exists() and (self.window.get()[0] + self.seconds) * 1000 + SHIFT_MS < passed:
            self.window.clear()  # no event can belong to it any more

    def close(self) -> None:
        pass


def late_usage(stream: DataFrame, key: str, time: str, cost: str, seconds: int, lateness: str) -> DataFrame:
    """(key, anchor, usage) as :func:`quern.streaming.counters.rolling_usage_batch` has them, from events that come in any order.

    Events wait until the watermark (``lateness`` behind the newest event) has passed them, and are then taken in the order of
    their times; a row comes out whenever a key's window has changed.  A window that no event can reach any more leaves no
    state.  Events at and before 1970 count like others (after 1870).
    """
    rows = shifted(stream, time, lateness).select(key, "__w", F.col(time).cast("timestamp").cast("long").alias("t"), F.col(cost).cast("long").alias("c"))
    kind = stream.schema[key].dataType.simpleString()
    return with_state(rows, key, _Usage(key, seconds), f"{key} {kind}, anchor long, usage long", timed=True)


class _Frames(StatefulProcessor):
    def __init__(self, key: str, separator: str, wait_ms: int):
        self.key, self.separator, self.wait_ms = key, separator, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "o long", "x string")
        self.place = handle.getValueState("place", "next long, frames long, rest string, closes long")

    def _rows(self, key, frames: list[str], first: int, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(frames), "number": range(first, first + len(frames)), "frame": frames, "complete": [complete] * len(frames)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        after, count, rest, closes = self.place.get() if self.place.exists() else (0, 0, "", 0)
        arrived, newest = {}, 0
        for part in rows:
            for o, x, at in zip(part["o"].tolist(), part["x"].tolist(), part["at"].tolist(), strict=True):
                newest = max(newest, at)
                if o >= after:
                    arrived.setdefault(o, x)
        pieces, held = [rest], self.early.exists()
        while True:
            if held and self.early.containsKey((after,)):
                pieces.append(self.early.getValue((after,))[0])
                self.early.removeKey((after,))
                arrived.pop(after, None)
            elif after in arrived:
                pieces.append(arrived.pop(after))
            else:
                break
            after += 1
        for o, x in arrived.items():
            if not (held and self.early.containsKey((o,))):
                self.early.updateValue((o,), (x,))
        *frames, rest = "".join(pieces).split(self.separator)
        later = max(closes, newest + self.wait_ms + SHIFT_MS)
        if later > closes:
            if closes:
                self.handle.deleteTimer(closes)
            self.handle.registerTimer(later)
        self.place.update((after, count + len(frames), rest, later))
        if frames:
            yield self._rows(key, frames, count, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        after, count, rest, closes = self.place.get()
        if timerValues.getCurrentWatermarkInMs() < closes:
            return
        waiting = sorted((k[0], v[0]) for k, v in self.early.iterator()) if self.early.exists() else []
        *frames, rest = "".join([rest, *(x for _, x in waiting)]).split(self.separator)
        self.early.clear()
        self.place.clear()
        if frames:
            yield self._rows(key, frames, count, not waiting)
        if rest:
            yield self._rows(key, [rest], count + len(frames), False)

    def close(self) -> None:
        pass


def late_frames(stream: DataFrame, key: str, order: str, text: str, time: str, separator: str = "\n\n", lateness: str = "1 minute", wait_seconds: int = 60) -> DataFrame:
    """(key, number, frame, complete): frames of chunked text, whose chunks (numbered from 0) come in any order.

    Chunks that are early wait in map state until those before them are there; a chunk that is repeated counts once.  When
    the watermark has passed a key's last chunk by ``wait_seconds`` the key is closed: chunks that still wait are taken as if
    those missing were empty, what is left without a separator comes out as incomplete, and no state stays.
    """
    rows = shifted(stream, time, lateness).select(key, "__w", F.col(order).cast("long").alias("o"), F.coalesce(text, F.lit("")).alias("x"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"))
    kind = stream.schema[key].dataType.simpleString()
    return with_state(rows, key, _Frames(key, separator, wait_seconds * 1000), f"{key} {kind}, number long, frame string, complete boolean", timed=True)
