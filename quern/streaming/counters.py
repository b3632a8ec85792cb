"""Streaming forms: windows with late data, stateful counters, debouncing, chunk parsing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Seconds by which event times are moved up for the watermark (100 years): it begins at 1970, and what lies at or before it is dropped.
EPOCH_SHIFT = 100 * 365 * 86_400


def shifted(stream: DataFrame, time: str, lateness: str) -> DataFrame:
    """The stream with ``__w``, its event time moved up by ``EPOCH_SHIFT``, under a watermark; times so far before 1970 are an error."""
    at = F.col(time).cast("timestamp")
    moved = at + F.make_dt_interval(secs=F.lit(EPOCH_SHIFT))
    early = F.raise_error(F.lit("an event time before 1870")).cast("timestamp")
    return stream.withColumn("__w", F.when(F.unix_micros(at) <= -EPOCH_SHIFT * 1_000_000, early).otherwise(moved)).withWatermark("__w", lateness)


def timed(stream: DataFrame, time: str, lateness: str = "5 minutes") -> DataFrame:
    """Event time as a timestamp (a watermark takes no time without zone) with the ingestion lag that is waited for."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def tumbling(stream: DataFrame, time: str, keys: list[str], amount=None, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Counts (or sums of ``amount``) per key and window; state goes when the watermark has passed the window."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    total = (F.count("*") if amount is None else F.sum(amount)).alias("total")
    return stream.groupBy(window.alias("w"), *keys).agg(total).select(F.col("w.start").alias("window_start"), *keys, "total")


def rolling_usage(stream: DataFrame, key: str, time: str, cost: str, seconds: int, lateness: str | None = None) -> DataFrame:
    """(key, anchor, usage) after each batch: cost adds up while events lie within ``seconds`` of the window's first event, else a new window starts at the event.  The anchor does not slide.

    With ``lateness`` (how late events may come) a counter expires: its state goes when the watermark has passed the
    window's end.  Without it state is kept for every key.  Events at and before 1970 count like others.
    """

    def run(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, usage = state.get if state.exists else (None, 0)
        part = pd.concat(list(parts)).sort_values("__t")
        for t, c in zip(part["__t"].tolist(), part["__c"].tolist(), strict=True):
            if anchor is None or anchor < t - seconds:
                anchor, usage = t, c
            else:
                usage += c
        state.update((anchor, usage))
        if lateness:
            state.setTimeoutTimestamp(max((anchor + seconds + 1 + EPOCH_SHIFT) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]], "anchor": [anchor], "usage": [usage]})

    rows = shifted(stream, time, lateness) if lateness else stream
    rows = rows.select(key, *(["__w"] if lateness else []), F.col(time).cast("timestamp").cast("long").alias("__t"), F.col(cost).cast("long").alias("__c"))
    kind = rows.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.EventTimeTimeout if lateness else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, anchor long, usage long", "anchor long, usage long", "update", timeout)


def rolling_usage_batch(rows: DataFrame, key: str, time: str, cost: str, seconds: int) -> DataFrame:
    """The same fold over a finite table: the state after each key's last event.

    Events of one key and second are summed first; each partition is then read in order, with one key's state at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, anchor, usage = None, None, 0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            names, times, costs = (batch.column(i).to_pylist() for i in range(3))
            for k, t, c in zip(names, times, costs, strict=True):
                if anchor is not None and k != key_now:
                    for x, v in zip(out, (key_now, anchor, usage), strict=True):
                        x.append(v)
                    anchor = None
                key_now = k
                anchor, usage = (t, c) if anchor is None or anchor < t - seconds else (anchor, usage + c)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], [key, "anchor", "usage"])
        if anchor is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((key_now, anchor, usage), kinds, strict=True)], [key, "anchor", "usage"])

    at = F.col(time).cast("timestamp").cast("long").alias("t")
    summed = rows.groupBy(key, at).agg(F.sum(F.col(cost).cast("long")).alias("c"))
    kinds = [to_arrow_type(rows.schema[key].dataType), pa.int64(), pa.int64()]
    ordered = summed.repartition(key).sortWithinPartitions(key, "t")
    return ordered.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, anchor long, usage long")


def fold_deltas(stream: DataFrame, group: str, part: str, order: str, removed: str, measure: str) -> DataFrame:
    """(group, measure): by how much each part's newest version changes its group's total, so that totals are sums over what was appended.

    State is (order, amount) of each part's newest version; a group has none, however many parts it has.  An older version
    changes nothing, in whatever batch it comes; equal orders are repeats.  :func:`quern.streaming.keyed.ordered_deltas` also
    follows parts from group to group.
    """

    def run(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, before = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("o")
        newest, gone, amount = (rows[c].tolist()[-1] for c in ("o", "r", "m"))
        if at is not None and newest <= at:
            return
        now = 0 if gone else int(amount)
        state.update((newest, now))
        yield pd.DataFrame({group: [name[0]], measure: [now - before]})

    rows = stream.select(group, F.col(part).cast("string").alias("p"), F.col(order).alias("o"), F.col(removed).alias("r"), F.col(measure).cast("long").alias("m"))
    kind = rows.schema[group].dataType.simpleString()
    return rows.groupBy(group, "p").applyInPandasWithState(run, f"{group} {kind}, {measure} long", f"at {rows.schema['o'].dataType.simpleString()}, amount long", "append", GroupStateTimeout.NoTimeout)


def parse_chunks(stream: DataFrame, key: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """(key, frame): frames of chunked text; what follows the last separator is kept until its end arrives."""

    def run(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest = state.get[0] if state.exists else ""
        for x in pd.concat(list(parts)).sort_values("o")["x"]:
            rest += x
        *frames, rest = rest.split(separator)
        state.update((rest,))
        yield pd.DataFrame({key: [name[0]] * len(frames), "frame": frames})

    rows = stream.select(key, F.col(order).alias("o"), F.col(text).alias("x"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, frame string", "rest string", "append", GroupStateTimeout.NoTimeout)


def debounced(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of a micro-batch (the trigger interval is the delay)."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")


def coalesced(batch: DataFrame, key: str, order: str, kind: str, full: str = "updated", delta: str = "delta") -> DataFrame:
    """One micro-batch: of full updates of a key the last stays; deltas of a key with two or more full updates are stale."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    fulls = F.count_if(F.col(kind) == full).over(w)
    last = F.max(F.when(F.col(kind) == full, F.col(order))).over(w)
    marked = batch.withColumn("__n", fulls).withColumn("__last", last)
    return marked.filter((F.col(kind) != full) | (F.col(order) == F.col("__last"))).filter((F.col(kind) != delta) | (F.col("__n") < 2)).drop("__n", "__last")
