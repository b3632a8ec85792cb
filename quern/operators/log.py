"""Event logs: checks of order, ownership, replay into tables, compaction of state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quern.functions import walk


def gaps(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq, expected) where an event does not follow the one before it."""
    before = F.lag(seq, 1, -1).over(Window.partitionBy(key).orderBy(seq))
    return log.select(key, seq, (before + 1).alias("expected")).filter(F.col(seq) != F.col("expected"))


def replayable(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, events, first, last, ok): whether each key's events follow one another without a gap or a repeat from the first."""
    out = log.groupBy(key).agg(F.count("*").alias("events"), F.min(seq).alias("first"), F.max(seq).alias("last"), F.countDistinct(seq).alias("__n"))
    return out.withColumn("ok", (F.col("events") == F.col("__n")) & (F.col("last") - F.col("first") + 1 == F.col("__n"))).drop("__n")


def appendable(log: DataFrame, incoming: DataFrame, key: str, seq: str, owner: str | None = None) -> DataFrame:
    """verdict of each incoming event: ``append``, ``seen`` (at or below the latest), ``foreign`` (another owner), or ``gap``."""
    state = log.groupBy(key).agg(F.max(seq).alias("__latest"), *([F.max_by(owner, seq).alias("__owner")] if owner else []))
    first = incoming.dropDuplicates([key, seq]).join(state, key, "left").withColumn("__latest", F.coalesce("__latest", F.lit(-1)))
    fresh = F.col(seq) > F.col("__latest")
    place = F.sum(fresh.cast("int")).over(Window.partitionBy(key).orderBy(seq))
    foreign = (F.col("__owner").isNotNull() & (F.col("__owner") != F.col(owner))) if owner else F.lit(False)
    verdict = F.when(foreign, "foreign").when(~fresh, "seen").when(F.col(seq) == F.col("__latest") + place, "append").otherwise("gap")
    return first.withColumn("verdict", verdict).drop("__latest", "__owner")


def last_write_wins(snapshot: DataFrame, newer: DataFrame, key: str, order: str) -> DataFrame:
    """The union of a state and later events by key, later ones winning."""
    cols = snapshot.columns
    both = snapshot.withColumn("__o", F.struct(F.lit(0).alias("gen"), F.col(order).alias("at"))).unionByName(newer.select(*cols).withColumn("__o", F.struct(F.lit(1).alias("gen"), F.col(order).alias("at"))))
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), "__o").alias("__r")).select("__r.*")


def compact(state: DataFrame, log: DataFrame, key: str, order: str, watermark) -> tuple[DataFrame, DataFrame]:
    """The state with all events after ``watermark`` taken in, and the new watermark (one row)."""
    newer = log.filter(F.col(order) > watermark)
    return last_write_wins(state, newer, key, order), newer.agg(F.max(order).alias("watermark"))


def running_totals(versions: DataFrame, part: str, order: str, removed: str, group: str, measures: list[str]) -> DataFrame:
    """Totals per group over the latest version of each part; what is removed counts no more."""
    last = versions.groupBy(part).agg(F.max_by(F.struct(group, removed, *measures), order).alias("v")).select("v.*")
    return last.filter(~F.col(removed)).groupBy(group).agg(*[F.sum(m).alias(m) for m in measures])


def signed_totals(versions: DataFrame, part: str, order: str, removed: str, group: str, measures: list[str]) -> DataFrame:
    """The same from signed deltas: each version adds its measures and takes away the version's before."""
    w = Window.partitionBy(part).orderBy(order)
    now = lambda m: F.when(F.col(removed), 0).otherwise(F.col(m))
    delta = versions.select(group, *[(now(m) - F.coalesce(F.lag(now(m)).over(w), F.lit(0))).alias(m) for m in measures])
    return delta.groupBy(group).agg(*[F.sum(m).alias(m) for m in measures])


def fragments(rows: DataFrame, key: str, order: str, text: str, finished: str, schema: str) -> DataFrame:
    """Per finished key its fragments joined in order and read as JSON; ``error`` where they are no JSON."""
    joined = rows.groupBy(key).agg(F.max(finished).alias("__f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda e: e[text]), "").alias("raw"))
    done = joined.filter("__f").select(key, "raw", F.from_json("raw", schema).alias("value"))
    return done.withColumn("error", F.when(F.try_parse_json("raw").isNull(), "not JSON"))


#: Handlers of a projection: event type to (state, data) -> state; a state of None is a deleted row.
Handlers = dict[str, Callable[[dict | None, dict], dict | None]]


def project(log: DataFrame, key: str, seq: str, kind: str, data: str, handlers: Handlers, schema: str) -> DataFrame:
    """The table that folding each key's events in order gives; unknown event types are an error.

    Partitions are read in the order of key and place, with one key's state at hand.
    """
    columns = _parse_datatype_string(schema)
    kinds = [to_arrow_type(f.dataType) for f in columns.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def rows() -> pa.RecordBatch:
            cols = [pa.array([r.get(f) for r in done], t) for f, t in zip(columns.names, kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, columns.names)

        for batch in batches:
            for k, name, body in zip(*[batch.column(c).to_pylist() for c in ("k", "name", "body")], strict=True):
                if k != now:
                    if state:
                        done.append({key: now, **state})
                    now, state = k, None
                if name not in handlers:
                    raise ValueError(f"no handler for {name}")
                state = handlers[name](state, json.loads(body or "{}"))
            yield rows()
        if state:
            done.append({key: now, **state})
        yield rows()

    named = log.select(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(kind).alias("name"), F.col(data).alias("body"))
    return named.repartition("k").sortWithinPartitions("k", "s").mapInArrow(run, schema)


def visible_history(messages: DataFrame) -> DataFrame:
    """What a conversation still shows after compactions.

    Rows (session, id, role, parent, summary, finished, failed, compacts, tail_start) in id order.  A compaction is a user
    row with ``compacts``; it counts once a finished, unfailed summary answers it.  History then starts at the newest such
    compaction, or at its tail start; a retained tail comes after the summary.

    The newest compaction of a session and the bounds of its parts come from aggregates; one sort by part and id follows.
    """
    m = messages.select("session", "id", "role", "parent", "summary", "finished", "failed", "compacts", "tail_start")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    summary = (F.col("role") == "assistant") & true("summary")
    replies = m.filter("parent is not null").groupBy("session", F.col("parent").alias("id")).agg(F.bool_or(summary & true("finished") & ~true("failed")).alias("answered"), F.max("id").alias("last"))
    asked = m.filter((F.col("role") == "user") & true("compacts")).join(replies, ["session", "id"]).filter("answered and last > id")
    newest = asked.groupBy("session").agg(F.max("id").alias("stop"), F.max_by("tail_start", "id").alias("tail"))
    answer = m.filter(summary).join(newest.select("session", F.col("stop").alias("parent")), ["session", "parent"]).filter(F.col("id") > F.col("parent")).groupBy("session").agg(F.min("id").alias("answer"))
    tails = m.join(newest.filter("tail is not null").select("session", F.col("tail").alias("id"), "stop"), ["session", "id"]).filter(F.col("id") <= F.col("stop")).select("session", F.col("id").alias("found")).distinct()
    bounds = newest.join(answer, "session", "left").join(tails, "session", "left")
    start = F.when(F.col("tail").isNull(), F.col("stop")).otherwise(F.col("found"))  # null: from the first row
    shown = m.select("session", "id").join(bounds.withColumn("start", start), "session", "left").filter("stop is null or start is null or id >= start")
    moved = F.col("tail").isNotNull() & F.col("answer").isNotNull()
    part = F.when(moved & (F.col("id") >= F.col("stop")) & (F.col("id") <= F.col("answer")), 0).when(moved & (F.col("id") < F.col("stop")), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("session").orderBy(part, "id")) - 1
    return shown.select("session", place.cast("long").alias("position"), "id")


def flat_json(rows: DataFrame, ident: str, body: str) -> DataFrame:
    """(id, path, value: JSON): every leaf of JSON texts with its path, which begins with ``$``."""
    found = walk.leaves(rows.select(F.col(ident).cast("long").alias("id"), F.col(body).alias("body")), "body", "$")
    return found.select("id", "path", F.to_json("value").alias("value"))


def deep_diff(pairs: DataFrame, ident: str, left: str, right: str) -> DataFrame:
    """(id, path, a, b): the leaves at which two JSON texts differ."""
    named = pairs.select(F.col(ident).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(left).alias("a"), F.col(right).alias("b"))
    found = walk.unlike(named, "a", "b", "$")
    of = lambda first: F.max(F.when(F.col("first") == F.lit(first), F.col("value")))
    met = found.groupBy("row", "id", "path").agg(of(True).alias("a"), of(False).alias("b"))
    return met.filter(~F.col("a").eqNullSafe(F.col("b"))).select("id", "path", "a", "b")
