"""Flow between streams and tables: fan-out by type, heartbeats, recomputation of recent periods."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.alerts import ratio
from quern.sources import writers

Sink = Callable[[DataFrame, int], None]


def fan_out(kind: str, by_kind: dict[str, Sink], everything: Sink | None = None) -> Sink:
    """A ``foreachBatch`` function: each kind's subscriber gets its rows, and ``everything`` gets all; the batch is computed once."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in by_kind.items():
                sink(batch.filter(F.col(kind) == name), number)
            if everything is not None:
                everything(batch, number)
        finally:
            batch.unpersist()

    return run


def start(stream: DataFrame, sink: Sink, checkpoint: str, every: str | None = None, mode: str = "append", swallow: bool = False):
    """Starts a query that hands each micro-batch to ``sink``: at a fixed rate (such as ``60 seconds``), or, without one, until all that is there is done.

    With ``swallow`` a batch that fails is logged and given up, and the next one goes on at its time.
    """

    def run(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception:
            if not swallow:
                raise
            logging.getLogger(__name__).exception("batch %d failed", number)

    writer = stream.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> None:
    """Runs :func:`start` until all that is there is done."""
    start(stream, sink, checkpoint, mode=mode).awaitTermination()


def with_heartbeat(spark: SparkSession, stream: DataFrame, kind: str, seconds: int = 10) -> DataFrame:
    """The stream and, every so many seconds, a row that only has ``kind`` = heartbeat."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % seconds == 0)
    empty = [F.lit("heartbeat").alias(f.name) if f.name == kind else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    return stream.union(ticks.select(*empty))


def settled_before(now: Column, lag_minutes: int = 5) -> Column:
    """The last whole minute that is older than the ingestion lag."""
    return F.date_trunc("minute", now - F.make_dt_interval(mins=F.lit(lag_minutes)))


def recent(rows: DataFrame, time: str, now: Column, first: Column | None = None, lag_minutes: int = 5) -> DataFrame:
    """Rows that a refresh recomputes: from a week before this ISO week began (not before ``first``) up to the ingestion lag."""
    start = F.date_trunc("week", now) - F.make_dt_interval(days=F.lit(7))
    start = start if first is None else F.greatest(start, first)
    return rows.filter((F.col(time) >= start) & (F.col(time) < settled_before(now, lag_minutes)))


def refresh(rows: DataFrame, time: str, now: Column, aggregate: Callable[[DataFrame], DataFrame], path: str, by: list[str], keys: list[str]) -> None:
    """Late data: recent periods are aggregated anew and replace what is stored under their keys; only the partitions (``by``) of these periods are written."""
    writers.upsert_periods(aggregate(recent(rows, time, now)), path, by, keys)


def windowed_ratio(stream: DataFrame, time: str, by: str, failed: Column, least: int, threshold: float, width: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """The error-ratio alert over sliding windows of a stream (or of a table)."""
    windows = stream.select(by, failed.alias("__failed"), F.window(time, width, slide).alias("__w"))
    named = windows.withColumn("__g", F.struct("__w", by))
    return ratio(named, "__g", F.lit(True), F.col("__failed"), least, threshold).select(F.col("__g.__w.end").alias("ends"), F.col(f"__g.{by}").alias(by), "total", "failed", "ratio_ppm", "triggered")


def in_chunks(rows: DataFrame, key: str, order: str, size: int = 10) -> DataFrame:
    """(key, chunk, rows): each key's rows in order, so many to a chunk, for shipping elsewhere."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    cols = [c for c in rows.columns if c not in (key, order)]
    return rows.withColumn("chunk", F.floor(place / size).cast("int")).groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("rows"))
