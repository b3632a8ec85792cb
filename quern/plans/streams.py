"""Streams whose rows come out of order over several batches, each with the result that the table gives."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import analytic
from quern.plans import more, sessions
from quern.plans.registry import ORACLES, query
from quern.plans.stored import _append, rolling_usage_stream
from quern.plans.usage import usage
from quern.session import load, scratch
from quern.sources import paged, sink
from quern.streaming import flow, keyed, projection

#: Batches that a table is dealt into.
BATCHES = 5


def shuffled(spark, rows, closing=None):
    """``rows`` as a stream of ``BATCHES`` batches, dealt by a hash of the row; the batch of ``closing`` comes last."""
    path = scratch(spark)
    rows.repartition(BATCHES, F.xxhash64(*rows.columns)).write.parquet(path)
    if closing is not None:
        closing.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("WITH v AS (SELECT conv_id * 1000 + turn // 2 AS part, turn AS seq, role AS grp, length(text) % 5 = 0 AS removed, length(text) AS amount FROM conversations), l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY part ORDER BY seq DESC) = 1) SELECT grp, CAST(sum(amount) AS BIGINT) AS amount FROM l WHERE NOT removed GROUP BY grp HAVING sum(amount) <> 0")
def ordered_delta_stream(spark, d):
    """Versions in any order; parts move between groups, and some of their newest versions are removals."""
    path = scratch(spark)
    c = load(spark, d, "conversations").select(F.expr("conv_id * 1000 + turn div 2").alias("part"), F.col("turn").alias("seq"), F.col("role").alias("grp"), (F.length("text") % 5 == 0).alias("removed"), F.length("text").cast("long").alias("amount"))
    flow.drain(keyed.ordered_deltas(shuffled(spark, c), "part", "seq", "grp", "removed", "amount"), _append(path), scratch(spark))
    return spark.read.parquet(path).groupBy("grp").agg(F.sum("amount").alias("amount")).filter("amount <> 0")


@query(ORACLES[rolling_usage_stream.__name__])
def late_usage_stream(spark, d):
    """Usage windows over events in any order: events wait for the watermark."""
    path = scratch(spark)
    u = usage(spark, d).select("session", "time", "cents")
    closing = u.agg(F.max("time").alias("time")).select(F.lit(None).alias("session"), (F.col("time") + F.make_dt_interval(days=F.lit(1000))).alias("time"), F.lit(0).alias("cents"))
    flow.drain(keyed.late_usage(shuffled(spark, u, closing), "session", "time", "cents", 18_000, "900 days"), _append(path), scratch(spark))
    return spark.read.parquet(path).filter("session is not null").groupBy("session").agg(F.max_by(F.struct("anchor", "usage"), "batch").alias("s")).select("session", "s.anchor", "s.usage")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS frames, CAST(sum(length(text)) AS BIGINT) AS letters, true AS complete FROM conversations GROUP BY conv_id")
def late_chunk_stream(spark, d):
    """Chunks of framed texts in any order, each ending within the next frame."""
    path = scratch(spark)
    flat = F.translate("text", "\n", " ")
    c = load(spark, d, "conversations").withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    c = c.select("conv_id", F.explode(F.array(F.struct((F.col("turn") * 2).alias("no"), F.substring(flat, 1, 5).alias("x")), F.struct((F.col("turn") * 2 + 1).alias("no"), F.concat(F.substring(flat, 6, 1 << 30), F.lit("\n\n")).alias("x")))).alias("p")).select("conv_id", "p.no", "p.x", F.timestamp_seconds("p.no").alias("at"))
    closing = spark.range(1).select(F.lit(-1).alias("conv_id"), F.lit(0).alias("no"), F.lit("").alias("x"), F.timestamp_seconds(F.lit(10**9)).alias("at"))
    flow.drain(keyed.late_frames(shuffled(spark, c, closing), "conv_id", "no", "x", "at", lateness="1000 days"), _append(path), scratch(spark))
    got = spark.read.parquet(path).groupBy("conv_id").agg(F.count("*").alias("frames"), F.sum(F.length("frame")).alias("letters"), (F.bool_and("complete") & (F.max("number") + 1 == F.count("*"))).alias("complete"))
    return got


@query(ORACLES[sessions.message_lists.__name__])
def message_stream(spark, d):
    """Message lists from events that come in any order and twice each; changes go into a table by batch."""
    path = scratch(spark)
    events = sessions.step_events(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    flow.drain(projection.changes(shuffled(spark, twice), "conv_id", "seq", "id", "kind", "data"), projection.table_sink(path), scratch(spark))
    return sessions.list_columns(projection.table(spark, path).withColumnRenamed("key", "session").withColumn("type", F.get_json_object("row", "$.type")), "row")


PAGE = 500
COLUMNS = "o_orderkey long, o_custkey long, status string"


def _numbered_orders(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderstatus").alias("status"))
    return analytic.running_total(o, ["o_orderkey"], F.lit(1), "place")


def _write_pages(rows, folder):
    """One file of JSON lines a page, in order."""
    pages = rows.withColumn("page", F.floor((F.col("place") - 1) / PAGE))
    pages.repartition("page").sortWithinPartitions("page", "place").drop("place").write.mode("overwrite").partitionBy("page").json(folder)


def _pages(spark, reader, folder):
    spark.dataSource.register(paged.Pages)
    return reader.format("pages").options(fetch=f"{paged.__name__}:{paged.file_page.__name__}", folder=folder, size=str(PAGE), columns=COLUMNS).load()


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus AS status FROM orders")
def paged_orders(spark, d):
    """Orders from page files, whose number nobody says, read by many tasks."""
    folder = scratch(spark)
    _write_pages(_numbered_orders(spark, d), folder)
    return _pages(spark, spark.read, folder)


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus AS status FROM orders")
def paged_stream(spark, d):
    """The same as a stream, stopped while the last page is half full, and taken up again when there are more."""
    folder, path, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    rows = _numbered_orders(spark, d)
    first = rows.agg(F.floor(F.count("*") * 0.55)).first()[0]
    for part in (rows.filter(F.col("place") <= first), rows):
        _write_pages(part, folder)
        flow.drain(_pages(spark, spark.readStream, folder), _append(path), checkpoint)
    return spark.read.parquet(path).drop("batch")


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'data/lake/' || event_type || '/' WHEN 1 THEN 'errors/no-route/' ELSE 'errors/no-json/' END AS folder, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY ALL")
def routed_lake(spark, d):
    """Events written by their route, batch by batch; what has none or is no JSON goes under an error prefix as it came."""
    path, i = scratch(spark), F.col("event_id")
    bodies = F.when(i % 3 == 0, F.to_json(F.struct(F.concat(F.lit("lake."), "event_type").alias("_datalake_key"), "event_id"))).when(i % 3 == 1, F.to_json(F.struct(F.lit("nowhere").alias("_datalake_key"), "event_id"))).otherwise(F.concat(F.lit("plain event_id: "), i.cast("string")))
    stream = shuffled(spark, load(spark, d, "events").select(bodies.alias("body")))
    assert sink.start(sink.events(stream), path, scratch(spark), every=None, bytes="20000").awaitTermination(3600)
    rows = sink.committed(spark, path, "").select(F.regexp_extract("file", "^(.*/)[^/]*$", 1).alias("folder"), F.regexp_extract("payload", r'event_id"?: ?"?(\d+)', 1).cast("long").alias("id"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


def _until(stream_query, done, seconds=120):
    """Lets a stream that has no end run until ``done`` is true, or it has failed, or so many seconds have gone."""
    try:
        for _ in range(seconds * 5):
            if done() or not stream_query.isActive:
                break
            time.sleep(0.2)
    finally:
        stream_query.stop()
    if failed := stream_query.exception():
        raise failed


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, false AS beats FROM events GROUP BY event_type UNION ALL SELECT 'heartbeat', NULL, true")
def heartbeat_stream(spark, d):
    """Events as they come, with a heartbeat in between."""
    path, seen = scratch(spark), {"rows": 0, "beats": 0}
    e = load(spark, d, "events").select("event_id", "event_type")
    total = e.count()

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        r = spark.read.schema(batch.schema).parquet(f"{path}/batch={number}").agg(F.count_if(F.col("event_type") == "heartbeat"), F.count("*")).first()
        seen["beats"], seen["rows"] = seen["beats"] + r[0], seen["rows"] + r[1] - r[0]

    _until(flow.start(flow.with_heartbeat(spark, shuffled(spark, e), "event_type", 1), sink, scratch(spark), every="0 seconds"), lambda: seen["rows"] >= total and seen["beats"])
    beat = F.col("event_type") == "heartbeat"
    return spark.read.parquet(path).groupBy("event_type").agg(F.when(~F.first(beat), F.count("event_id")).alias("n"), F.first(beat).alias("beats"))


@query(ORACLES[more.late_recompute.__name__])
def refresh_stream(spark, d):
    """A refresh at a fixed rate, whose first pass fails: the next one makes up for it."""
    e = load(spark, d, "events").select("event_id", "event_type", "ts", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    daily = lambda rows: rows.groupBy("day", "event_type").agg(F.sum("k").alias("tokens"))
    path, passes = scratch(spark), []
    daily(e.filter("event_id % 10 <> 0 and ts < timestamp_ntz '2024-01-24'")).write.partitionBy("day").parquet(path)

    def refresh(batch, number):
        if len(passes) < 2:
            passes.append(number)
            if len(passes) == 1:
                raise OSError("the first pass fails")
            flow.refresh(e, "ts", F.lit("2024-01-25 10:00:30").cast("timestamp_ntz"), daily, path, ["day"], ["day", "event_type"])
            passes.append("done")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    _until(flow.start(ticks, refresh, scratch(spark), every="1 seconds", swallow=True), lambda: "done" in passes)
    return spark.read.parquet(path)
