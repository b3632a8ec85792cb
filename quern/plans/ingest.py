"""Ingestion: CSV by aliases, routing, metric lines, framed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.session import load, scratch
from quern.sources import readers, writers

ALIASES = {"provider": ("vendor",), "model": ("model name",), "total": ("Sum (tokens)", "tokens")}


@query("SELECT CAST(s_suppkey AS VARCHAR) AS provider, s_name AS model, CAST(s_nationkey AS VARCHAR) AS total FROM supplier")
def csv_alias_import(spark, d):
    path = scratch(spark) + ".csv"
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("Vendor"), F.col("s_name").alias("Model Name"), F.col("s_nationkey").alias("SUM(tokens)"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return readers.by_alias(readers.read_csv(spark, path), ALIASES)


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'lake' END AS \"database\", CASE WHEN event_id % 3 = 0 THEN event_type END AS \"table\", event_id % 3 = 0 AS ok, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def routed_events(spark, d):
    e = load(spark, d, "events")
    body = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("lake."), "event_type")).otherwise("no route").alias("_datalake_key"), "event_id"))
    return readers.routed(e.select(body.alias("body")), "body").groupBy("database", "table", "ok").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def metric_lines(spark, d):
    e = load(spark, d, "events")
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("_metric:"), F.to_json(F.struct("user_id", "event_id")))).otherwise("plain text")
    m = readers.metric_lines(e.select(line.alias("value")))
    return m.groupBy(F.col("metric")["user_id"].cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.sum(F.col("metric")["event_id"].cast("long")).alias("total"))


@query("WITH l AS (SELECT user_id, max_by(event_type, ts) AS t FROM events GROUP BY user_id) SELECT user_id, CAST((SELECT count(DISTINCT event_type) FROM events e WHERE e.user_id = l.user_id) AS BIGINT) AS fields FROM l")
def folded_metrics(spark, d):
    e = load(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.create_map(F.col("event_type"), F.col("value").cast("string")).alias("metric"))
    return readers.folded_metrics(e, "user_id", "at").select("user_id", F.size("metric").cast("long").alias("fields"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS frames FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def sse_frames(spark, d):
    c = load(spark, d, "conversations").filter("length(text) > 0")
    chunk = F.concat(F.lit("data: "), F.regexp_replace("text", r"\s+", " "), F.lit("\n\n"))
    framed = readers.sse_events(c.select("conv_id", "turn", chunk.alias("chunk")), "conv_id", "turn", "chunk")
    return framed.groupBy("conv_id").agg(F.count("*").alias("frames"))


@query("SELECT event_type AS \"table\", CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def routed_sink(spark, d):
    root = scratch(spark)
    e = load(spark, d, "events")
    body = F.to_json(F.struct(F.concat(F.lit("lake."), "event_type").alias("_datalake_key"), "event_id"))
    rows = readers.routed(e.select(body.alias("body")), "body")
    for _ in range(2):  # a batch that is sent again replaces itself
        writers.append_routed(rows, root, 1)
    return spark.read.parquet(root).groupBy("table").agg(F.count("*").alias("n"))
