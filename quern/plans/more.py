"""Smaller operators: validity, canonical labels, JSON predicates, ordinals, listings, imports, identifiers, usage normalising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import classify
from quern.functions import exprs as X
from quern.operators import analytic, joins
from quern.plans.registry import query
from quern.session import load, scratch
from quern.sources import writers
from quern.streaming import flow

#: Named expressions, to be used in any query over usage events.
CALCULATED: dict[str, str] = {
    "is_error": "event_type = 'error'",
    "cents": "cast(round(value * 100) as bigint)",
    "tokens": "cast(get_json_object(props, '$.k') as bigint)",
}


def calculated(*names: str) -> list[Column]:
    """Columns of the registry."""
    return [F.expr(CALCULATED[n]).alias(n) for n in names]


@query("SELECT event_type, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY event_type")
def calculated_fields(spark, d):
    e = load(spark, d, "events").select("event_type", *calculated("is_error", "cents", "tokens"))
    return e.groupBy("event_type").agg(F.count_if("is_error").alias("errors"), F.sum("cents").alias("cents"), F.sum("tokens").alias("tokens"))


@query("WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN '1999-02-31' END AS period_key FROM orders) SELECT o_orderkey, period_key FROM k WHERE regexp_matches(period_key, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(period_key AS DATE) IS NOT NULL")
def row_validity(spark, d):
    key = F.when(F.col("o_orderkey") % 4 == 0, X.day_key(F.col("o_orderdate"))).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 2, "1999-02-31")
    rows = load(spark, d, "orders").select("o_orderkey", key.alias("period_key"))
    return rows.filter(F.col("period_key").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("period_key").try_cast("date").isNotNull())


@query("SELECT o_orderkey, ['Zen', 'Zen', 'Go', 'Enterprise', 'all', 'fReE', 'Other'][o_orderkey % 7 + 1] AS label FROM orders")
def canonical_labels(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("PAID", "zen", "go", "enterPRISE", "ALL", "fReE", "Other"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return load(spark, d, "orders").select("o_orderkey", classify.canonical_tier(raw).alias("label"))


@query("SELECT event_id FROM events WHERE CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) = 42")
def json_predicate(spark, d):
    return load(spark, d, "events").filter(F.try_variant_get(F.try_parse_json("props"), "$.k", "int") == 42).select("event_id")


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part) SELECT p_partkey, CAST(unnest(range(0, len(words))) AS INTEGER) AS position, unnest(words) AS word FROM w")
def ordinals(spark, d):
    return load(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("position", "word"))


@query("WITH p AS (SELECT DISTINCT p_brand AS a, p_brand || '/' || p_type AS b FROM part), n AS (SELECT DISTINCT a AS path, 1 AS depth FROM p UNION SELECT b, 2 FROM p), r AS (SELECT path, depth, row_number() OVER (ORDER BY depth, path) AS rn, count(*) OVER () AS total FROM n) SELECT path, CAST(depth AS INTEGER) AS depth FROM r WHERE rn <= 40 UNION ALL SELECT '[' || (max(total) - 40) || ' truncated]', NULL FROM r HAVING max(total) > 40")
def bounded_listing(spark, d):
    paths = load(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    found = joins.directory_counts(paths, "path").select(F.col("directory").alias("path"), "depth")
    shown = found.orderBy("depth", "path").limit(40)
    rest = found.agg(F.count("*").alias("n")).filter("n > 40").select(F.concat(F.lit("["), (F.col("n") - 40).cast("string"), F.lit(" truncated]")), F.lit(None).cast("int"))
    return shown.union(rest)


@query("SELECT name, CAST(row_number() OVER (ORDER BY lower(name), name DESC) AS INTEGER) AS rn FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part)")
def locale_sort(spark, d):
    """Letters before case, as a locale orders them."""
    names = load(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name")).distinct()
    return analytic.running_total(names, [F.collate("name", "UNICODE_CI"), F.desc("name")], F.lit(1), "rn").select("name", F.col("rn").cast("int").alias("rn"))


@query("WITH m AS (SELECT conv_id, turn, CASE WHEN turn < 2 THEN role ELSE upper(role) END AS role, text FROM conversations) SELECT 'session' AS kind, CAST(count(DISTINCT conv_id) AS BIGINT) AS n, 'second' AS mark, CAST(NULL AS BIGINT) AS letters FROM m UNION ALL SELECT 'message', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN role = lower(role) THEN 1 ELSE 0 END) AS VARCHAR), NULL FROM m UNION ALL SELECT 'part', CAST(count(*) AS BIGINT), NULL, CAST(sum(length(text)) AS BIGINT) FROM m")
def session_import(spark, d):
    """Nested JSON documents read and taken apart into three tables, twice: sessions are replaced, messages and parts that are there stay as they are."""
    root, c = scratch(spark), load(spark, d, "conversations")
    name = F.concat_ws("-", "conv_id", "turn")
    for run, mark, rows in ((1, "first", c.filter("turn < 2")), (2, "second", c)):
        role = F.col("role") if run == 1 else F.upper("role")
        messages = F.array_sort(F.collect_list(F.struct(name.alias("id"), role.alias("role"), F.array(F.struct(F.concat(name, F.lit("-0")).alias("id"), F.col("text").alias("text"))).alias("parts"))))
        rows.groupBy("conv_id").agg(F.to_json(F.struct(F.first("conv_id").cast("string").alias("id"), F.lit(mark).alias("title"), messages.alias("messages"))).alias("value")).select("value").write.text(f"{root}/in{run}")
        nested = spark.read.schema("id string, title string, messages array<struct<id: string, role: string, parts: array<struct<id: string, text: string>>>>").json(f"{root}/in{run}")
        writers.import_sessions(nested, f"{root}/out")
    count = lambda kind, mark, letters: spark.read.parquet(f"{root}/out/{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), mark.cast("string").alias("mark"), letters.cast("long").alias("letters"))
    none = F.max(F.lit(None))
    return count("session", F.max("title"), none).union(count("message", F.count_if(F.col("role") == F.lower("role")), none)).union(count("part", none, F.sum(F.length("text"))))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) % 68719476736 AS ms FROM events")
def identifier_times(spark, d):
    """The milliseconds that a time-ordered identifier keeps: 48 bits of time x 4096 + counter in twelve hex digits."""
    stamp = (F.unix_millis(F.col("ts").cast("timestamp")) * 4096 + 7) % F.lit(1 << 48)
    name = F.concat(F.lpad(F.lower(F.hex(stamp)), 12, "0"), F.lit("abcdefghijklmn"))
    back = F.conv(F.substring("name", 1, 12), 16, 10).cast("long")
    return load(spark, d, "events").select("event_id", name.alias("name")).select("event_id", F.floor(back / 4096).cast("long").alias("ms"))


@query("""WITH e AS (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, event_id % 5 AS m FROM events)
SELECT event_id, CASE WHEN m = 0 THEN k WHEN m = 4 THEN k - CAST(floor(k * 0.9::DOUBLE) AS BIGINT) ELSE k - 30 END AS input, k + 1 AS output, CASE m WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 4 THEN NULL ELSE 7 END::BIGINT AS reasoning,
  CASE WHEN m = 4 THEN CAST(floor(k * 0.9::DOUBLE) AS BIGINT) ELSE 30 END AS cache_read, CASE m WHEN 0 THEN 11 WHEN 3 THEN 13 END::BIGINT AS cache_write_5m, CASE m WHEN 0 THEN 12 END::BIGINT AS cache_write_1h FROM e""")
def usage_normalisers(spark, d):
    """Reports of four kinds, the last one also without cache reads, which are then estimated; input may come out negative, as reported."""
    k, m = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 5
    n = lambda x: F.lit(x).cast("long")
    body = F.when(m == 0, F.to_json(F.struct(k.alias("input_tokens"), n(30).alias("cache_read_input_tokens"), (k + 1).alias("output_tokens"), F.struct(n(11).alias("ephemeral_5m_input_tokens"), n(12).alias("ephemeral_1h_input_tokens")).alias("cache_creation"), n(99).alias("cache_creation_input_tokens"))))
    body = body.when(m == 1, F.to_json(F.struct(k.alias("promptTokenCount"), n(30).alias("cachedContentTokenCount"), (k + 1).alias("candidatesTokenCount"))))
    body = body.when(m == 2, F.to_json(F.struct(k.alias("input_tokens"), F.struct(n(30).alias("cached_tokens")).alias("input_tokens_details"), (k + 1).alias("output_tokens"), F.struct(n(7).alias("reasoning_tokens")).alias("output_tokens_details"))))
    body = body.when(m == 3, F.to_json(F.struct(k.alias("prompt_tokens"), F.struct(n(30).alias("cached_tokens"), n(13).alias("cache_creation_input_tokens")).alias("prompt_tokens_details"), (k + 1).alias("completion_tokens"), F.struct(n(7).alias("reasoning_tokens")).alias("completion_tokens_details"))))
    body = body.otherwise(F.to_json(F.struct(k.alias("prompt_tokens"), (k + 1).alias("completion_tokens"))))
    kind = F.element_at(F.array(*map(F.lit, ("anthropic", "google", "openai", "compatible", "compatible"))), (m + 1).cast("int"))
    return load(spark, d, "events").select("event_id", X.normal_usage(kind, body, estimate_cache=True).alias("u")).select("event_id", "u.*")


@query("SELECT name FROM (SELECT 'file-' || p_partkey AS name, p_partkey * 86400 AS t FROM part) WHERE t >= (SELECT max(p_partkey) * 86400 FROM part) - 7 * 86400")
def timed_cleanup(spark, d):
    """What a sweep keeps of files older than seven days against the newest."""
    files = load(spark, d, "part").select(F.concat(F.lit("file-"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") * 86_400).alias("t"))
    newest = files.agg((F.max("t") - 7 * 86_400).alias("bound"))
    return files.crossJoin(F.broadcast(newest)).filter("t >= bound").select("name")  # one row


@query("WITH r AS (SELECT date '2024-01-30' AS latest), w AS (SELECT * FROM (VALUES ('1D', 0), ('1W', 6), ('2W', 13), ('1M', 27), ('2M', 55), ('3M', 89)) t(range, days)), e AS (SELECT CAST(ts AS DATE) AS day, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events), lo AS (SELECT min(day) AS first FROM e) SELECT range, CAST(sum(k) AS BIGINT) AS tokens, CAST(count(DISTINCT day) AS BIGINT) AS days FROM e, w, r, lo WHERE day <= latest AND day >= greatest(latest - days, first) GROUP BY range")
def range_windows(spark, d):
    """Totals of the trailing ranges, all from one pass: rows meet a list of six ranges."""
    ranges = spark.createDataFrame([("1D", 0), ("1W", 6), ("2W", 13), ("1M", 27), ("2M", 55), ("3M", 89)], "range string, back int")
    e = load(spark, d, "events").select(F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    per_day = e.groupBy("day").agg(F.sum("k").alias("k"))
    latest = F.lit("2024-01-30").cast("date")
    met = per_day.crossJoin(F.broadcast(ranges)).filter((F.col("day") <= latest) & (F.col("day") >= F.date_sub(latest, F.col("back"))))  # six rows
    return met.groupBy("range").agg(F.sum("k").alias("tokens"), F.count("*").alias("days"))


@query("WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, ts, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k, event_id FROM events), late AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-25 09:55:00'), early AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-24' AND event_id % 10 <> 0) SELECT day, event_type, CAST(sum(k) AS BIGINT) AS tokens FROM early WHERE (day, event_type) NOT IN (SELECT day, event_type FROM late) GROUP BY ALL UNION ALL SELECT day, event_type, CAST(sum(k) AS BIGINT) FROM late GROUP BY ALL")
def late_recompute(spark, d):
    """A first pass lacks a tenth of the events; the next one recomputes this and the last week and leaves older days."""
    e = load(spark, d, "events").select("event_id", "event_type", "ts", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    daily = lambda rows: rows.groupBy("day", "event_type").agg(F.sum("k").alias("tokens"))
    path = scratch(spark)
    daily(e.filter("event_id % 10 <> 0 and ts < timestamp_ntz '2024-01-24'")).write.partitionBy("day").parquet(path)
    flow.refresh(e, "ts", F.lit("2024-01-25 10:00:30").cast("timestamp_ntz"), daily, path, ["day"], ["day", "event_type"])
    return spark.read.parquet(path)


@query("WITH w AS (SELECT event_type, (event_id % 3 = 0) AS failed, time_bucket(INTERVAL 6 HOUR, ts) + i * INTERVAL 6 HOUR + INTERVAL 6 HOUR AS ends FROM events, (SELECT unnest(range(0, 4)) AS i)), s AS (SELECT ends, event_type, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (failed) AS BIGINT) AS failed FROM w GROUP BY ALL) SELECT *, CAST(CASE WHEN total >= 20 THEN floor(failed * 1000000 / total) ELSE 0 END AS BIGINT) AS ratio_ppm, CASE WHEN total >= 20 THEN floor(failed * 1000000 / total) ELSE 0 END >= 350000 AS triggered FROM s")
def windowed_error_ratio(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return flow.windowed_ratio(e, "ts", "event_type", F.col("event_id") % 3 == 0, 20, 0.35, "24 hours", "6 hours").withColumn("ends", F.col("ends").cast("timestamp_ntz"))


@query("WITH n AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations) SELECT conv_id, CAST(chunk AS INTEGER) AS chunk, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY ALL")
def shipped_chunks(spark, d):
    c = load(spark, d, "conversations").select("conv_id", "turn", "role")
    return flow.in_chunks(c, "conv_id", "turn", 3).select("conv_id", "chunk", F.size("rows").cast("long").alias("n"))
