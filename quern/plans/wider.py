"""Breakdowns, marts, alerts, periods, scalar functions, edits and listings: a query for every operator that the other plans do not reach."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import classify, text
from quern.functions import exprs as X
from quern.operators import aggregate as A
from quern.operators import alerts, analytic, log, paging
from quern.plans.registry import query
from quern.plans.usage import G, U, usage
from quern.session import load, scratch
from quern.sources import readers

# usage with places: raw countries and continents as they come in, empty and missing ones among them


def _placed(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    e = F.col("event_id")
    rows = usage(spark, d).withColumns({"total_tokens": F.col("k"), "total_cost": F.col("cents"), "duration": F.col("cents"), "provider": pick(("anthropic", "openai", "unknown"), F.col("session"))})
    return rows.withColumns({"country": X.country(pick(("us", "DE", "", "xyz", "aq", None), e)), "continent": pick(("NA", "", None, "EU"), e), "provider_model": pick(("", "m-1", None, "m-2"), e)})


_PICK = lambda values, n: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"
P = f"""p AS (SELECT *, {_PICK(("anthropic", "openai", "unknown"), "session")} AS provider, CASE WHEN length(raw) = 2 THEN upper(raw) ELSE 'ZZ' END AS country FROM
  (SELECT *, {_PICK(("us", "DE", "", "xyz", "aq", None), "event_id")} AS raw, {_PICK(("NA", "", None, "EU"), "event_id")} AS continent, {_PICK(("", "m-1", None, "m-2"), "event_id")} AS provider_model FROM g))"""
M = """CAST(count(DISTINCT session) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS requests, CAST(sum(k) AS BIGINT) AS total_tokens, CAST(sum(cents) AS BIGINT) AS total_cost,
  CAST(quantile_disc(cents, 0.5) AS DOUBLE) AS p50_duration, CAST(quantile_disc(cents, 0.95) AS DOUBLE) AS p95_duration, CAST(count(*) FILTER (status < 400) AS BIGINT) AS success_count, CAST(count(*) FILTER (status >= 400) AS BIGINT) AS error_count"""
_SHOWN = ["sessions", "requests", "total_tokens", "total_cost", "p50_duration", "p95_duration", "success_count", "error_count"]
_ONE = lambda c: f"coalesce(max(nullif({c}, '')), '') AS {c}"


def _breakdown(spark, d, kind, *columns):
    return A.breakdown(_placed(spark, d), kind, ranked=("p50_duration", "p95_duration")).select("grain", "period_key", "tier", *columns, *_SHOWN)


@query(f"WITH {U}, {G}, {P} SELECT grain, period_key, tier, provider, model, {_ONE('provider_model')}, {M} FROM p GROUP BY grain, period_key, tier, provider, model")
def model_breakdown(spark, d):
    return _breakdown(spark, d, "model", "provider", "model", "provider_model")


@query(f"WITH {U}, {G}, {P} SELECT grain, period_key, tier, provider, {M} FROM p GROUP BY grain, period_key, tier, provider")
def provider_breakdown(spark, d):
    return _breakdown(spark, d, "provider", "provider")


@query(f"WITH {U}, {G}, {P} SELECT grain, period_key, tier, 'all' AS provider, 'all' AS model, country, {_ONE('continent')}, {M} FROM p GROUP BY grain, period_key, tier, country")
def geo_breakdown(spark, d):
    return _breakdown(spark, d, "geo", "provider", "model", "country", "continent")


@query(f"WITH {U}, {G}, {P} SELECT grain, period_key, tier, provider, model, country, {_ONE('continent')}, {M} FROM p GROUP BY grain, period_key, tier, provider, model, country")
def geo_model_breakdown(spark, d):
    return _breakdown(spark, d, "geo_model", "provider", "model", "country", "continent")


@query(f"WITH {U}, {G}, {P} SELECT country, coalesce(min(nullif(continent, '')), '') AS continent, CAST(sum(k) AS BIGINT) AS k FROM p WHERE grain = 'day' GROUP BY country")
def country_reduce(spark, d):
    return A.by_country(_placed(spark, d), "country", "continent", "k")


@query(f"WITH {U}, {G}, {P}, c AS (SELECT country, CAST(sum(k) AS BIGINT) AS tokens FROM p WHERE grain = 'day' AND country <> 'AQ' GROUP BY country HAVING sum(k) > 0) SELECT country, tokens, CAST(floor(tokens * 1000.0::DOUBLE / sum(tokens) OVER () + 0.5) AS BIGINT) AS share_pm, CAST(row_number() OVER (ORDER BY tokens DESC, country) AS INTEGER) AS rank FROM c")
def country_ranking(spark, d):
    """Countries with tokens, without Antarctica, by their share."""
    by = A.by_country(_placed(spark, d), "country", "continent", "k").filter("k > 0 and country <> 'AQ'").select("country", F.col("k").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per country
    return by.select("country", "tokens", F.floor(F.col("tokens") * 1000.0 / whole + 0.5).alias("share_pm"), F.row_number().over(Window.orderBy(F.desc("tokens"), "country")).alias("rank"))


@query(f"WITH {U} SELECT model, tier, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT session) AS BIGINT) AS sessions, CAST(sum(k) AS BIGINT) AS tokens, avg(cents) AS mean, CAST(quantile_disc(cents, 0.95) AS BIGINT) AS p95 FROM u GROUP BY ALL ORDER BY tokens DESC, model, tier LIMIT 12")
def spec_aggregate(spark, d):
    spec = [("COUNT", None), ("COUNT_DISTINCT", "session"), ("SUM", "k"), ("AVG", "cents"), ("P95", "cents")]
    return A.from_spec(usage(spark, d), ["model", "tier"], spec, 12).toDF("model", "tier", "n", "sessions", "tokens", "mean", "p95")


@query("SELECT i AS id, CAST(CASE i % 3 WHEN 0 THEN round((round((v * 2 + w * 3) / 5, 2) * 5 + 7.5 * 4) / 9, 2) WHEN 1 THEN round((v * 2 + 7.5 * 4) / 6, 2) ELSE 7.5 END AS DOUBLE) AS mean FROM (SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS v, CAST(p_size * 2 AS DOUBLE) AS w FROM part)")
def folded_means(spark, d):
    """Levels folded from left to right with a rounding at each step; levels that are missing weigh nothing."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("v"))
    m = F.col("id") % 3
    values = F.array(F.when(m != 2, F.col("v")), F.when(m == 0, F.col("v") * 2), F.lit(7.5))
    weights = F.array(F.when(m == 2, 0.0).otherwise(2.0), F.when(m == 0, 3.0).otherwise(0.0), F.lit(4.0))
    return p.select("id", A.ordered_fold(values, weights).alias("mean"))


@query(f"WITH {U}, t AS (SELECT CAST(count(DISTINCT session) AS BIGINT) AS sessions, CAST(greatest(1, ceil((epoch_us(max(time)) - epoch_us(min(time))) / 86400000000.0)) AS BIGINT) AS days, CAST(sum(cents) AS BIGINT) AS cost, CAST(sum(k) AS BIGINT) AS tokens FROM u) SELECT *, CAST(floor(cost * 1.0::DOUBLE / days) AS BIGINT) AS cost_per_day, CAST(floor(tokens * 1.0::DOUBLE / sessions) AS BIGINT) AS tokens_per_session FROM t")
def global_ratios(spark, d):
    """Totals with the days they span (one at least, begun days count) and their ratios."""
    span = (F.unix_micros(F.max(F.col("time").cast("timestamp"))) - F.unix_micros(F.min(F.col("time").cast("timestamp")))) / 86_400_000_000
    t = usage(spark, d).agg(F.countDistinct("session").alias("sessions"), F.greatest(F.lit(1), F.ceil(span)).cast("long").alias("days"), F.sum("cents").alias("cost"), F.sum("k").alias("tokens"))
    return t.withColumns({"cost_per_day": F.floor(F.col("cost") / F.col("days")), "tokens_per_session": F.floor(F.col("tokens") / F.col("sessions"))})


_WEEKS = [f"2024-W{i:02d}" for i in range(1, 6)]
_CELL = lambda w: f"CASE WHEN '{w}' < since THEN '-' ELSE CAST(CAST(coalesce(sum(cents) FILTER (week = '{w}'), 0) AS BIGINT) AS VARCHAR) END AS \"{w}\""


@query(f"WITH {U}, w AS (SELECT session, strftime(time, '%G-W%V') AS week, cents, '2024-W0' || (session % 4 + 1) AS since FROM u) SELECT session, {', '.join(map(_CELL, _WEEKS))} FROM w GROUP BY session, since")
def weekly_columns(spark, d):
    """A column per week; a dash before the week in which the session's subscription began."""
    u = usage(spark, d).select("session", X.iso_week_key(F.col("time")).alias("week"), "cents")
    wide = u.groupBy("session").pivot("week", _WEEKS).agg(F.sum("cents"))
    since = F.concat(F.lit("2024-W0"), (F.col("session") % 4 + 1).cast("string"))
    return wide.select("session", *[F.when(F.lit(w) < since, "-").otherwise(F.coalesce(F.col(f"`{w}`"), F.lit(0)).cast("string")).alias(w) for w in _WEEKS])


@query(f"WITH {U} SELECT session, CAST(coalesce(sum(cents) FILTER (model = 'purchase'), 0) AS BIGINT) AS cost, CAST(sum(k) AS BIGINT) AS additions, CAST(sum(k % 7) AS BIGINT) AS deletions, CAST(count(*) AS BIGINT) AS files FROM u GROUP BY session")
def session_diff_totals(spark, d):
    """Cost over the rows of one kind, and the totals of a session's file changes."""
    u = usage(spark, d)
    return u.groupBy("session").agg(F.coalesce(F.sum(F.when(F.col("model") == "purchase", F.col("cents"))), F.lit(0)).alias("cost"), F.sum("k").alias("additions"), F.sum(F.col("k") % 7).alias("deletions"), F.count("*").alias("files"))


@query(f"WITH {U}, h AS (SELECT session, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(right(CAST(session + 10000 AS VARCHAR), 4), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS hash FROM (SELECT DISTINCT session FROM u)), n AS (SELECT session, model, count(*) AS w FROM u GROUP BY ALL), c AS (SELECT n.*, hash, sum(w) OVER (PARTITION BY n.session ORDER BY model) AS hi, sum(w) OVER (PARTITION BY n.session) AS total FROM n JOIN h ON h.session = n.session) SELECT session, model FROM c WHERE hash % total < hi AND hash % total >= hi - w")
def sticky_choice(spark, d):
    """The weighted choice by the hash of an identifier's last four characters."""
    n = usage(spark, d).groupBy("session", "model").agg(F.count("*").alias("w")).withColumn("priority", F.lit(1))
    return analytic.weighted_choice(n, "session", "model", "w", "priority", X.string_hash((F.col("session") + 10_000).cast("string")))


# marts


@query(f"WITH {U}, {G}, {P}, b AS (SELECT period_key, provider, model, CAST(sum(k) AS BIGINT) AS tokens FROM p WHERE grain = 'week' GROUP BY ALL), m AS (SELECT * FROM b UNION ALL SELECT period_key, 'all', 'all', CAST(sum(tokens) AS BIGINT) FROM b GROUP BY period_key) SELECT provider, model, tokens FROM m WHERE period_key = '2024-W03' AND ((provider = 'all' AND model = 'all') OR (provider = 'openai' AND model = 'view'))")
def mart_lookup(spark, d):
    """A stored mart read by period: once with all key columns at their defaults, once with two given."""
    rows = A.two_grains(_placed(spark, d), "time").groupBy("grain", "period_key", "provider", "model").agg(F.sum("k").alias("tokens"))
    whole = rows.groupBy("grain", "period_key").agg(F.sum("tokens").alias("tokens")).withColumns({"provider": F.lit("all"), "model": F.lit("all")})
    path = scratch(spark)
    rows.unionByName(whole).write.partitionBy("grain").parquet(path)
    mart = spark.read.parquet(path)
    return readers.mart_period(mart, "week", "2024-W03").unionByName(readers.mart_period(mart, "week", "2024-W03", provider="openai", model="view")).select("provider", "model", "tokens")


@query(f"WITH {U}, {G} SELECT period_key, model, CAST(sum(k) AS BIGINT) AS tokens FROM g WHERE grain = 'day' GROUP BY ALL")
def mart_days(spark, d):
    rows = A.two_grains(usage(spark, d), "time").groupBy("grain", "period_key", "model").agg(F.sum("k").alias("tokens"))
    return readers.mart_daily(rows, ["model", "tokens"])


# alerts


@query(f"WITH {U}, s AS (SELECT model, CAST(count(*) FILTER ((status < 400 AND k % 2 = 0) OR (k % 2 = 1 AND k > 40 AND k <> 61)) AS BIGINT) AS total, CAST(count(*) FILTER (k % 2 = 1 AND k > 40 AND k <> 61) AS BIGINT) AS failed FROM u GROUP BY model) SELECT model, total, failed, CAST(CASE WHEN total >= 100 THEN floor(failed * 1000000.0::DOUBLE / total) ELSE 0 END AS BIGINT) AS ratio_ppm, CASE WHEN total >= 100 THEN floor(failed * 1000000.0::DOUBLE / total) ELSE 0 END >= 360000 AS triggered FROM s")
def alert_two_sources(spark, d):
    """Successes of one kind of event, failures of another with its own filter."""
    k = F.col("k")
    return alerts.two_source_ratio(usage(spark, d), "model", (F.col("status") < 400) & (k % 2 == 0), (k % 2 == 1) & (k > 40) & (k != 61), 100, 0.36)


@query(f"WITH {U}, s AS (SELECT session, avg(cents) AS v FROM u GROUP BY session) SELECT session, session || ': ' || CAST(floor(v + 0.5) AS BIGINT) || '%' AS line FROM s WHERE v > 1000")
def alert_lines(spark, d):
    fired = usage(spark, d).groupBy("session").agg(F.avg("cents").alias("v")).withColumn("triggered", F.col("v") > 1000)
    return alerts.payload(fired, "session", "v")


@query(f"WITH {U}, m AS (SELECT session, date_trunc('hour', time) AS hour, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT a.session, a.hour, a.n AS c, coalesce(b.n, 0) AS q FROM m a LEFT JOIN m b ON b.session = a.session AND b.hour = a.hour - INTERVAL 1 HOUR) SELECT session, hour, CASE WHEN c + q > 2 AND c < q THEN 'low' WHEN c <= q * 3 THEN 'idle' ELSE 'busy' END AS vote FROM p")
def throttle_vote(spark, d):
    """The vote over two neighbouring windows."""
    m = usage(spark, d).groupBy("session", F.date_trunc("hour", "time").alias("hour")).agg(F.count("*").alias("n"))
    before = m.select("session", (F.col("hour") + F.make_dt_interval(hours=F.lit(1))).alias("hour"), F.col("n").alias("before"))
    met = m.join(before, ["session", "hour"], "left")
    return met.select("session", "hour", alerts.vote(F.col("n"), F.coalesce("before", F.lit(0)), 2).alias("vote"))


# periods and limits


@query("""WITH w(kind, back) AS (VALUES ('1D', 0), ('1W', 6), ('2W', 13), ('1M', 27), ('2M', 55), ('3M', 89), ('YTD', -1), ('ALL', -2)), e AS (SELECT CAST(ts AS DATE) AS day FROM events), b AS (SELECT min(day) AS lo, max(day) AS hi FROM e),
s AS (SELECT kind, hi, CAST(greatest(lo, CASE back WHEN -1 THEN date_trunc('year', hi) WHEN -2 THEN lo ELSE hi - back END) AS DATE) AS start FROM w, b)
SELECT kind, start, CASE WHEN kind IN ('YTD', 'ALL') THEN upper(strftime(start, '%b')) ELSE upper(strftime(start, '%b')) || ' ' || day(start) END AS label, CAST((SELECT count(*) FROM e WHERE day >= start AND day <= hi) AS BIGINT) AS n FROM s""")
def usage_ranges(spark, d):
    """All ranges that end with the latest day, clipped to the earliest, with the label of their first bucket."""
    per_day = load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    both = per_day.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    kinds = spark.createDataFrame([(k,) for k in (*X.RANGES, "YTD", "ALL")], "kind string")
    s = kinds.crossJoin(F.broadcast(both)).withColumn("start", X.range_start(F.col("kind"), F.col("lo"), F.col("hi")))  # one row
    s = s.withColumn("label", X.bucket_label(F.col("start"), F.col("kind"), F.col("hi")))
    met = s.join(per_day, (F.col("day") >= F.col("start")) & (F.col("day") <= F.col("hi")))  # eight ranges
    return met.groupBy("kind", "start", "label").agg(F.sum("n").alias("n"))


@query("""WITH e AS (SELECT event_id, ['2024-W01', '2026-W53', '2025-W53', '2024-W00', '2024-53', 'x'][event_id % 6 + 1] AS key, [1700000000000, 1700000000, 10000000000, 10000000001][event_id % 4 + 1] AS n FROM events)
SELECT event_id, event_id % 6 IN (0, 1) AS week, CAST(CASE event_id % 4 WHEN 0 THEN 1700000000 WHEN 1 THEN 1700000000 WHEN 2 THEN 10000000000 ELSE 10000000 END AS BIGINT) AS seconds FROM e""")
def parsed_times(spark, d):
    e = load(spark, d, "events")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n + 1).cast("int"))
    key, number = pick(("2024-W01", "2026-W53", "2025-W53", "2024-W00", "2024-53", "x"), 6), pick((1_700_000_000_000, 1_700_000_000, 10_000_000_000, 10_000_000_001), 4)
    return e.select("event_id", X.is_week_key(key).alias("week"), F.unix_seconds(X.epoch_time(number)).alias("seconds"))


@query(f"""WITH {U}, s AS (SELECT session, CAST(sum(cents) AS BIGINT) AS usage, date_trunc('second', max(time)) AS updated FROM u GROUP BY session), n AS (SELECT *, TIMESTAMP '2024-01-29 12:00:00' AS now FROM s)
SELECT session, CASE WHEN updated < now - INTERVAL 24 HOUR OR usage < 200000 THEN 'ok' ELSE 'rate-limited' END AS status, CASE WHEN updated < now - INTERVAL 24 HOUR THEN 86400 ELSE CAST(epoch(updated + INTERVAL 24 HOUR) - epoch(now) AS BIGINT) END AS reset_s,
  CAST(CASE WHEN updated < now - INTERVAL 24 HOUR THEN 0 WHEN usage < 200000 THEN floor(usage * 100 / 200000.0) ELSE 100 END AS BIGINT) AS percent FROM n""")
def rolling_limits(spark, d):
    s = usage(spark, d).groupBy("session").agg(F.sum("cents").alias("usage"), F.date_trunc("second", F.max(F.col("time").cast("timestamp"))).alias("updated"))
    status = X.rolling_status(F.col("usage"), F.lit(200_000), F.col("updated"), 24, F.lit("2024-01-29 12:00:00").cast("timestamp"))
    return s.select("session", status.alias("s")).select("session", "s.status", "s.reset_s", "s.percent")


def _limit_sql(start: str, end: str) -> str:
    """Sessions against a window's limit at 2024-01-24 12:00."""
    return f"""WITH {U}, s AS (SELECT session, CAST(sum(cents) AS BIGINT) AS usage, date_trunc('second', max(time)) AS updated FROM u WHERE time < TIMESTAMP '2024-01-24 12:00:00' GROUP BY session)
SELECT session, CASE WHEN updated < TIMESTAMP '{start}' OR usage < 100000 THEN 'ok' ELSE 'rate-limited' END AS status, CAST(epoch(TIMESTAMP '{end}') - epoch(TIMESTAMP '2024-01-24 12:00:00') AS BIGINT) AS reset_s,
  CAST(CASE WHEN updated < TIMESTAMP '{start}' THEN 0 WHEN usage < 100000 THEN floor(usage * 100 / 100000.0) ELSE 100 END AS BIGINT) AS percent FROM s"""


def _limits(spark, d, status):
    now = F.lit("2024-01-24 12:00:00").cast("timestamp")
    s = usage(spark, d).withColumn("at", F.col("time").cast("timestamp")).filter(F.col("at") < now).groupBy("session").agg(F.sum("cents").alias("usage"), F.date_trunc("second", F.max("at")).alias("updated"))
    return s.select("session", status(F.col("usage"), F.lit(100_000), F.col("updated"), now).alias("s")).select("session", "s.status", "s.reset_s", "s.percent")


@query(_limit_sql("2024-01-22", "2024-01-29"))
def weekly_limits(spark, d):
    return _limits(spark, d, X.weekly_status)


@query(_limit_sql("2024-01-15 08:00:00", "2024-02-15 08:00:00"))
def monthly_limits(spark, d):
    """A month that begins on the day and hour of the subscription."""
    return _limits(spark, d, lambda usage, limit, updated, now: X.monthly_status(usage, limit, updated, F.lit("2023-11-15 08:00:00").cast("timestamp"), now))


# scalar functions


@query("""SELECT event_id, CASE WHEN event_id % 300 >= 100 THEN CAST(floor(k * 1000.0::DOUBLE / (event_id % 300)) AS BIGINT) END AS tps, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN k ELSE k + 5 END AS known,
  CAST(CASE event_id % 5 WHEN 0 THEN 1.5 WHEN 4 THEN -2 ELSE 0 END AS DOUBLE) AS number, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag FROM (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)""")
def safe_numbers(spark, d):
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    known = X.sum_of_known(F.when(i % 3 > 0, k), F.when(i % 3 == 2, F.lit(5).cast("long")))
    return load(spark, d, "events").select("event_id", F.floor(X.throughput(k, F.lit(0).cast("long"), i % 300)).alias("tps"), known.alias("known"), X.safe_number(pick("1.5", "x", "NaN", "Infinity", "-2")).alias("number"), X.safe_bool(pick("true", "false", "1")).alias("flag"))


@query("""SELECT p_partkey, '"' || replace(p_name || '"x', '"', '""') || '"' AS identifier, '''' || replace(p_name || '''s', '''', '''''') || '''' AS literal,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, CASE WHEN length(p_brand) = 2 THEN upper(p_brand) ELSE 'ZZ' END AS country FROM part""")
def quoted_names(spark, d):
    name = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", X.quoted_identifier(F.concat(name, F.lit('"x'))).alias("identifier"), X.quoted_literal(F.concat(name, F.lit("'s"))).alias("literal"), X.title_case(name).alias("title"), X.country(F.col("p_brand")).alias("country"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)
SELECT p_partkey, CAST(len(list_filter(list_sort(words), lambda w: w < 'm')) AS INTEGER) AS place, CAST(ceil(len(words) / 2.0) AS INTEGER) AS chunks, array_to_string(words[1:2], '+') AS first_chunk, words[-1] AS last_word FROM w""")
def array_functions(spark, d):
    words = F.split("p_name", " ")
    two = X.chunked(words, 2)
    return load(spark, d, "part").select("p_partkey", X.insert_place(F.array_sort(words), F.lit("m")).alias("place"), F.size(two).alias("chunks"), F.array_join(two[0], "+").alias("first_chunk"), F.element_at(words, -1).alias("last_word"))


@query("""SELECT event_id, '{"a":[1,{"z":null}],"b":{"c":"é","d":' || event_id || '}}' AS canonical FROM events""")
def canonical_json(spark, d):
    i = F.col("event_id").cast("string")
    return load(spark, d, "events").select("event_id", X.canonical_json(F.concat(F.lit('{ "b": {"d": '), i, F.lit(', "c":"é"}, "a": [1, {"z": null}] }'))).alias("canonical"))


@query("""SELECT event_id AS id, unnest(['$.a', '$.b.c[0]', '$.b.c[1].d']) AS path, unnest([CAST(event_id AS VARCHAR), '"x"', 'true']) AS value FROM events""")
def flat_json(spark, d):
    body = F.concat(F.lit('{"b":{"c":["x",{"d":true}]},"a":'), F.col("event_id").cast("string"), F.lit("}"))
    return log.flat_json(load(spark, d, "events").select("event_id", body.alias("body")), "event_id", "body")


@query("""WITH e AS (SELECT event_id AS id, event_id % 3 AS m FROM events) SELECT id, '$.a' AS path, CAST(id AS VARCHAR) AS a, CAST(id + 1 AS VARCHAR) AS b FROM e WHERE m = 0
UNION ALL SELECT id, '$.l[1]', '2', NULL FROM e WHERE m = 1 UNION ALL SELECT id, '$.n.x', NULL, '"new"' FROM e WHERE m = 2""")
def json_differences(spark, d):
    i, m = F.col("event_id").cast("string"), F.col("event_id") % 3
    body = lambda a, l, n: F.concat(F.lit('{"l":'), l, F.lit(',"a":'), a, F.lit(',"n":'), n, F.lit("}"))
    left = body(i, F.lit("[1,2]"), F.lit('{"y":1}'))
    right = body(F.when(m == 0, (F.col("event_id") + 1).cast("string")).otherwise(i), F.when(m == 1, "[1]").otherwise("[1,2]"), F.when(m == 2, '{"x":"new","y":1}').otherwise('{"y":1}'))
    return log.deep_diff(load(spark, d, "events").select("event_id", left.alias("a"), right.alias("b")), "event_id", "a", "b")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 END::BIGINT AS input, CAST(10 AS BIGINT) AS output, array_to_string(list_sort(CASE WHEN event_id % 2 = 0 THEN ['a=new', 'b=' || event_id, 'c=x'] ELSE ['a=old', 'c=x'] END), ',') AS metadata FROM events""")
def usage_vectors(spark, d):
    """Two usages added field by field, and the maps beside them merged with the later one winning."""
    i = F.col("event_id")
    n = lambda x: F.lit(x).cast("long")
    one = F.struct(*[(F.when(i % 3 < 2, n(3)) if f == "input" else n(4) if f == "output" else n(None)).alias(f) for f in X.USAGE_FIELDS])
    two = F.struct(*[(F.when(i % 3 == 0, n(4)) if f == "input" else n(6) if f == "output" else n(None)).alias(f) for f in X.USAGE_FIELDS])
    first = F.create_map(F.lit("a"), F.lit("old"), F.lit("c"), F.lit("x"))
    later = F.when(i % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), i.cast("string")))
    merged = F.array_sort(F.transform(F.map_entries(X.merged_maps(first, later)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return load(spark, d, "events").select("event_id", X.sum_usage(one, two).alias("u"), F.array_join(merged, ",").alias("metadata")).select("event_id", "u.input", "u.output", "metadata")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND value > 10 AND (path = '/a' OR starts_with(path, '/a/') OR (path IS NULL AND directory = '/a'))".replace("FROM events", "FROM (SELECT *, ['/a', '/a/b', '/ab', NULL, NULL][event_id % 5 + 1] AS path, ['/x', '/x', '/a', '/a', '/b'][event_id % 5 + 1] AS directory FROM events)"))
def under_directory(spark, d):
    """Optional conditions, of which two are given, and rows at or below a path."""
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 5 + 1).cast("int"))
    e = load(spark, d, "events").withColumns({"path": pick("/a", "/a/b", "/ab", None, None), "directory": pick("/x", "/x", "/a", "/a", "/b")})
    return e.filter(X.all_of(F.col("event_type") == "view", None, F.col("value") > 10, X.under_path(F.col("path"), F.col("directory"), "/a"))).select("event_id")


@query("WITH r AS (SELECT event_id, event_type AS x, 'u' || (user_id % 10) AS y FROM events) SELECT event_id, CASE WHEN y = 'u7' THEN 'deny' WHEN x = 'view' THEN 'allow' WHEN x LIKE 'c%' THEN 'deny' ELSE 'ask' END AS action FROM r")
def rule_table(spark, d):
    """Rules in a table, the last one that fits deciding."""
    rules = spark.createDataFrame([(1, "^c", ".*", "deny"), (2, "^view$", ".*", "allow"), (3, ".*", "^u7$", "deny")], "ordinal int, px string, py string, action string")
    asked = load(spark, d, "events").select("event_id", F.col("event_type").alias("x"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("y"))
    return classify.last_match_rows(asked, rules, "event_id", "x", "y")


# paging and listings


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' OR (o_orderdate = TIMESTAMP '1995-06-01' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def ascending_page(spark, d):
    at = F.lit("1995-06-01").cast("timestamp_ntz")
    return paging.keyset(load(spark, d, "orders"), "o_orderdate", "o_orderkey", 50, (at, 100), newest_first=False).select("o_orderkey")


@query("WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, n > 40 AS has_more FROM p WHERE rn <= 40")
def page_with_more(spark, d):
    return paging.page_with_more(load(spark, d, "orders"), "o_orderdate", "o_orderkey", 40).select("o_orderkey", "has_more")


@query("WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, left(line, 80) AS line, (doc_id * 7919) % 1009 AS modified FROM l WHERE regexp_matches(line, 'est[a-z]+')) SELECT doc_id, line_number, line, CAST(count(*) OVER () AS BIGINT) AS total FROM m QUALIFY row_number() OVER (ORDER BY modified DESC, doc_id, line_number) <= 100")
def grep_newest(spark, d):
    """Matches of the files modified last come first: a hundred of them, in their files' order, with the total."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    found = text.grep(docs, "doc_id", "text", "est[a-z]+", cut=80).withColumn("modified", (F.col("doc_id") * 7919) % 1009)
    return paging.newest(found, "modified", ["doc_id", "line_number"], 100).select("doc_id", "line_number", "line", "total")


# edits and histories

#: Contents with what is looked for and put in its place, and what must come out, for each of the nine matchers and both errors.
EDITS = (
    ("one two three", "two", "2", "one 2 three"),
    ("  a = 1\n    b = 2\n", "a = 1\nb = 2", "c", "c\n"),
    ("begin\n  x = 1\n  y = 2\nend\nrest", "begin\n  x = 9\n  z = 2\nend", "done", "done\nrest"),
    ("let  a   =  1; // n", "a = 1;", "b = 2;", "let  b = 2; // n"),
    ("if x:\n        one\n            two\n", "    one\n        two", "three", "if x:\nthree\n"),
    ("say 'a\tb' now", "'a\\tb'", "it", "say it now"),
    ("keep this word", "  this \n", "that", "keep that word"),
    ("x\nx", "x", "y", None),
    ("nothing here", "missing", "found", None),
)
_EDITS = ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in row)]) + ")" for i, row in enumerate(EDITS))


@query(f"SELECT event_id AS id, CASE WHEN result IS NOT NULL THEN '#' || event_id || chr(10) || result END AS content, CASE WHEN result IS NULL THEN CASE WHEN i = 7 THEN 'found more than once' ELSE 'not found' END END AS error FROM events JOIN (VALUES {_EDITS}) v(i, content, old, new, result) ON i = event_id % {len(EDITS)}")
def replacements(spark, d):
    pick = lambda at: F.element_at(F.array(*[F.lit(row[at]) for row in EDITS]), (F.col("event_id") % len(EDITS) + 1).cast("int"))
    e = load(spark, d, "events")
    content = F.concat(F.lit("#"), F.col("event_id").cast("string"), F.lit("\n"), pick(0))
    return text.apply_replacements(e.select(F.col("event_id").alias("id"), content.alias("content"), pick(1).alias("old"), pick(2).alias("new"), F.lit(False).alias("everywhere")))


def _fnv_sql(x: str) -> str:
    h = f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296)"
    digit = "substr('0123456789abcdefghijklmnopqrstuvwxyz', 1 + CAST(({h} // CAST(pow(36, p) AS BIGINT)) % 36 AS INTEGER), 1)"
    return f"ltrim(array_to_string(list_transform(range(6, -1, -1), lambda p: {digit.format(h=h)}), ''), '0')"


@query(f"""WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, 5)) AS i, substr(text, 1 + CAST(greatest(0, least(n - 64, unnest([0, floor(n * 0.25), floor(n * 0.5), floor(n * 0.75), n - 64]) - 32)) AS INTEGER), 64) AS part FROM t WHERE n > 1000),
s AS (SELECT doc_id, n || ':' || string_agg({_fnv_sql("part")}, ':' ORDER BY i) AS sampled FROM p GROUP BY doc_id, n)
SELECT t.doc_id, CASE WHEN n > 0 AND n <= 1000 THEN {_fnv_sql("text")} END AS whole, CASE WHEN n > 1000 THEN sampled WHEN n > 0 THEN {_fnv_sql("text")} END AS sampled FROM t LEFT JOIN s ON s.doc_id = t.doc_id""")
def text_checksums(spark, d):
    """Checksums of whole texts, and of five samples of long ones."""
    x = F.col("text")
    return load(spark, d, "documents").select("doc_id", F.when(F.length(x) <= 1000, X.fnv1a(x)).alias("whole"), X.sampled_checksum(x, 1000, 64).alias("sampled"))


@query("SELECT doc_id AS id, md5(coalesce(text, '') || chr(10) || 'done ' || doc_id || chr(10) || coalesce(text, '')) AS content, CAST(NULL AS VARCHAR) AS error FROM documents")
def document_edits(spark, d):
    """A block in the midst of whole documents, found by its trimmed lines and, in every other one, by its first and last line."""
    i, text_ = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    content = F.concat(text_, F.lit("\n  begin "), i, F.lit("\n    value = 1\n\tend "), i, F.lit("\n"), text_)
    old = F.concat(F.lit("begin "), i, F.when(F.col("doc_id") % 2 == 0, "\nvalue = 1\nend ").otherwise("\nvalue = 12\nend "), i)
    edits = load(spark, d, "documents").select(F.col("doc_id").alias("id"), content.alias("content"), old.alias("old"), F.concat(F.lit("done "), i).alias("new"), F.lit(False).alias("everywhere"))
    return text.apply_replacements(edits).withColumn("content", F.md5("content"))


@query("SELECT 'f' || event_id AS file, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 50 END AS additions, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 20 END AS deletions, CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS status FROM events")
def diff_stats(spark, d):
    i = F.col("event_id")
    name = F.concat(F.lit("f"), i.cast("string"))
    e = load(spark, d, "events")
    numbers = e.select(F.concat_ws("\t", F.when(i % 4 == 0, "-").otherwise((i % 50).cast("string")), F.when(i % 4 == 0, "-").otherwise((i % 20).cast("string")), name).alias("line"))
    letters = e.select(F.concat_ws("\t", F.when(i % 3 == 0, "A").when(i % 3 == 1, "D").otherwise("R100"), name).alias("line"))
    return text.diff_stats(numbers, letters)


@query("SELECT event_id, 'accept=' || event_id || ',authorization=[REDACTED]' AS headers FROM events")
def redacted_headers(spark, d):
    raw = F.create_map(F.lit("Authorization"), F.lit("secret"), F.lit("ACCEPT"), F.col("event_id").cast("string"), F.lit("Other"), F.lit("x"))
    kept = text.redact_headers(raw, ("accept", "authorization"))
    return load(spark, d, "events").select("event_id", F.array_join(F.transform(kept, lambda h: F.concat_ws("=", h["name"], h["value"])), ",").alias("headers"))


@query("""WITH c AS (SELECT conv_id, turn, bool_or(turn = 2 AND role = 'user') OVER (PARTITION BY conv_id) AND bool_or(turn = 3 AND role = 'assistant') OVER (PARTITION BY conv_id) AS long FROM conversations), s AS (SELECT *, CASE WHEN NOT long THEN turn WHEN conv_id % 2 = 0 THEN turn - 2 WHEN turn IN (2, 3) THEN turn - 2 WHEN turn = 1 THEN 2 ELSE turn - 1 END AS position FROM c WHERE NOT long OR turn >= 2 OR (conv_id % 2 = 1 AND turn = 1))
SELECT CAST(conv_id AS VARCHAR) AS session, CAST(position AS BIGINT) AS position, 'm' || turn AS id FROM s""")
def visible_history(spark, d):
    """Turn 2 is a compaction that turn 3 answers; in odd conversations turn 1 is kept as a tail and comes after the summary."""
    c = load(spark, d, "conversations")
    t, name = F.col("turn"), lambda x: F.concat(F.lit("m"), x.cast("string"))
    rows = c.select(
        F.col("conv_id").cast("string").alias("session"), name(t).alias("id"), "role", F.when(t == 3, "m2").alias("parent"), (t == 3).alias("summary"), (t == 3).alias("finished"),
        F.lit(False).alias("failed"), (t == 2).alias("compacts"), F.when((t == 2) & (F.col("conv_id") % 2 == 1), "m1").alias("tail_start"),
    )
    return log.visible_history(rows)


@query("""WITH l AS (SELECT conv_id, max(turn) AS latest FROM conversations WHERE turn < 3 GROUP BY conv_id), i AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'b' ELSE 'a' END AS owner FROM conversations WHERE turn >= 2)
SELECT i.conv_id, turn, CASE WHEN latest IS NOT NULL AND owner = 'b' THEN 'foreign' WHEN turn <= coalesce(latest, -1) THEN 'seen' ELSE 'append' END AS verdict FROM i LEFT JOIN l ON l.conv_id = i.conv_id""")
def owned_append(spark, d):
    """Events of another owner than the log's are refused."""
    c = load(spark, d, "conversations").select("conv_id", "turn")
    incoming = c.filter("turn >= 2").withColumn("owner", F.when(F.col("conv_id") % 3 == 0, "b").otherwise("a"))
    return log.appendable(c.filter("turn < 3").withColumn("owner", F.lit("a")), incoming, "conv_id", "turn", "owner").select("conv_id", "turn", "verdict")


@query("WITH c AS (SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 5 <> 0) SELECT conv_id, CAST(count(*) AS BIGINT) AS events, min(turn) AS first, max(turn) AS last, max(turn) - min(turn) + 1 = count(*) AS ok FROM c GROUP BY conv_id")
def replay_all(spark, d):
    rows = load(spark, d, "conversations").filter("(conv_id + turn) % 5 <> 0").select("conv_id", "turn")
    return log.replayable(rows, "conv_id", "turn")
