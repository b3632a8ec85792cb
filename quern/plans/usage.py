"""Usage analytics over the event table: leaderboards, rollups, shares, changes, costs, counters, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.operators import aggregate as A
from quern.operators import alerts, analytic, joins
from quern.plans.registry import query
from quern.session import load
from quern.streaming import counters


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Events as usage rows: the user is the session, the event type the model, cents the cost and duration, k the tokens."""
    k = F.get_json_object("props", "$.k").cast("long")
    tier = F.when(k < 34, "Go").when(k < 67, "Free").otherwise("Paid")
    cents = F.round(F.col("value") * 100).cast("long")
    return load(spark, d, "events").select("event_id", F.col("ts").alias("time"), F.col("user_id").alias("session"), F.col("event_type").alias("model"), cents.alias("cents"), k.alias("k"), tier.alias("tier"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))


U = """u AS (SELECT event_id, ts AS time, user_id AS session, event_type AS model, CAST(round(value * 100) AS BIGINT) AS cents,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CASE WHEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) < 34 THEN 'Go' WHEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) < 67 THEN 'Free' ELSE 'Paid' END AS tier FROM events)"""
G = """g AS (SELECT *, 'day' AS grain, strftime(time, '%Y-%m-%d') AS period_key FROM u UNION ALL SELECT *, 'week', strftime(time, '%G-W%V') FROM u)"""
B = """b AS (SELECT grain, period_key, tier, model, CAST(count(DISTINCT session) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS requests, CAST(sum(k) AS BIGINT) AS total_tokens, CAST(sum(cents) AS BIGINT) AS total_cost,
  CAST(quantile_disc(cents, 0.5) AS DOUBLE) AS p50, avg(cents) AS mean, CAST(count(*) FILTER (status < 400) AS BIGINT) AS success_count, CAST(count(*) FILTER (status >= 400) AS BIGINT) AS error_count FROM g GROUP BY ALL)"""
C = """c AS (SELECT grain, period_key, tier, model, sessions, requests, total_tokens, total_cost, p50, mean, success_count, error_count FROM b UNION ALL
  SELECT grain, period_key, 'all', model, CAST(sum(sessions) AS BIGINT), CAST(sum(requests) AS BIGINT), CAST(sum(total_tokens) AS BIGINT), CAST(sum(total_cost) AS BIGINT), CASE WHEN count(*) = 1 THEN max(p50) END,
  CASE WHEN count(*) = 1 THEN max(mean) ELSE round(sum(mean * requests) / sum(requests), 2) END, CAST(sum(success_count) AS BIGINT), CAST(sum(error_count) AS BIGINT) FROM b GROUP BY grain, period_key, model)"""


def _rolled(spark, d, *ranked: str) -> DataFrame:
    rows = usage(spark, d).withColumn("total_tokens", F.col("k")).withColumn("total_cost", F.col("cents")).withColumn("duration", F.col("cents"))
    return A.with_all_tier(A.aggregate(rows, ["model"], ranked=ranked), ["grain", "period_key", "model"])


@query(f"WITH {U}, {G}, {B}, {C} SELECT grain, period_key, model, sessions, requests, total_tokens, CAST(row_number() OVER (PARTITION BY grain, period_key ORDER BY total_tokens DESC, model) AS INTEGER) AS rank, CAST(floor(total_tokens * 1000000 / sum(total_tokens) OVER (PARTITION BY grain, period_key) + 0.5) AS BIGINT) AS share_ppm FROM c WHERE tier = 'all' QUALIFY row_number() OVER (PARTITION BY grain, period_key ORDER BY total_tokens DESC, model) <= 18")
def leaderboard_week_day(spark, d):
    rows = _rolled(spark, d).filter("tier = 'all'")
    ranked = analytic.shares(analytic.ranks(rows, ["grain", "period_key"], ["total_tokens"], ["model"]), ["grain", "period_key"], "total_tokens")
    return ranked.filter("rank_total_tokens <= 18").select("grain", "period_key", "model", "sessions", "requests", "total_tokens", F.col("rank_total_tokens").alias("rank"), F.floor(F.col("share") * 1_000_000 + 0.5).alias("share_ppm"))


@query(f"WITH {U}, {G}, {B}, {C} SELECT grain, period_key, tier, model, sessions, requests, total_tokens, total_cost, p50, success_count, error_count FROM c")
def all_tier_rollup(spark, d):
    return _rolled(spark, d, "p50_duration").select("grain", "period_key", "tier", "model", "sessions", "requests", "total_tokens", "total_cost", F.col("p50_duration").alias("p50"), "success_count", "error_count")


@query(f"WITH {U}, {G}, {B}, {C} SELECT grain, period_key, model, requests, round(mean, 1) AS mean FROM c WHERE tier = 'all'")
def collapse_weighted(spark, d):
    return _rolled(spark, d).filter("tier = 'all'").select("grain", "period_key", "model", "requests", F.round("avg_duration", 1).alias("mean"))


@query(f"WITH {U}, {G}, {B} SELECT grain, period_key, tier, model, CAST(row_number() OVER (PARTITION BY grain, period_key, tier ORDER BY requests DESC, model) AS INTEGER) AS rank_requests, CAST(row_number() OVER (PARTITION BY grain, period_key, tier ORDER BY sessions DESC, model) AS INTEGER) AS rank_sessions, CAST(row_number() OVER (PARTITION BY grain, period_key, tier ORDER BY total_tokens DESC, model) AS INTEGER) AS rank_total_tokens, CAST(row_number() OVER (PARTITION BY grain, period_key, tier ORDER BY total_cost DESC, model) AS INTEGER) AS rank_total_cost FROM b")
def rank_4way(spark, d):
    rows = _rolled(spark, d).filter("tier <> 'all'")
    m = ["requests", "sessions", "total_tokens", "total_cost"]
    return analytic.ranks(rows, ["grain", "period_key", "tier"], m, ["model"]).select("grain", "period_key", "tier", "model", *[f"rank_{x}" for x in m])


@query("WITH r AS (SELECT r_name AS region, n_name AS nation, year(o_orderdate) AS year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL) SELECT region, nation, CAST(year AS INTEGER) AS year, revenue, CAST(floor(revenue * 1000000 / sum(revenue) OVER (PARTITION BY region, year)) AS BIGINT) AS share_ppm FROM r")
def market_share(spark, d):
    o, c, n, r = (load(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    grouped = joined.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.year("o_orderdate").alias("year")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("revenue"))
    total = F.sum("revenue").over(Window.partitionBy("region", "year"))
    return grouped.withColumn("share_ppm", F.floor(F.col("revenue") * 1_000_000 / total).cast("long"))


@query("WITH s AS (SELECT o_orderstatus AS bucket, c_mktsegment || '/' || o_orderpriority AS name, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY amount DESC, name) AS rn FROM s) SELECT bucket, CASE WHEN rn <= 8 THEN name ELSE 'Other' END AS name, CAST(sum(amount) AS BIGINT) AS amount FROM r GROUP BY ALL")
def topk_other_bucketed(spark, d):
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderstatus").alias("bucket"), F.concat("c_mktsegment", F.lit("/"), "o_orderpriority").alias("name"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    return analytic.top_with_other(rows, ["bucket"], "name", "amount", 8)


@query("WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS bucket, c_mktsegment || '/' || o_orderpriority AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders JOIN customer ON c_custkey = o_custkey), t AS (SELECT name FROM s GROUP BY name ORDER BY sum(amount) DESC, name LIMIT 6) SELECT bucket, coalesce(t.name, 'Other') AS name, CAST(sum(amount) AS BIGINT) AS amount FROM s LEFT JOIN t ON t.name = s.name GROUP BY ALL")
def topk_other_frozen(spark, d):
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.date_format("o_orderdate", "yyyy-MM").alias("bucket"), F.concat("c_mktsegment", F.lit("/"), "o_orderpriority").alias("name"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"))
    return analytic.frozen_top_with_other(rows, "bucket", "name", "amount", 6)


@query(f"WITH {U}, s AS (SELECT model, CAST(coalesce(sum(k) FILTER (time >= TIMESTAMP '2024-01-15'), 0) AS BIGINT) AS current, CAST(coalesce(sum(k) FILTER (time < TIMESTAMP '2024-01-15'), 0) AS BIGINT) AS previous FROM u WHERE time >= TIMESTAMP '2024-01-08' AND time < TIMESTAMP '2024-01-22' GROUP BY model) SELECT *, CAST(CASE WHEN previous <= 0 THEN 100 ELSE floor((current - previous) * 100.0::DOUBLE / previous + 0.5) END AS BIGINT) AS change FROM s WHERE current > 0")
def period_change(spark, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return analytic.period_change(usage(spark, d), ["model"], "time", t("2024-01-08"), t("2024-01-15"), t("2024-01-22"), "k")


@query(f"WITH {U}, s AS (SELECT model, CAST(sum(k) AS BIGINT) AS cached, CAST(sum(k + cents) AS BIGINT) AS total FROM u GROUP BY model) SELECT model, cached, CAST(floor(cached * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS ratio FROM s ORDER BY ratio DESC, cached DESC LIMIT 17")
def cache_ratio(spark, d):
    s = usage(spark, d).groupBy("model").agg(F.sum("k").alias("cached"), F.sum(F.col("k") + F.col("cents")).alias("total"))
    return s.select("model", "cached", F.floor(F.col("cached") * 100 / F.col("total") + 0.5).alias("ratio")).orderBy(F.desc("ratio"), F.desc("cached")).limit(17)


@query(f"WITH {U} SELECT model, CAST(floor(sum(cents) * 1000000.0::DOUBLE / sum(k) + 0.5) AS BIGINT) AS cents_per_million FROM u GROUP BY model HAVING sum(k) > 0 ORDER BY cents_per_million, model LIMIT 17")
def cost_per_million(spark, d):
    s = usage(spark, d).groupBy("model").agg(F.sum("cents").alias("c"), F.sum("k").alias("t")).filter("t > 0")
    return s.select("model", F.floor(F.col("c") * 1_000_000 / F.col("t") + 0.5).alias("cents_per_million")).orderBy("cents_per_million", "model").limit(17)


@query(f"WITH {U} SELECT CAST(time + INTERVAL 330 MINUTE AS DATE) AS day, model, tier, CAST(sum(cents) AS BIGINT) AS cents FROM u GROUP BY ALL")
def usage_by_local_day(spark, d):
    return usage(spark, d).groupBy(X.local_day(F.col("time"), "+05:30").alias("day"), "model", "tier").agg(F.sum("cents").alias("cents"))


@query(f"WITH {U}, s AS (SELECT strftime(time, '%Y-%m-%d') AS day, CAST(coalesce(sum(cents) FILTER (tier = 'Go'), 0) AS BIGINT) AS go_cents, CAST(coalesce(sum(cents) FILTER (tier = 'Free'), 0) AS BIGINT) AS free_cents, CAST(count(*) FILTER (tier = 'Paid') AS BIGINT) AS paid_requests, CAST(count(*) AS BIGINT) AS requests FROM u WHERE time >= (SELECT max(time) FROM u) - INTERVAL 28 DAY GROUP BY 1) SELECT * FROM s UNION ALL SELECT 'TOTAL', CAST(sum(go_cents) AS BIGINT), CAST(sum(free_cents) AS BIGINT), CAST(sum(paid_requests) AS BIGINT), CAST(sum(requests) AS BIGINT) FROM s HAVING count(*) > 0")
def usage_28d_total_row(spark, d):
    u = usage(spark, d)
    newest = u.agg(F.max("time").alias("newest"))
    recent = u.crossJoin(F.broadcast(newest)).filter(F.col("time") >= F.col("newest") - F.make_dt_interval(days=F.lit(28)))  # one row
    part = lambda t: F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("cents"))), F.lit(0))
    s = recent.groupBy(X.day_key(F.col("time")).alias("day")).agg(part("Go").alias("go_cents"), part("Free").alias("free_cents"), F.count_if(F.col("tier") == "Paid").alias("paid_requests"), F.count("*").alias("requests"))
    return A.with_total(s, "day")


@query(f"WITH {U}, s AS (SELECT model, CAST(count(*) FILTER (time >= TIMESTAMP '2024-01-20' AND time < TIMESTAMP '2024-01-21') AS BIGINT) AS total, CAST(count(*) FILTER (time >= TIMESTAMP '2024-01-20' AND time < TIMESTAMP '2024-01-21' AND k >= 50) AS BIGINT) AS failed FROM u GROUP BY model) SELECT model, total, failed, CAST(CASE WHEN total >= 15 THEN floor(failed * 1000000 / total) ELSE 0 END AS BIGINT) AS ratio_ppm, CASE WHEN total >= 15 THEN floor(failed * 1000000 / total) ELSE 0 END >= 500000 AS triggered FROM s")
def alert_error_ratio(spark, d):
    u = usage(spark, d)
    inside = (F.col("time") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("time") < F.lit("2024-01-21").cast("timestamp_ntz"))
    return alerts.ratio(u, "model", inside, inside & (F.col("k") >= 50), 15, 0.5)


@query(f"WITH {U}, s AS (SELECT session, CAST(count(*) AS BIGINT) AS n, CAST(quantile_disc(k, 0.5) AS DOUBLE) AS m FROM u WHERE status < 400 GROUP BY session) SELECT session, n, CASE WHEN n >= 20 THEN m ELSE 999 END AS p50, CASE WHEN n >= 20 THEN m ELSE 999 END <= 45 AS triggered FROM s")
def alert_low_tps(spark, d):
    return alerts.low_median(usage(spark, d), "session", "k", F.col("status") < 400, 20, 45.0)


@query(f"WITH {U}, a AS (SELECT model, epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', time)) AS age FROM u), s AS (SELECT model, CAST(count(*) FILTER (age >= 0 AND age < 43200) AS BIGINT) AS current, CAST(count(*) FILTER (age >= 86400 AND age < 129600) AS BIGINT) AS baseline FROM a WHERE age >= 0 AND age < 129600 GROUP BY model) SELECT *, (current - baseline) * 100 >= baseline * 50 AS triggered FROM s")
def alert_baseline(spark, d):
    return alerts.against_baseline(usage(spark, d), "time", "model", F.lit("2024-01-20").cast("timestamp"), 43_200, 1440, 50)


@query(f"WITH {U} SELECT date_trunc('hour', time) AS window_start, model, CAST(sum(k) AS BIGINT) AS total FROM u GROUP BY ALL")
def tumbling_hour(spark, d):
    u = usage(spark, d).withColumn("time", F.col("time").cast("timestamp"))
    return counters.tumbling(u, "time", ["model"], F.col("k"), "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH {U}, m AS (SELECT date_trunc('minute', time) AS w, model, k FROM u), t AS (SELECT w, model, k FROM m UNION ALL SELECT w - INTERVAL 1 MINUTE, model, k FROM m) SELECT w AS window_start, model, CAST(sum(k) AS BIGINT) AS total FROM t GROUP BY ALL")
def sliding_two_minutes(spark, d):
    u = usage(spark, d).withColumn("time", F.col("time").cast("timestamp"))
    return counters.tumbling(u, "time", ["model"], F.col("k"), "2 minutes", "1 minute").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""WITH RECURSIVE {U}, o AS (SELECT session, CAST(floor(epoch(time)) AS BIGINT) AS t, cents, row_number() OVER (PARTITION BY session ORDER BY CAST(floor(epoch(time)) AS BIGINT), cents) AS rn FROM u),
r AS (SELECT session, rn, t AS anchor, cents AS usage FROM o WHERE rn = 1 UNION ALL
  SELECT o.session, o.rn, CASE WHEN r.anchor >= o.t - 18000 THEN r.anchor ELSE o.t END, CASE WHEN r.anchor >= o.t - 18000 THEN r.usage + o.cents ELSE o.cents END FROM r JOIN o ON o.session = r.session AND o.rn = r.rn + 1)
SELECT session, anchor, usage FROM r QUALIFY row_number() OVER (PARTITION BY session ORDER BY rn DESC) = 1""")
def rolling_reset_usage(spark, d):
    return counters.rolling_usage_batch(usage(spark, d), "session", "time", "cents", 18_000)


@query(f"WITH {U}, l AS (SELECT max(date_trunc('minute', time)) AS m FROM u), s AS (SELECT unnest(range(0, 30)) AS i), grid AS (SELECT model, m - i * INTERVAL 1 MINUTE AS minute FROM (SELECT DISTINCT model FROM u), s, l) SELECT grid.model, CAST(strftime(minute, '%Y%m%d%H%M') AS BIGINT) AS minute, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM grid LEFT JOIN u ON u.model = grid.model AND date_trunc('minute', u.time) = minute GROUP BY ALL")
def dense_minute_grid(spark, d):
    u = usage(spark, d)
    rows = u.groupBy("model", X.minute_key(F.col("time")).alias("minute")).agg(F.sum("k").alias("total"))
    newest = u.agg(F.date_trunc("minute", F.max("time")).alias("m"))
    steps = newest.select(F.explode(F.sequence(F.col("m") - F.make_dt_interval(mins=F.lit(29)), F.col("m"), F.make_dt_interval(mins=F.lit(1)))).alias("at")).select(X.minute_key(F.col("at")).alias("minute"))
    return joins.dense(rows, u.select("model").distinct(), steps, ["model", "minute"], {"total": 0})


@query(f"WITH {U} SELECT session, CAST(date_diff('day', min(time), max(time)) AS BIGINT) AS span_days, CAST(count(*) AS BIGINT) AS events, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT session, CAST(time AS DATE) AS time, k, cents FROM u) GROUP BY session")
def session_stats(spark, d):
    return usage(spark, d).groupBy("session").agg(F.datediff(F.max(F.to_date("time")), F.min(F.to_date("time"))).cast("long").alias("span_days"), F.count("*").alias("events"), F.sum("k").alias("tokens"), F.sum("cents").alias("cents"))


@query(f"WITH {U}, s AS (SELECT session, sum(k) AS k FROM u GROUP BY session) SELECT median(k) AS median_tokens, CAST(count(*) AS BIGINT) AS sessions FROM s")
def median_tokens(spark, d):
    per = usage(spark, d).groupBy("session").agg(F.sum("k").alias("k"))
    return analytic.median(per, "k").select(F.col("median").alias("median_tokens"), F.col("n").alias("sessions"))


@query(f"WITH {U} SELECT session, model, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY ALL")
def tool_usage_map(spark, d):
    rows = usage(spark, d).groupBy("session", "model").agg(F.count("*").alias("n"))
    mapped = A.as_map(rows, ["session"], "model", "n")
    return mapped.select("session", F.explode("entries").alias("model", "n"))


@query(f"WITH {U}, w AS (SELECT *, date_trunc('day', time) AS day FROM u), r AS (SELECT min(day) AS lo, max(day) AS hi FROM w) SELECT CAST(least(floor(date_diff('millisecond', lo, time) / (date_diff('millisecond', lo, hi) / 7.0)), 6) AS INTEGER) AS slice, CAST(count(*) AS BIGINT) AS n FROM w, r WHERE time >= lo AND time <= hi GROUP BY 1")
def equal_slices(spark, d):
    u = usage(spark, d)
    day = F.date_trunc("day", F.col("time"))
    both = u.crossJoin(F.broadcast(u.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))))  # one row
    return both.withColumn("slice", analytic.equal_slices(F.col("time").cast("timestamp"), F.col("lo").cast("timestamp"), F.col("hi").cast("timestamp"), 7)).filter("slice is not null").groupBy("slice").agg(F.count("*").alias("n"))


@query(f"WITH {U}, m AS (SELECT session, sum(cents) AS cost, max(k) AS age FROM u GROUP BY session), s AS (SELECT session, cost * 0.8::DOUBLE / max(cost) OVER () + age * 0.2::DOUBLE / max(age) OVER () AS score FROM m) SELECT session, CAST(floor(score * 1000000) AS BIGINT) AS score FROM s ORDER BY s.score, session LIMIT 10")
def min_max_score(spark, d):
    m = usage(spark, d).groupBy("session").agg(F.sum("cents").alias("cost"), F.max("k").alias("age"))
    return analytic.min_max_score(m, "cost", "age").orderBy("score", "session").limit(10).select("session", F.floor(F.col("score") * 1_000_000).alias("score"))


@query(f"WITH {U}, n AS (SELECT session, model, count(*) AS w FROM u GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY session ORDER BY model) AS hi, sum(w) OVER (PARTITION BY session) AS total FROM n) SELECT session, model FROM c WHERE (session * 7919) % total < hi AND (session * 7919) % total >= hi - w")
def weighted_choice(spark, d):
    n = usage(spark, d).groupBy("session", "model").agg(F.count("*").alias("w")).withColumn("priority", F.lit(1))
    return analytic.weighted_choice(n, "session", "model", "w", "priority", F.col("session") * 7919)


@query(f"WITH {U}, f AS (SELECT session, max(CASE WHEN tier = 'Go' THEN 1 ELSE 0 END) AS g FROM u GROUP BY session) SELECT CAST(sum(g) AS BIGINT) AS with_go, CAST(count(*) AS BIGINT) AS sessions, CAST((SELECT count(*) FROM u WHERE tier <> 'Go') AS BIGINT) AS others FROM f")
def count_subquery(spark, d):
    u = usage(spark, d)
    u.createOrReplaceTempView("quern_usage")
    return spark.sql("SELECT count_if(g) AS with_go, count(*) AS sessions, (SELECT count(*) FROM quern_usage WHERE tier <> :tier) AS others FROM (SELECT session, bool_or(tier = :tier) AS g FROM quern_usage GROUP BY session)", args={"tier": "Go"})
