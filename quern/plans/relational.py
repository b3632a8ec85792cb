"""Relational breadth over the star schema: joins, pivots, densification, paging, sets, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.operators import analytic, joins, paging
from quern.plans.registry import query
from quern.session import load, scratch

def _cents():
    return F.round(F.col("o_totalprice") * 100).cast("long")


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_name <> 'CHINA' LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_suppkey = -1")
def star_auth_join(spark, d):
    o, c, n, r, s = (load(spark, d, t) for t in ("orders", "customer", "nation", "region", "supplier"))
    out = o.join(c, o.o_custkey == c.c_custkey).join(n, (n.n_nationkey == c.c_nationkey) & (n.n_name != "CHINA"), "left").join(r, r.r_regionkey == n.n_regionkey, "left").join(s, s.s_suppkey == -1, "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS open_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def left_join_on_filter(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    return c.join(o, (o.o_custkey == c.c_custkey) & (o.o_orderstatus == "O"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("open_orders"))


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS key_name FROM customer")
def left_join_never(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    return c.join(s, F.lit(False), "left").select("c_custkey", F.col("s_name").alias("key_name"))


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(spark, d):
    s, n = load(spark, d, "supplier"), load(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("n_name", "s_suppkey")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def full_join(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    return c.join(s, (c.c_nationkey == s.s_nationkey) & (c.c_custkey == s.s_suppkey), "full").select("c_custkey", "s_suppkey")


@query("SELECT o_orderkey, r_name FROM orders, region WHERE r_regionkey = 2")
def constant_key_join(spark, d):
    o, r = load(spark, d, "orders"), load(spark, d, "region")
    return o.crossJoin(F.broadcast(r.filter("r_regionkey = 2"))).select("o_orderkey", "r_name")  # one row


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_key_list(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    return c.join(o.filter("o_totalprice > 400000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_acctbal < 0")
def disjunctive_semi(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    used = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    return c.join(used, c.c_custkey == used.k, "left").filter("k is not null or c_acctbal < 0").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_pending(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    return c.join(o.filter("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT s_suppkey, coalesce(m.name, s_name) AS name FROM supplier LEFT JOIN (SELECT c_nationkey AS k, max(c_mktsegment) FILTER (c_mktsegment <> '' AND c_nationkey < 10) AS name FROM customer GROUP BY 1) m ON m.k = s_nationkey")
def enrich_lookup(spark, d):
    s, c = load(spark, d, "supplier"), load(spark, d, "customer")
    lookup = c.select(F.col("c_nationkey").alias("key"), F.when(F.col("c_nationkey") < 10, F.col("c_mktsegment")).alias("name"))
    rows = s.select("s_suppkey", F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"))
    return joins.enrich(rows, lookup, "key", "name").select("s_suppkey", "name")


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS parts, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS list FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def hydrate_parts(spark, d):
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")
    return _hydrated(o, l)


def _hydrated(o, l):
    h = joins.hydrate(o.select("o_orderkey"), l.select("l_orderkey", "l_linenumber", "l_partkey"), "o_orderkey", "l_orderkey", "l_linenumber")
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["l_linenumber"].cast("string"), F.lit(":"), p["l_partkey"].cast("string"))), ",")
    return h.select("o_orderkey", F.size("parts").cast("long").alias("parts"), text.alias("list"))


@query("WITH d AS (SELECT CAST(unnest(range(DATE '1996-01-01', DATE '1996-03-01', INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS p FROM d LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY day")
def calendar_densify(spark, d):
    o = load(spark, d, "orders").filter("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1996-03-01'")
    grid = joins.days(spark, "1996-01-01", "1996-02-29")
    counts = o.groupBy(F.to_date("o_orderdate").alias("day")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return grid.join(counts, "day", "left").fillna(0).select("day", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT c_custkey, CAST(coalesce((SELECT sum(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders WHERE o_custkey = c_custkey), 0) AS BIGINT) AS cents, CAST(coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), 0) AS BIGINT) AS done FROM customer")
def scalar_subquery_update(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    sums = o.groupBy("o_custkey").agg(F.sum(_cents()).alias("cents"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return c.join(sums, c.c_custkey == sums.o_custkey, "left").select("c_custkey", F.coalesce("cents", F.lit(0)).alias("cents"), F.coalesce("done", F.lit(0)).alias("done"))


@query("SELECT CAST(strftime(o_orderdate, '%G%V') AS BIGINT) AS week, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY 1")
def iso_week_pivot(spark, d):
    o = load(spark, d, "orders")
    week = (F.extract(F.lit("YEAROFWEEK"), F.col("o_orderdate")) * 100 + F.extract(F.lit("WEEK"), F.col("o_orderdate"))).cast("long")
    out = o.withColumn("week", week).groupBy("week").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum(_cents()))
    return out.select("week", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT o_orderkey, CAST(floor(CAST(round(o_totalprice * 100) AS BIGINT) / count(*) OVER (PARTITION BY o_custkey)) AS BIGINT) AS part FROM orders")
def divide_by_group_count(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", F.floor(_cents() / F.count("*").over(Window.partitionBy("o_custkey"))).alias("part"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40")
def keyset_page(spark, d):
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    return paging.keyset(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 40, (at, 5000))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def offset_page(spark, d):
    return paging.offset_page(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 2, 25).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def key_union(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def key_difference(spark, d):
    p, l = load(spark, d, "part"), load(spark, d, "lineitem")
    return p.join(l.filter("l_quantity > 40"), p.p_partkey == l.l_partkey, "left_anti").select(F.col("p_partkey").alias("k"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def select_distinct(spark, d):
    return load(spark, d, "part").select("p_brand", "p_size").distinct()


@query("WITH a AS (SELECT c_custkey AS id, c_mktsegment AS seg, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS id, c_mktsegment AS seg, CAST(round(c_acctbal * 100) AS BIGINT) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS bal FROM customer WHERE c_custkey % 11 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.bal <> b.bal OR a.seg <> b.seg")
def change_detection(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.round(F.col("c_acctbal") * 100).cast("long").alias("bal"))
    return joins.changes(c.filter("id % 7 <> 0"), c.filter("id % 11 <> 0").withColumn("bal", F.col("bal") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)), "id")


@query("SELECT o_orderkey + 1000000 AS id, CASE WHEN o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.o_orderkey // 3) THEN o_orderkey // 3 + 1000000 END AS parent FROM orders o")
def copy_with_ids(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("case when o_orderkey % 3 = 0 then o_orderkey div 3 end").alias("parent"))
    return joins.copy_with_ids(o, "id", ["parent"], F.col("id") + 1_000_000)


@query("WITH RECURSIVE t AS (SELECT CAST(3 AS BIGINT) AS id, 0 AS depth UNION ALL SELECT o_orderkey, depth + 1 FROM t JOIN orders ON o_orderkey // 2 = t.id AND o_orderkey <> t.id) SELECT id, depth FROM t WHERE id IN (SELECT o_orderkey FROM orders)")
def subtree(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 2").alias("parent")).filter("parent <> o_orderkey")
    return joins.descendants(spark, o, "o_orderkey", "parent", 3)


@query("WITH s AS (SELECT 1 AS ord, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 2, c_custkey, c_mktsegment FROM customer) SELECT id, name FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1")
def first_wins_union(spark, d):
    c = load(spark, d, "customer")
    return joins.first_wins(c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")), key="id")


@query("WITH p AS (SELECT split_part(p_brand, '#', 1) || '/' || p_brand || '/' || p_type || '/' || p_partkey AS path, p_brand, p_type, p_partkey FROM part) SELECT directory, CAST(depth AS INTEGER) AS depth, CAST(count(DISTINCT path) AS BIGINT) AS files FROM (SELECT path, split_part(p_brand, '#', 1) AS directory, 1 AS depth FROM p UNION ALL SELECT path, split_part(p_brand, '#', 1) || '/' || p_brand, 2 FROM p UNION ALL SELECT path, split_part(p_brand, '#', 1) || '/' || p_brand || '/' || p_type, 3 FROM p) GROUP BY ALL")
def directory_counts(spark, d):
    p = load(spark, d, "part").select(F.concat_ws("/", F.split("p_brand", "#")[0], "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    return joins.directory_counts(p, "path")


@query("SELECT p_brand, CAST(count(*) FILTER (p_size < 10) AS BIGINT) AS small, coalesce(max(nullif(p_name, '')), '') AS name, CAST(max(p_size) AS INTEGER) AS largest FROM part WHERE p_type ILIKE '%econ%' AND (p_name LIKE '%a%' OR p_name LIKE '%e%') GROUP BY p_brand")
def representative_value(spark, d):
    p = load(spark, d, "part").filter(X.like_contains(F.col("p_type"), "econ") & (F.col("p_name").contains("a") | F.col("p_name").contains("e")))
    return p.groupBy("p_brand").agg(F.count_if(F.col("p_size") < 10).alias("small"), F.coalesce(F.max(F.nullif("p_name", F.lit(""))), F.lit("")).alias("name"), F.max("p_size").alias("largest"))


@query("WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS part, l_orderkey AS grp, 1 AS seq, false AS removed, CAST(floor(l_quantity) AS BIGINT) AS amount FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_orderkey, 2, l_linenumber = 3, CAST(floor(l_quantity) AS BIGINT) + 5 FROM lineitem WHERE l_linenumber >= 2) SELECT grp, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY part ORDER BY seq DESC, amount DESC) = 1) WHERE NOT removed GROUP BY grp")
def signed_delta_total(spark, d):
    from quern.operators import log

    return log.running_totals(_versions(spark, d).withColumn("place", F.col("seq") * 1000 + F.col("amount")), "part", "place", "removed", "grp", ["amount"])


def _versions(spark, d):
    l = load(spark, d, "lineitem")
    part = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("part")
    first = l.select(part, F.col("l_orderkey").alias("grp"), F.lit(1).alias("seq"), F.lit(False).alias("removed"), F.floor("l_quantity").alias("amount"))
    second = l.filter("l_linenumber >= 2").select(part, F.col("l_orderkey").alias("grp"), F.lit(2).alias("seq"), (F.col("l_linenumber") == 3).alias("removed"), (F.floor("l_quantity") + 5).alias("amount"))
    return first.union(second)


@query("WITH a AS (SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def merge_increment(spark, d):
    from quern.sources import ranged

    path = scratch(spark)
    o = load(spark, d, "orders")
    for odd in (0, 1):
        ranged.increment(o.filter(f"o_orderkey % 2 = {odd}").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n")), path, ["id"], ["n"])
    return ranged.read(spark, path)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'second' WHEN c_custkey % 2 = 0 THEN 'first' END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def merge_overwrite(spark, d):
    from quern.sources import ranged

    path = scratch(spark)
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    ranged.upsert(c.filter("id % 2 = 0").withColumn("name", F.lit("first")), path, ["id"])
    ranged.upsert(c.filter("id % 3 = 0").withColumn("name", F.lit("second")), path, ["id"])
    return ranged.read(spark, path)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def insert_ignore(spark, d):
    from quern.sources import ranged

    path = scratch(spark)
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    ranged.insert_ignore(c.filter("id % 2 = 0").withColumn("name", F.lit("first")), path, ["id"])
    ranged.insert_ignore(c.filter("id % 3 = 0").withColumn("name", F.lit("second")), path, ["id"])
    return ranged.read(spark, path)


@query("WITH r AS (SELECT n_regionkey AS k, n_nationkey AS cost, n_nationkey % 3 AS pri FROM nation), h AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY pri) AS p FROM r) SELECT k, CAST(count(*) AS BIGINT) AS n, CAST(min(cost) AS INTEGER) AS cheapest FROM h WHERE p = 1 GROUP BY k HAVING count(*) > 0")
def greatest_per_group(spark, d):
    n = load(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("cost"), (F.col("n_nationkey") % 3).alias("pri"))
    least = n.withColumn("p", F.min("pri").over(Window.partitionBy("k"))).filter("pri = p")
    return least.groupBy("k").agg(F.count("*").alias("n"), F.min("cost").alias("cheapest"))


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark, d):
    return analytic.latest(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("WITH s AS (SELECT o_custkey, c_mktsegment, CASE WHEN o_orderkey % 4 = 0 THEN 'all' ELSE c_mktsegment END AS tier, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01') SELECT tier, CAST(sum(cents) AS BIGINT) AS cents FROM s WHERE (tier = 'all') = (SELECT max(CASE WHEN tier = 'all' THEN 1 ELSE 0 END) = 1 FROM s) GROUP BY tier")
def all_users_fallback(spark, d):
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.when(F.col("o_orderkey") % 4 == 0, "all").otherwise(F.col("c_mktsegment")).alias("tier"), "o_orderdate", _cents().alias("cents"))
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return analytic.window_rows(rows, "o_orderdate", "tier", t("1997-01-01"), t("1997-02-01")).groupBy("tier").agg(F.sum("cents").alias("cents"))


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) SELECT month, n, CAST(n - lag(n) OVER (ORDER BY month) AS BIGINT) AS n_delta FROM m")
def history_deltas(spark, d):
    from quern.sources import writers

    m = load(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return writers.history_line(m, "month", ["n"])


@query("WITH j AS (SELECT p_brand, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part) SELECT p_brand AS agent, 'size-' || p_size AS task, CAST(max(price) AS DOUBLE) AS score FROM j GROUP BY ALL")
def json_path_agg(spark, d):
    from quern.operators import aggregate

    p = load(spark, d, "part").select("p_brand", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))
    per = p.groupBy("p_brand", "p_size").agg(F.max("price").cast("double").alias("score"))
    task = F.struct(F.col("score").alias("averageScore"), F.struct(F.concat(F.lit("size-"), F.col("p_size").cast("string")).alias("id")).alias("task"))
    docs = per.groupBy(F.col("p_brand").alias("agent")).agg(F.to_json(F.struct(F.avg("score").alias("averageScore"), F.collect_list(task).alias("tasks"))).alias("result"))
    return aggregate.score_pivot(docs, "agent", "result", "agent", 1000).select("agent", "task", "score")
