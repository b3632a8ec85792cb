"""What is written and read again: files, marts, upserts; streams that run until their input is done; extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import codecs
from quern.operators import analytic, extend
from quern.plans.registry import query
from quern.plans.usage import U, usage
from quern.session import load, scratch
from quern.sources import listing, paged, ranged, readers, writers
from quern.streaming import counters, flow

# files

KINDS = {"stat": {"provider", "total"}, "model stat": {"provider", "model", "total"}, "geo stat": {"provider", "country", "total"}}


@query("SELECT CASE s_suppkey % 2 WHEN 0 THEN 'model stat' ELSE 'stat' END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier GROUP BY ALL")
def imported_kinds(spark, d):
    """Two CSV files of different imports under one root, told apart by their headers and read by aliases."""
    root = scratch(spark)
    s = load(spark, d, "supplier")
    s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("Provider"), F.col("s_nationkey").alias("MODEL"), F.col("s_suppkey").alias("Total")).write.csv(f"{root}/deep/one", header=True)
    s.filter("s_suppkey % 2 = 1").select(F.col("s_name").alias(" provider "), F.col("s_suppkey").alias("total"), F.lit("").alias("note")).write.csv(f"{root}/two", header=True)
    out = None
    for folder in ("deep/one", "two"):
        df = readers.read_csv(spark, f"{root}/{folder}")
        rows = readers.by_alias(df, {"total": ()}).select(F.lit(readers.kind_of(df.columns, KINDS)).alias("kind"), F.col("total").cast("long").alias("total"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query("SELECT event_id, round(value, 2) AS value, event_type AS kind FROM events")
def json_import(spark, d):
    """One JSON document a file, with its rows under ``results`` and a nested object over each row; folders are read to any depth."""
    path = scratch(spark)
    e = load(spark, d, "events").select((F.col("event_id") % 8).alias("bucket"), F.struct("event_id", F.lit("row").alias("kind"), F.struct(F.round("value", 2).alias("value"), F.col("event_type").alias("kind")).alias("data")).alias("r"))
    e.groupBy("bucket").agg(F.collect_list("r").alias("results")).write.partitionBy("bucket").json(path)  # eight test files
    return readers.read_json(spark, path).select("event_id", "value", "kind")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type > 'error' AND event_type < 'view' GROUP BY event_type")
def keyed_objects(spark, d):
    """Objects by key: those with a prefix, between two keys."""
    root = scratch(spark)
    load(spark, d, "events").select("event_type", "event_id").write.partitionBy("event_type").json(root)
    found = readers.objects(spark, root, "event_type=", after="event_type=error~", before="event_type=view")
    lines = found.select(F.regexp_extract("key", "event_type=([a-z]+)/", 1).alias("event_type"), F.explode(F.split(F.rtrim(F.rtrim(F.col("value")), F.lit("\n")), "\n")).alias("line"))
    return lines.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'event_type=' || event_type AS folder, 2 AS depth FROM events WHERE event_type <> 'signup'")
def listed_files(spark, d):
    """Files by glob, without what an ignore pattern names and without hidden ones, two levels deep."""
    root = scratch(spark)
    load(spark, d, "events").select("event_type", "event_id").write.partitionBy("event_type").parquet(root)
    found = readers.files(spark, root, "*.parquet", ignore=("event_type=signup/",), depth=2)
    return found.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("folder"), F.size(F.split("path", "/")).alias("depth")).distinct()


@query("WITH f AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS brand, p_size AS size FROM part) SELECT 'brand=' || brand || '/size=' || size AS folder FROM f WHERE NOT starts_with(brand, 'brand2') AND CASE WHEN brand = 'brand31' AND size = 11 THEN true WHEN brand = 'brand31' AND size BETWEEN 40 AND 45 THEN false ELSE size = 10 OR NOT starts_with(size::VARCHAR, '1') END")
def ignored_files(spark, d):
    """A tree with ignore files at two levels: what one names another takes back, and nothing comes back from an ignored folder."""
    root = scratch(spark)
    p = load(spark, d, "part").select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("brand"), F.col("p_size").alias("size"), "p_name")
    p.repartition("brand").write.partitionBy("brand", "size").text(root)
    jvm = spark.sparkContext._jvm
    rules = {"": "size=1*/\n!size=10/\n/brand=brand2*/\n", "brand=brand31": "# here\n!size=11/\nsize=4[0-5]/\n/size=0\n", "brand=brand22": "!size=*/\n!*.txt\n"}
    for folder, content in rules.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}/.ignore" if folder else f"{root}/.ignore")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content.encode()))
        out.close()
    return listing.listed(spark, root, "*.txt").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()


@query("SELECT s_suppkey AS id, s_name || ', \"' || s_nationkey || '\"' AS name FROM supplier")
def csv_round_trip(spark, d):
    path = scratch(spark)
    name = F.concat("s_name", F.lit(', "'), F.col("s_nationkey").cast("string"), F.lit('"'))
    writers.write_csv(load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name")), path)
    return readers.read_csv(spark, path).select(F.col("id").cast("long").alias("id"), "name")


@query("SELECT s_suppkey::BIGINT AS id, s_name AS name FROM supplier")
def paged_source(spark, d):
    """Suppliers from pages of twenty, until one is not full."""
    folder = scratch(spark)
    s = load(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))
    pages = analytic.running_total(s, ["id"], F.lit(1), "place").withColumn("page", F.floor((F.col("place") - 1) / 20))
    pages.repartition("page").sortWithinPartitions("page", "place").drop("place").write.partitionBy("page").json(folder)
    spark.dataSource.register(paged.Pages)
    return spark.read.format("pages").options(fetch=f"{paged.__name__}:{paged.file_page.__name__}", folder=folder, size="20", columns="id long, name string").load()


# upserts


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'gone' END AS deleted FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 5 = 0 AND c_custkey % 3 <> 0)")
def revive_and_purge(spark, d):
    """An upsert of one column that revives what was deleted, then a scoped delete."""
    path = scratch(spark)
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "gone").alias("deleted"))
    ranged.create(c, path, ["id"])
    ranged.set_columns(c.filter("id % 3 = 0").select("id", F.lit("renamed").alias("name")), path, ["id"], ["name"], revive="deleted")
    ranged.delete(spark, path, (F.col("deleted") == "gone") & (F.col("id") % 5 == 0))
    return ranged.read(spark, path)


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version FROM orders")
def replaced_partitions(spark, d):
    path = scratch(spark)
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    writers.replace_partitions(o.withColumn("version", F.lit(1)), path, ["status"])
    writers.replace_partitions(o.filter("status = 'F'").withColumn("version", F.lit(2)), path, ["status"])
    return spark.read.parquet(path).select("id", "status", "version")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND year(o_orderdate) = 1996 THEN 2 ELSE 1 END AS version, CAST(year(o_orderdate) AS INTEGER) AS period FROM orders WHERE year(o_orderdate) <> 1996 OR o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def upserted_periods(spark, d):
    """Rows of one period replaced and inserted; other periods' files are not read or written."""
    path = scratch(spark)
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("version"), F.year("o_orderdate").alias("period"))
    writers.upsert_periods(o.filter("period <> 1996 or id % 3 <> 0"), path, ["period"], ["period", "id"])
    writers.upsert_periods(o.filter("period = 1996 and id % 2 = 0").withColumn("version", F.lit(2)), path, ["period"], ["period", "id"])
    return spark.read.parquet(path).select("id", "version", "period")


@query(f"WITH {U}, s AS (SELECT session, CAST(sum(cents) AS BIGINT) AS usage, max(time) AS updated FROM u WHERE time < TIMESTAMP '2024-01-20' GROUP BY session), n AS (SELECT session, CAST(sum(cents) AS BIGINT) AS cost, max(time) AS last FROM u WHERE time >= TIMESTAMP '2024-01-20' GROUP BY session) SELECT coalesce(s.session, n.session) AS session, CASE WHEN cost IS NULL THEN usage WHEN updated >= last - INTERVAL 6 DAY THEN usage + cost ELSE cost END AS usage FROM s FULL JOIN n ON n.session = s.session")
def accumulated_usage(spark, d):
    path, bound = scratch(spark), F.lit("2024-01-20").cast("timestamp_ntz")
    u = usage(spark, d)
    stored = u.filter(F.col("time") < bound).groupBy("session").agg(F.sum("cents").alias("usage"), F.max("time").alias("updated"))
    later = u.filter(F.col("time") >= bound).groupBy("session").agg(F.sum("cents").alias("usage"), F.max("time").alias("updated"))
    ranged.create(stored, path, ["session"])
    grown = writers.accumulate_or_reset(F.col("old.usage"), F.col("old.updated"), F.col("new.updated") - F.make_dt_interval(days=F.lit(6)), F.col("new.usage"))
    ranged.merge(later, path, ["session"], {"usage": grown, "updated": F.col("new.updated")})
    return ranged.read(spark, path).select("session", "usage")


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 2 = 0 AND c_nationkey < 20 THEN 20 ELSE c_nationkey END AS INTEGER) AS n FROM customer")
def conditional_upsert(spark, d):
    path = scratch(spark)
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    ranged.create(c.filter("id % 7 <> 0"), path, ["id"])
    newer = c.filter("id % 2 = 0").withColumn("n", F.when((F.col("id") % 7 == 0) & (F.col("n") >= 20), F.col("n")).otherwise(20))
    ranged.merge(newer.unionByName(c.filter("id % 2 = 1 and id % 7 = 0")), path, ["id"], where=F.col("new.n") > F.col("old.n"))
    return ranged.read(spark, path)


@query("SELECT c_custkey AS id, CASE WHEN n.cents IS NULL THEN 'none' ELSE 'some' END AS mark, n.cents FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON n.o_custkey = c_custkey")
def updated_from_join(spark, d):
    """An update of stored rows from an aggregate over another table; keys that are not stored are left out."""
    path = scratch(spark)
    ranged.create(load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("none").alias("mark"), F.lit(None).cast("long").alias("cents")), path, ["id"])
    o = load(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    more = spark.createDataFrame([(-1, 5)], "id long, cents long")
    ranged.set_columns(o.unionByName(more).withColumn("mark", F.lit("some")), path, ["id"], ["mark", "cents"], insert=False)
    return ranged.read(spark, path)


@query("WITH l AS (SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS lines FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'late' ELSE o_orderstatus END AS status, coalesce(lines, 0) AS lines FROM orders LEFT JOIN l ON l.id = o_orderkey WHERE o_orderstatus <> 'P'")
def ranged_orders(spark, d):
    """All orders in key ranges: line counts added up in two batches, one period replaced, one status deleted, earlier states dropped."""
    path = scratch(spark)
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    ranged.create(o.select("id", "status", F.lit(0).cast("long").alias("lines")), path, ["id"])
    for first in (True, False):
        lines = load(spark, d, "lineitem").filter((F.col("l_linenumber") <= 3) == F.lit(first)).select(F.col("l_orderkey").alias("id"), F.lit(1).cast("long").alias("lines"))
        ranged.increment(lines, path, ["id"], ["lines"])
    ranged.set_columns(o.filter("o_orderdate >= timestamp_ntz '1997-01-01'").select("id", F.when(F.col("status") == "P", "P").otherwise("late").alias("status")), path, ["id"], ["status"])
    ranged.delete(spark, path, F.col("status") == "P")
    ranged.vacuum(spark, path)
    return ranged.read(spark, path)


@query("WITH m AS (SELECT year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1), l AS (SELECT *, n - lag(n, 1, 0) OVER (ORDER BY y) AS dn, f - lag(f, 1, 0) OVER (ORDER BY y) AS df FROM m) SELECT '| ' || y || '-01-01 | ' || format('{:,}', n) || ' (' || CASE WHEN dn < 0 THEN '-' ELSE '+' END || format('{:,}', abs(dn)) || ') | ' || format('{:,}', f) || ' (' || CASE WHEN df < 0 THEN '-' ELSE '+' END || format('{:,}', abs(df)) || ') |' AS line FROM l")
def history_table(spark, d):
    """A Markdown table that grows by a row of totals a year."""
    path = scratch(spark) + ".md"
    per = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f")).orderBy("y")
    for r in per.collect():  # one run of the sink for each of a few years
        writers.append_history(spark, path, "Orders", f"{r.y}-01-01", {"All": r.n, "Done": r.f})
    return spark.read.text(path).filter(F.col("value").rlike(writers.HISTORY_ROW)).select(F.col("value").alias("line"))


# streams: a table is written as files, which a stream takes in until all are done


def _stream(spark, rows):
    path = scratch(spark)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _append(path):
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


@query(f"""WITH RECURSIVE {U}, o AS (SELECT session, CAST(floor(epoch(time)) AS BIGINT) AS t, cents, row_number() OVER (PARTITION BY session ORDER BY CAST(floor(epoch(time)) AS BIGINT), cents) AS rn FROM u),
r AS (SELECT session, rn, t AS anchor, cents AS usage FROM o WHERE rn = 1 UNION ALL
  SELECT o.session, o.rn, CASE WHEN r.anchor >= o.t - 18000 THEN r.anchor ELSE o.t END, CASE WHEN r.anchor >= o.t - 18000 THEN r.usage + o.cents ELSE o.cents END FROM r JOIN o ON o.session = r.session AND o.rn = r.rn + 1)
SELECT session, anchor, usage FROM r QUALIFY row_number() OVER (PARTITION BY session ORDER BY rn DESC) = 1""")
def rolling_usage_stream(spark, d):
    path = scratch(spark)
    stream = _stream(spark, usage(spark, d).select("session", "time", "cents"))
    flow.drain(counters.rolling_usage(stream, "session", "time", "cents", 18_000, "1 hour"), _append(path), scratch(spark), "update")
    return spark.read.parquet(path).groupBy("session").agg(F.max_by(F.struct("anchor", "usage"), "batch").alias("s")).select("session", "s.anchor", "s.usage")


@query("WITH v AS (SELECT conv_id AS grp, conv_id * 100 + turn // 2 AS part, turn AS seq, CASE WHEN role = 'system' THEN 0 ELSE length(text) END AS amount FROM conversations), l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY part ORDER BY seq DESC, amount DESC) = 1) SELECT grp, CAST(sum(amount) AS BIGINT) AS amount FROM l GROUP BY grp")
def delta_stream(spark, d):
    path = scratch(spark)
    c = load(spark, d, "conversations").select(F.col("conv_id").alias("grp"), F.expr("conv_id * 100 + turn div 2").alias("part"), (F.col("turn") * 1_000_000 + F.when(F.col("role") == "system", 0).otherwise(F.length("text"))).alias("seq"), (F.col("role") == "system").alias("removed"), F.length("text").cast("long").alias("amount"))
    flow.drain(counters.fold_deltas(_stream(spark, c), "grp", "part", "seq", "removed", "amount"), _append(path), scratch(spark))
    return spark.read.parquet(path).groupBy("grp").agg(F.sum("amount").alias("amount"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS frames, CAST(sum(length(text)) AS BIGINT) AS letters FROM conversations GROUP BY conv_id")
def chunk_stream(spark, d):
    """Texts whose frames are cut across chunks: each chunk ends within the next frame."""
    path = scratch(spark)
    flat = F.translate("text", "\n", " ")
    c = load(spark, d, "conversations").select("conv_id", F.explode(F.array(F.struct((F.col("turn") * 2).alias("no"), F.substring(flat, 1, 5).alias("x")), F.struct((F.col("turn") * 2 + 1).alias("no"), F.concat(F.substring(flat, 6, 1 << 30), F.lit("\n\n")).alias("x")))).alias("p")).select("conv_id", "p.no", "p.x")
    flow.drain(counters.parse_chunks(_stream(spark, c), "conv_id", "no", "x"), _append(path), scratch(spark))
    return spark.read.parquet(path).groupBy("conv_id").agg(F.count("*").alias("frames"), F.sum(F.length("frame")).alias("letters"))


@query("SELECT 'all' AS subscriber, CAST(count(*) AS BIGINT) AS n FROM events UNION ALL SELECT event_type, CAST(count(*) AS BIGINT) FROM events WHERE event_type IN ('view', 'error') GROUP BY event_type")
def fanned_out(spark, d):
    """Subscribers by type and one for everything, each with its own table."""
    root = scratch(spark)
    sink = flow.fan_out("event_type", {k: _append(f"{root}/{k}") for k in ("view", "error")}, _append(f"{root}/all"))
    flow.drain(_stream(spark, load(spark, d, "events").select("event_id", "event_type")), sink, scratch(spark))
    count = lambda k: spark.read.parquet(f"{root}/{k}").agg(F.lit(k).alias("subscriber"), F.count("*").alias("n"))
    return count("all").union(count("view")).union(count("error"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'rejected' END AS target, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def routed_stream(spark, d):
    """Events appended by their routing key; what has none goes to a table of rejects."""
    root, rejects = scratch(spark), scratch(spark)
    body = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("lake."), "event_type")).otherwise("no route").alias("_datalake_key"), "event_id"))
    flow.drain(_stream(spark, load(spark, d, "events").select(body.alias("body"))), writers.routed_sink(root, rejects), scratch(spark))
    kept = spark.read.parquet(root).groupBy(F.col("table").alias("target")).agg(F.count("*").alias("n"))
    return kept.union(spark.read.parquet(rejects).agg(F.lit("rejected"), F.count("*")))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY ALL")
def windowed_stream(spark, d):
    """Hourly counts with a watermark; each batch's windows replace what was there."""
    path = scratch(spark)
    stream = counters.timed(_stream(spark, load(spark, d, "events").select("ts", "event_type")), "ts", "2 hours")
    flow.drain(counters.tumbling(stream, "ts", ["event_type"], width="1 hour"), _append(path), scratch(spark), "update")
    last = spark.read.parquet(path).groupBy("window_start", "event_type").agg(F.max_by("total", "batch").alias("total"))
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# extension points


@query("SELECT event_id, ['/a/' || event_id, 'C:/a/' || event_id, '//host/' || event_id, ''][event_id % 4 + 1] AS stored, ['/a/' || event_id, 'C:\\a\\' || event_id, '\\\\host\\' || event_id, ''][event_id % 4 + 1] AS shown FROM events")
def coded_paths(spark, d):
    i = F.col("event_id").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit("/a/"), i), F.concat(F.lit("C:\\a\\"), i), F.concat(F.lit("\\\\host\\"), i), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    stored = codecs.encoded(load(spark, d, "events").select("event_id", raw.alias("stored")), {"stored": "directory"})
    return codecs.decoded(stored.withColumn("shown", F.col("stored")), {"shown": "directory"})


@query("SELECT event_id, upper(event_type) AS event_type, 'kept' AS mark FROM events WHERE event_type <> 'error'")
def transformed(spark, d):
    """Steps by name: one replaced, one removed."""
    steps = extend.Steps().add("drop", lambda df: df.limit(0)).add("case", lambda df: df.withColumn("event_type", F.upper("event_type"))).add("extra", lambda df: df.withColumn("extra", F.lit(1)))
    steps.add("drop", lambda df: df.filter("event_type <> 'error'")).remove("extra").add("mark", lambda df: df.withColumn("mark", F.lit("kept")))
    return steps(load(spark, d, "events").select("event_id", "event_type"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part) SELECT p_partkey, CAST(unnest(range(0, least(len(words), 2))) AS INTEGER) AS place, unnest(words[1:2]) AS word FROM w")
def table_function(spark, d):
    """The first words of a name from a table function with checked arguments."""
    extend.register(spark, "quern_words", "place int, word string", {"text": lambda x: isinstance(x, str), "limit": lambda x: isinstance(x, int) and x >= 0}, lambda text, limit: list(enumerate(text.split(" ")[:limit])))
    load(spark, d, "part").createOrReplaceTempView("quern_part")
    return spark.sql("SELECT p_partkey, w.place, w.word FROM quern_part, LATERAL quern_words(p_name, 2) w")
