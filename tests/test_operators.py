import json

import pytest
from pyspark.sql import functions as F

from quern.operators import aggregate, alerts, analytic, joins, log, paging
from quern.sources import readers, writers
from quern.streaming import counters, flow


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_collapse_keeps_singletons_and_is_idempotent(spark):
    base = spark.createDataFrame([("d", "Go", 2, 4, 10.0, 7), ("d", "Free", 3, 1, 20.0, 9), ("e", "Go", 1, 1, None, 5)], "period_key string, tier string, sessions long, requests long, avg_duration double, p50_duration int")
    got = {(r.period_key, r.tier): r for r in aggregate.with_all_tier(base, ["period_key"]).collect()}
    both = got["d", "all"]
    assert (both.sessions, both.requests, both.avg_duration, both.p50_duration) == (5, 5, 12.0, None)
    assert (got["e", "all"].avg_duration, got["e", "all"].p50_duration) == (None, 5)
    once = aggregate.collapse(base, ["period_key"])
    assert rows(aggregate.collapse(once, ["period_key"]), *once.columns) == rows(once, *once.columns)


def test_ordered_fold(spark):
    got = spark.range(1).select(aggregate.ordered_fold(F.array(F.lit(1.005), F.lit(2.0), F.lit(None).cast("double")), F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0))).alias("x")).first().x
    assert abs(got - 1.67) < 0.02


def test_shares_and_ranks(spark):
    df = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("a", "z", 0), ("b", "x", 0)], "p string, m string, t long")
    ranked = analytic.shares(analytic.ranks(df, ["p"], ["t"], ["m"]), ["p"], "t").collect()
    by = {(r.p, r.m): r for r in ranked}
    assert [by["a", m].rank_t for m in "xyz"] == [1, 2, 3] and by["b", "x"].share is None
    assert sum(float(r.share) for r in ranked if r.p == "a") == 1.0


def test_paging_is_exhaustive(spark):
    df = spark.createDataFrame([(i % 7 + 0.5, f"id{i:03d}") for i in range(50)], "t double, id string")
    got, at = [], None
    while True:
        page, more = paging.has_more(df, "t", "id", 9, at)
        got += [tuple(r) for r in page]
        if not more:
            break
        at = got[-1]
    assert got == sorted(((r.t, r.id) for r in df.collect()), reverse=True)
    assert len(list(paging.stream_rows(df))) == 50
    assert paging.has_more(df.limit(0), "t", "id", 1) == ([], False)


def test_alert_payload(spark):
    df = spark.createDataFrame([("m", 200, 150), ("n", 10, 10)], "model string, total long, failed long")
    expanded = df.select("model", F.explode(F.sequence(F.lit(1).cast("long"), "total")).alias("i"), "failed")
    out = alerts.ratio(expanded, "model", F.lit(True), F.col("i") <= F.col("failed"), 150, 0.7)
    assert rows(out, "model", "triggered") == [("m", True), ("n", False)]
    assert rows(alerts.payload(out.withColumn("pct", F.col("ratio_ppm") / 10_000), "model", "pct"), "line") == [("m: 75%",)]
    vote = spark.range(1).select(alerts.vote(F.lit(3), F.lit(9)).alias("a"), alerts.vote(F.lit(9), F.lit(3)).alias("b")).first()
    assert (vote.a, vote.b) == ("low", "idle")


HISTORY = "session string, id string, role string, parent string, summary boolean, finished boolean, failed boolean, compacts boolean, tail_start string"


def turn(i, role, parent=None, summary=False, finished=True, failed=False, compacts=False, tail=None):
    return ("s", f"m{i:02d}", role, parent, summary, finished, failed, compacts, tail)


@pytest.mark.parametrize(
    "messages,shown",
    [
        ([turn(1, "user"), turn(2, "assistant", "m01")], ["m01", "m02"]),
        ([turn(1, "user"), turn(2, "assistant", "m01"), turn(3, "user", compacts=True), turn(4, "assistant", "m03", True), turn(5, "user")], ["m03", "m04", "m05"]),
        ([turn(1, "user"), turn(2, "user", compacts=True), turn(3, "user")], ["m01", "m02", "m03"]),
        ([turn(1, "user"), turn(2, "user", compacts=True), turn(3, "assistant", "m02", True, failed=True)], ["m01", "m02", "m03"]),
        ([turn(1, "user"), turn(2, "user", compacts=True), turn(3, "assistant", "m02", True, finished=False)], ["m01", "m02", "m03"]),
        ([turn(1, "user"), turn(2, "assistant", "m01"), turn(3, "user"), turn(4, "assistant", "m03"), turn(5, "user", compacts=True, tail="m03"), turn(6, "assistant", "m05", True), turn(7, "user")], ["m05", "m06", "m03", "m04", "m07"]),
        ([turn(1, "user", compacts=True), turn(2, "assistant", "m01", True), turn(3, "user", compacts=True), turn(4, "assistant", "m03", True), turn(5, "user")], ["m03", "m04", "m05"]),
    ],
)
def test_visible_history(spark, messages, shown):
    got = log.visible_history(spark.createDataFrame(messages, HISTORY)).orderBy("position").collect()
    assert [r.id for r in got] == shown


def test_log_checks(spark):
    events = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("b", 0, "y")], "k string, seq long, owner string")
    incoming = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 4, "x"), ("b", 1, "z"), ("c", 0, "q")], "k string, seq long, owner string")
    got = rows(log.appendable(events, incoming, "k", "seq", "owner"), "k", "seq", "verdict")
    assert got == [("a", 1, "seen"), ("a", 2, "append"), ("a", 4, "gap"), ("b", 1, "foreign"), ("c", 0, "append")]


def test_totals_by_versions_and_by_deltas_agree(spark):
    v = spark.createDataFrame([("p", 1, False, "g", 5), ("p", 2, False, "g", 7), ("q", 1, False, "g", 3), ("q", 2, True, "g", 3)], "part string, seq int, removed boolean, grp string, n long")
    assert rows(log.running_totals(v, "part", "seq", "removed", "grp", ["n"]), "grp", "n") == rows(log.signed_totals(v, "part", "seq", "removed", "grp", ["n"]), "grp", "n") == [("g", 7)]


def test_projection_rejects_unknown_types(spark):
    events = spark.createDataFrame([("a", 0, "set", '{"n": 1}'), ("a", 1, "add", '{"n": 2}'), ("b", 0, "set", "{}"), ("b", 1, "drop", None)], "k string, seq long, kind string, data string")
    handlers = {"set": lambda s, d: {"n": d.get("n", 0)}, "add": lambda s, d: {"n": s["n"] + d["n"]}, "drop": lambda s, d: None}
    assert rows(log.project(events, "k", "seq", "kind", "data", handlers, "k string, n long"), "k", "n") == [("a", 3)]
    with pytest.raises(Exception, match="no handler"):
        log.project(events, "k", "seq", "kind", "data", {"set": handlers["set"]}, "k string, n long").collect()


def test_deep_diff(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": 1, "b": [1, 2]}), json.dumps({"b": [1, 3], "a": 1, "c": None}))], "id long, a string, b string")
    assert rows(log.deep_diff(df, "id", "a", "b"), "path", "a", "b") == [("$.b[1]", "2", "3"), ("$.c", None, "null")]


def test_min_max_and_runs(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0), (2, 5.0, 10.0)], "id int, cost double, age double")
    assert rows(analytic.min_max_score(df, "cost", "age"), "id", "score") == [(1, 0.9), (2, pytest.approx(0.6))]
    runs = spark.createDataFrame([("k", 1, "t", "a"), ("k", 2, "t", "b"), ("k", 3, "r", "c"), ("k", 4, "t", "d")], "k string, o int, kind string, x string")
    assert rows(analytic.merge_runs(runs, "k", "o", ["kind"], "x"), "kind", "x") == [("r", "c"), ("t", "ab"), ("t", "d")]


def test_changes_and_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (4, "n")], "id int, v string")
    assert rows(joins.changes(a, b, "id"), "id", "change") == [(1, "changed"), (3, "gone"), (4, "new")]


# sources and sinks


def test_csv_reader(spark, tmp_path):
    (tmp_path / "x.CSV").write_text('Vendor , "Model Name","Sum (tokens)"\r\n a ,"say ""hi"", you",1\r\n,,\r\nb,,\r\n')
    df = readers.read_csv(spark, str(tmp_path))
    got = readers.by_alias(df, {"provider": ("vendor",), "model": ("modelname",), "tokens": ("sumtokens",)})
    assert rows(got.fillna(""), "provider", "model", "tokens") == [("a", 'say "hi", you', "1"), ("b", "", "")]
    assert readers.kind_of(df.columns, {"narrow": {"vendor"}, "wide": {"Vendor", "Model name"}}) == "wide"
    with pytest.raises(ValueError):
        readers.kind_of(["q"], {"narrow": {"vendor"}})


def test_json_reader(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"a": 1, "data": {"b": 2}}, {"a": 3, "data": {"b": 4}}]}))
    assert rows(readers.read_json(spark, str(tmp_path / "a.json")), "a", "b") == [(1, 2), (3, 4)]


def test_objects_and_files(spark, tmp_path):
    for k in ("s/1", "s/2", "s/3", "t/1"):
        (tmp_path / f"{k}.json").parent.mkdir(exist_ok=True)
        (tmp_path / f"{k}.json").write_text(f'"{k}"')
    root = f"file://{tmp_path}"
    assert rows(readers.objects(spark, root, "s/", after="s/1", before="s/3"), "key", "value") == [("s/2", '"s/2"')]
    assert len(rows(readers.files(spark, root, "*.json", ignore=("t",)), "path")) == 3


def test_sse(spark):
    chunks = spark.createDataFrame([("k", 1, "data: a\n"), ("k", 2, "\ndata: b\ndata: c\n\n: ping\n\ndata: [DONE]\n\n")], "k string, o int, x string")
    assert [r.data for r in readers.sse_events(chunks, "k", "o", "x").orderBy("position").collect()] == ["a", "b\nc"]


def fetch(page, size):
    return [(page * size + i,) for i in range(size if page < 2 else 1)]


def test_paged_source(spark):
    spark.dataSource.register(readers.PagedSource)
    df = spark.read.format("paged").options(fetch="tests.test_operators:fetch", pages="3", size="4", columns="n int").load()
    assert sorted(r.n for r in df.collect()) == list(range(9))


def test_upserts(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda *r: spark.createDataFrame(r, "id int, n long, gone string")
    writers.merge_overwrite(make((1, 1, "x"), (2, 2, None)), path, ["id"])
    writers.merge_overwrite(make((2, 5, "y")), path, ["id"])
    writers.merge_columns(make((2, 9, None), (3, 3, None)).select("id", "n"), path, ["id"], ["n"], revive="gone")
    assert rows(spark.read.parquet(path), "id", "n", "gone") == [(1, 1, "x"), (2, 9, None), (3, 3, None)]
    writers.without(path, spark, F.col("gone") == "x")
    assert rows(spark.read.parquet(path), "id") == [(2,), (3,)]
    got = spark.range(1).select(writers.accumulate_or_reset(F.lit(5), F.lit(10), F.lit(9), F.lit(2)).alias("a"), writers.accumulate_or_reset(F.lit(5), F.lit(8), F.lit(9), F.lit(2)).alias("b")).first()
    assert tuple(got) == (7, 2)


def test_partition_replace_csv_and_routing(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    make = lambda *r: spark.createDataFrame(r, "k string, v int")
    writers.replace_partitions(make(("a", 1), ("b", 2)), path, ["k"])
    writers.replace_partitions(make(("a", 9)), path, ["k"])
    assert rows(spark.read.parquet(path), "k", "v") == [("a", 9), ("b", 2)]
    writers.write_csv(make(('x,"y', 1)).coalesce(1), f"file://{tmp_path}/c")
    assert '"x,""y",1' in next(tmp_path.glob("c/part*")).read_text()
    bad = readers.routed(spark.createDataFrame([('{"_datalake_key": "nope"}',)], "b string"), "b")
    with pytest.raises(ValueError):
        writers.append_routed(bad, path, 0)


# streams give what batches give


def stream_of(spark, df, tmp_path, files=4):
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, name, mode, tmp_path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return q


def test_tumbling_stream_matches_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type").limit(300)
    timed = counters.timed(stream_of(spark, events, tmp_path), "ts", "60 days")
    run(counters.tumbling(timed, "ts", ["event_type"], width="1 day"), "tumbling", "complete", tmp_path)
    batch = counters.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], width="1 day")
    assert rows(spark.table("tumbling"), "window_start", "event_type", "total") == rows(batch, "window_start", "event_type", "total")


def test_rolling_stream_matches_batch(spark, tmp_path):
    events = spark.createDataFrame([("u", 100 * i, 1) for i in range(20)] + [("v", 5, 2)], "u string, s long, c long").select("u", F.timestamp_seconds("s").alias("t"), "c").orderBy("t")
    stream = stream_of(spark, events, tmp_path, 1)
    run(counters.rolling_usage(stream, "u", "t", "c", 650), "rolling", "update", tmp_path)
    assert rows(spark.table("rolling"), "u", "anchor", "usage") == rows(counters.rolling_usage_batch(events, "u", "t", "c", 650), "u", "anchor", "usage")


def test_fold_stream_matches_batch(spark, tmp_path):
    v = spark.createDataFrame([("p", 1, False, "g", 5), ("p", 2, False, "g", 7), ("q", 1, False, "g", 3), ("q", 2, True, "g", 3)], "part string, seq int, removed boolean, grp string, n long")
    run(counters.fold_deltas(stream_of(spark, v.orderBy("seq"), tmp_path, 1), "grp", "part", "seq", "removed", "n"), "folded", "append", tmp_path)
    assert rows(spark.table("folded").groupBy("grp").agg(F.sum("n").alias("n")), "grp", "n") == rows(log.running_totals(v, "part", "seq", "removed", "grp", ["n"]), "grp", "n")


def test_counters_expire(spark, tmp_path):
    """A key whose window has passed the watermark leaves no state behind; a key within it keeps its own."""
    at = lambda s: spark.createDataFrame(s, "u string, s long, c long").select("u", F.timestamp_seconds("s").alias("t"), "c")
    source, sizes, seen = tmp_path / "in", [], {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r.u] = (r.anchor, r.usage)

    for rows_ in ([("old", 0, 1), ("old", 10, 2)], [("new", 10_000, 5)], [("new", 10_010, 1)], [("new", 10_020, 1)]):
        at(rows_).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(at(rows_).schema).parquet(str(source))
        q = flow.start(counters.rolling_usage(stream, "u", "t", "c", 100, "10 seconds"), keep, str(tmp_path / "ck"), mode="update")
        assert q.awaitTermination(120)
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    assert sizes[0] == 1 and sizes[-1] == 1 and seen == {"old": (0, 3), "new": (10_000, 7)}


def test_a_failed_batch_may_be_swallowed(spark, tmp_path):
    events = spark.createDataFrame([("a", 1)], "kind string, n long")

    def fails(batch, number):
        raise RuntimeError("no sink")

    stream = stream_of(spark, events, tmp_path, 1)
    assert flow.start(stream, fails, str(tmp_path / "ck1"), swallow=True).awaitTermination(60)
    with pytest.raises(Exception, match="no sink"):
        flow.drain(stream, fails, str(tmp_path / "ck2"))
    q = flow.start(stream, fails, str(tmp_path / "ck3"), every="60 seconds", swallow=True)
    assert q.isActive
    q.stop()


def test_routed_sink_keeps_what_it_rejects(spark, tmp_path):
    bodies = spark.createDataFrame([('{"_datalake_key": "lake.t", "n": 1}',), ('{"n": 2}',), ("no json",)], "body string")
    root, rejects = f"file://{tmp_path}/root", f"file://{tmp_path}/rejects"
    sink = writers.routed_sink(root, rejects)
    for number in (0, 0, 1):
        sink(bodies, number)
    assert rows(spark.read.parquet(root), "payload", "batch") == [('{"n":"1"}', 0), ('{"n":"1"}', 1)]
    assert rows(spark.read.parquet(rejects).filter("batch = 0"), "body") == [("no json",), ('{"n": 2}',)]


def test_upserts_keep_one_row_per_key(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(r, "p string, id int, n long")
    path = f"file://{tmp_path}/u"
    writers.merge_overwrite(make(("a", 1, 1), ("a", 1, 2)), path, ["id"])
    assert spark.read.parquet(path).count() == 1
    path = f"file://{tmp_path}/v"
    writers.upsert_periods(make(("a", 1, 1), ("b", 2, 2), ("b", 3, 3)), path, ["p"], ["p", "id"])
    before = {f: f.stat().st_mtime_ns for f in tmp_path.glob("v/p=a/*.parquet")}
    writers.upsert_periods(make(("b", 3, 9), ("b", 4, 4), ("b", 4, 4)), path, ["p"], ["p", "id"])
    assert rows(spark.read.parquet(path), "p", "id", "n") == [("a", 1, 1), ("b", 2, 2), ("b", 3, 9), ("b", 4, 4)]
    assert {f: f.stat().st_mtime_ns for f in tmp_path.glob("v/p=a/*.parquet")} == before and before  # untouched
    path = f"file://{tmp_path}/w"
    make(("a", 1, 1), ("a", 2, 5)).write.parquet(path)
    writers.merge_where(make(("x", 1, 3), ("x", 2, 3), ("x", 7, 7)), path, ["id"], F.col("new.n") > F.col("n"))
    assert rows(spark.read.parquet(path), "p", "id", "n") == [("a", 2, 5), ("x", 1, 3), ("x", 7, 7)]


def test_chunks_keep_their_rest(spark, tmp_path):
    c = spark.createDataFrame([("k", 1, "a\n\nb"), ("k", 2, "c\n\nd")], "k string, o int, x string")
    run(counters.parse_chunks(stream_of(spark, c, tmp_path, 1), "k", "o", "x"), "chunks", "append", tmp_path)
    assert rows(spark.table("chunks"), "frame") == [("a",), ("bc",)]


def test_fan_out_and_heartbeat(spark, tmp_path):
    events = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "kind string, n long")
    seen = {"a": [], "all": []}
    sink = flow.fan_out("kind", {"a": lambda df, _: seen["a"].extend(r.n for r in df.collect())}, lambda df, _: seen["all"].extend(r.n for r in df.collect()))
    q = stream_of(spark, events, tmp_path).writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    assert sorted(seen["a"]) == [1, 3] and sorted(seen["all"]) == [1, 2, 3]
    beat = flow.with_heartbeat(spark, spark.readStream.schema("kind string, n long").parquet(str(tmp_path / "in")), "kind", 1)
    assert beat.isStreaming and beat.columns == ["kind", "n"]

