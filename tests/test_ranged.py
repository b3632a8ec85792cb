"""Tables in key ranges: merges touch few files, and any state is whole."""

import random

import pytest
from pyspark.sql import functions as F

from quern.sources import ranged

ROW = "a long, b string, n long"


def table(spark, path):
    return sorted(tuple(r) for r in ranged.read(spark, path).collect())


def stamps(tmp_path):
    return {f: f.stat().st_mtime_ns for f in tmp_path.glob("t/data/**/*.parquet")}


@pytest.fixture
def orders(spark, data, tmp_path, monkeypatch):
    """The orders table by its key in some fifteen files."""
    monkeypatch.setattr(ranged, "FILE_ROWS", 100)
    path = f"file://{tmp_path}/t"
    o = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    ranged.create(o, path, ["o_orderkey"])
    return path, o


def test_one_row_rewrites_one_file(spark, orders, tmp_path):
    path, o = orders
    before, rows = stamps(tmp_path), {r.o_orderkey: tuple(r) for r in o.collect()}
    assert len(before) > 10
    key = sorted(rows)[len(rows) // 2]
    ranged.upsert(spark.createDataFrame([(key, "X", 1.5)], o.schema), path, ["o_orderkey"])
    rows[key] = (key, "X", 1.5)
    assert sorted(map(tuple, ranged.read(spark, path).collect())) == sorted(rows.values())
    after = stamps(tmp_path)
    assert len(after) == len(before) + 1 and {f: after[f] for f in before} == before
    s = ranged.state(spark, path)
    assert s.version == 1 and s.files == len(before) and ranged.read(spark, path, 0).filter(F.col("o_orderkey") == key).first().o_orderstatus != "X"
    assert ranged.vacuum(spark, path) == 1 and len(stamps(tmp_path)) == s.files
    ranged.upsert(spark.createDataFrame([(-5, "lo", 0.0), (10**9, "hi", 0.0)], o.schema), path, ["o_orderkey"])  # before the first range, after the last
    assert ranged.read(spark, path).count() == len(rows) + 2 and len(stamps(tmp_path)) == s.files + 2


def test_ranges_stay_apart_and_grow(spark, orders):
    """Many rows into one range make several files; no two files share a key."""
    path, o = orders
    n = ranged.read(spark, path).count()
    ranged.upsert(spark.range(10**7, 10**7 + 950).select(F.col("id").alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")), path, ["o_orderkey"])
    found = ranged.state(spark, path).ranges(spark).orderBy("place").collect()
    assert sum(r.rows for r in found) == n + 950 == ranged.read(spark, path).count()
    assert all(x.high < y.low for x, y in zip(found, found[1:])) and [r.place for r in found] == list(range(len(found))) and max(r.rows for r in found) < 400


@pytest.mark.parametrize("step", ["_store", "_ranges", "_advance", "_commit"])
def test_a_merge_cut_short_leaves_the_state_before(spark, orders, monkeypatch, step):
    path, o = orders
    before = sorted(map(tuple, ranged.read(spark, path).collect()))
    real = getattr(ranged, step)

    def fails(*args, **kwargs):
        if step != "_commit":
            real(*args, **kwargs) if step != "_advance" else None
        raise OSError("cut")

    with monkeypatch.context() as m:
        m.setattr(ranged, step, fails)
        with pytest.raises(OSError, match="cut"):
            ranged.upsert(o.withColumn("o_orderstatus", F.lit("?")), path, ["o_orderkey"])
    assert sorted(map(tuple, ranged.read(spark, path).collect())) == before and ranged.state(spark, path).version == 0
    ranged.vacuum(spark, path)
    ranged.upsert(o.withColumn("o_orderstatus", F.lit("?")), path, ["o_orderkey"])
    assert {r.o_orderstatus for r in ranged.read(spark, path).collect()} == {"?"}


def test_a_second_writer_fails(spark, orders):
    path, o = orders
    s = ranged.state(spark, path)
    ranged.upsert(o.limit(1), path, ["o_orderkey"])
    with pytest.raises(ranged.Conflict):
        ranged._commit(spark, ranged.State(path, s.version + 1, s.keys, s.schema, s.manifest, s.files, {}))
    assert ranged.state(spark, path).version == 1


def test_null_and_repeated_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranged, "FILE_ROWS", 2)
    path = f"file://{tmp_path}/t"
    make = lambda *r: spark.createDataFrame(r, ROW)
    ranged.create(make((None, None, 1), (None, None, 2), (None, "x", 3), (1, None, 4), (2, "a", 5), (2, "a", 4), (3, "b", None)), path, ["a", "b"])
    ranged.upsert(make((None, None, 7), (None, "y", 8), (2, "a", 1), (2, "a", 9), (2, "a", 3), (3, "b", 0)), path, ["a", "b"])
    got = {(r.a, r.b): r.n for r in ranged.read(spark, path).collect()}
    assert got == {(None, None): 7, (None, "x"): 3, (None, "y"): 8, (1, None): 4, (2, "a"): 9, (3, "b"): 0}
    ranged.upsert(make().limit(0), path, ["a", "b"])
    assert ranged.state(spark, path).version == 1  # nothing came, nothing was made


def test_merges_match_a_dictionary(spark, tmp_path, monkeypatch):
    """All merges in turn over random batches, in small files."""
    monkeypatch.setattr(ranged, "FILE_ROWS", 6)
    rng, path, want = random.Random(2), f"file://{tmp_path}/t", {}
    for step in range(6):
        batch = {(rng.randrange(40), rng.choice("ab")): rng.randrange(100) for _ in range(12)}
        rows = spark.createDataFrame([(a, b, n) for (a, b), n in batch.items()], ROW)
        if step % 6 == 0:
            ranged.upsert(rows, path, ["a", "b"])
            want |= batch
        elif step % 6 == 1:
            ranged.increment(rows.union(rows.limit(3)), path, ["a", "b"], ["n"])
            twice = {(r.a, r.b) for r in rows.limit(3).collect()}
            for k, n in batch.items():
                want[k] = want.get(k, 0) + n * (1 + (k in twice))
        elif step % 6 == 2:
            ranged.insert_ignore(rows, path, ["a", "b"])
            want = batch | want
        elif step % 6 == 3:
            ranged.merge(rows, path, ["a", "b"], where=F.col("new.n") > F.col("old.n"), remove=F.col("new.n") % 5 == 0)
            want = {k: n for k, n in (want | {k: max(n, want.get(k, n)) for k, n in batch.items()}).items() if batch.get(k, 1) % 5}
        elif step % 6 == 4:
            ranged.set_columns(rows, path, ["a", "b"], ["n"], insert=False)
            want = {k: batch.get(k, n) for k, n in want.items()}
        else:
            ranged.delete(spark, path, (F.col("a") % 3 == 0) | (F.col("n") > 90))
            want = {k: n for k, n in want.items() if k[0] % 3 and n <= 90}
        assert table(spark, path) == sorted((a, b, n) for (a, b), n in want.items())
    ranged.delete(spark, path, F.lit(True))
    assert table(spark, path) == []
    ranged.upsert(spark.createDataFrame([(1, "a", 1)], ROW), path, ["a", "b"])
    assert table(spark, path) == [(1, "a", 1)]
