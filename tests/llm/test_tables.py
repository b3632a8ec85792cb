from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, queries, rollup, store, urls, vafile

# top-k search


def brute_top(rows, asks, k):
    ints = {i: (v[0], np.floor(np.array(v[1], float) * 256).astype(int)) for i, v in enumerate(rows)}
    out = {}
    for q, (name, x) in ints.items():
        if asks(name):
            best = sorted(((-int(x @ y), other) for c, (other, y) in ints.items() if c != q and len(y) == len(x)))[:k]
            out[q] = [(r + 1, other, -s) for r, (s, other) in enumerate(best)]
    return sorted(sum(([(ints[q][0], *t) for t in v] for q, v in out.items()), []))


@pytest.mark.parametrize("scale,bits", [(1.0, 8), (1.0, 3), (1e6, 8), (1e6, 2)])
def test_top_k_matches_brute_force(spark, monkeypatch, scale, bits):
    monkeypatch.setattr(vafile, "BLOCK", 37 * 6)
    monkeypatch.setattr(vafile, "GROUP", 5 * 6)
    monkeypatch.setattr(vafile, "ROWS", 3)
    monkeypatch.setattr(vafile, "FIRST", 1)
    monkeypatch.setattr(vafile, "BITS", bits)
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=6) * scale).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(400, [0.0] * 6), (3, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("row", "v", "w", "id", "block")})
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vafile.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows, lambda i: i % 50 == 0, 5)


def test_top_k_leaves_out_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, nan]), (2, None), (3, [None, 1.0]), (4, [inf, 0.0]), (5, [0.5, 0.5]), (None, [9.0, 9.0]), (6, []), (7, [1.0, 2.0, 3.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in vafile.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 50), (50, 1, 5), (50, 2, 0)]
    assert vafile.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_cells_bound_every_product():
    rng = np.random.default_rng(2)
    for scale in (3, 300, 10**6):
        vectors, queries = (rng.integers(-scale, scale, (n, 7)) for n in (200, 9))
        low, step, cells = vafile.quantise(vectors)
        floor = low + cells * step
        assert ((floor <= vectors) & (vectors < floor + step)).all()
        bottom, top = vafile.bounds(queries, low, step, cells)
        exact = queries @ vectors.T
        assert (bottom <= exact).all() and (exact <= top).all()
    assert (top - bottom).max() < 0.05 * (exact.max() - exact.min())


# URL rules


def test_rules_and_aliases(spark):
    link = lambda x: f"<link rel='canonical' href='{x}'>"
    rows = [
        (1, "http://a.example.com/x", link("https://b.example.org/es/1")),
        (2, "https://A.example.com/x/#f", ""),
        (3, "http://c.example.net/q", '<meta http-equiv="refresh" content="0; url=/r">'),
        (4, "http://c.example.net/r", "<LINK href=//d.example.net/de/9 REL=canonical>"),
        (5, "http://z.net/", link("http://y.org/es/2") + link("http://d.example.net/de/1")),
        (6, None, None),
        (7, "noscheme/en/", ""),
        (8, "http://w.example.com/en/77?x", ""),
        (9, "http://w.example.com/en/8", link("http://w.example.com/en/77")),
        (10, "http://w.example.net/de/80", ""),
        (11, "http://EXAMPLE.org/es/", None),
        (12, "http://notexample.com/en/7", ""),
        (1, "http://a.example.com/x", link("https://b.example.org/es/1")),
    ]
    got = sorted(tuple(r) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    verdict = {r[0]: (r[3], r[4]) for r in got}
    assert len(got) == len(rows)
    assert verdict[1] == (None, "block") and verdict[2] == (None, "block")
    assert verdict[3] == (None, "allow") and verdict[4] == (None, "allow")
    assert verdict[5] == (None, "allow")  # an allowed alias goes before a blocked one
    assert verdict[6] == (None, "allow") and verdict[7] == (None, "allow")
    assert verdict[8] == ("example.com/en/7", "allow")
    assert verdict[9] == ("com/en/", "block")  # its own rule decides
    assert verdict[10] == ("example.net/de/8", "block") and verdict[11] == ("org/es/", "block")
    assert verdict[12] == ("com/en/", "block")
    assert next(r for r in got if r[0] == 11)[1:3] == ("example.org", "/es/")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# token totals

CHANGE = "op string, source string, lang string, version string, tokens long, old_version string, old_tokens long, extra string"


def test_batches_count_once(spark):
    ledger = store.new_path(spark, "ledger-test")
    make = lambda *rows: spark.createDataFrame(rows, CHANGE)
    first = make(("insert", "a", "en", "1", 10, None, None, ""), ("insert", "a", "en", "1", 5, None, None, ""), ("insert", None, None, None, None, None, None, None))
    assert rollup.commit(first, ledger, "b1") and not rollup.commit(first, ledger, "b1")
    assert rollup.commit(make(("revise", "a", "en", "2", 7, "1", 10, ""), ("delete", "a", "en", "1", 5, None, None, "")), ledger, "b2")
    want = {(None, None, None, 1, 0), ("a", "en", "2", 1, 7)}
    assert {tuple(r) for r in rollup.totals(spark, ledger).collect()} == want
    rollup.compact(spark, ledger, "c1")
    assert {tuple(r) for r in rollup.totals(spark, ledger).collect()} == want
    assert not rollup.commit(first, ledger, "b1")
    assert rollup.commit(make(("insert", "a", "en", "2", 1, None, None, "")), ledger, "b3")
    assert rollup.commit(first.limit(0), ledger, "b4")
    rollup.compact(spark, ledger, "c2")
    assert {tuple(r) for r in rollup.totals(spark, ledger).collect()} == {(None, None, None, 1, 0), ("a", "en", "2", 2, 8)}
    assert not rollup.commit(first, ledger, "b3")
    assert rollup.totals(spark, store.new_path(spark, "no-ledger")).count() == 0


def test_a_repeated_compaction_loses_nothing(spark):
    ledger = store.new_path(spark, "ledger-repeat")
    batch = spark.createDataFrame([("insert", "a", "en", "1", 10, None, None, "")], CHANGE)
    assert not rollup.compact(spark, ledger, "none")
    rollup.commit(batch, ledger, "b1")
    for _ in range(3):
        rollup.compact(spark, ledger, "c1")
        assert [tuple(r) for r in rollup.totals(spark, ledger).collect()] == [("a", "en", "1", 1, 10)]
    assert not rollup.commit(batch, ledger, "b1") and rollup.commit(batch, ledger, "b2")
    assert not rollup.compact(spark, ledger, "c1")  # made before: later batches stay as they are
    assert [r.tokens for r in rollup.totals(spark, ledger).collect()] == [20]
    assert rollup.compact(spark, ledger, "c2") and not rollup.commit(batch, ledger, "b1") and not rollup.commit(batch, ledger, "b2")
    assert [r.tokens for r in rollup.totals(spark, ledger).collect()] == [20]
    with pytest.raises(ValueError, match="base-"):
        rollup.commit(batch, ledger, "base-c2")


def test_a_compaction_that_was_cut_short_is_finished(spark, monkeypatch):
    ledger = store.new_path(spark, "ledger-cut")
    batch = spark.createDataFrame([("insert", "a", "en", "1", 10, None, None, "")], CHANGE)
    rollup.commit(batch, ledger, "b1")
    publish = rollup._publish

    def dies(*args):
        publish(*args)
        raise KeyboardInterrupt

    monkeypatch.setattr(rollup, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        rollup.compact(spark, ledger, "c1")
    monkeypatch.setattr(rollup, "_publish", publish)
    assert rollup._names(spark, ledger) == ["b1", "base-c1"]
    assert [r.tokens for r in rollup.totals(spark, ledger).collect()] == [10]
    with pytest.raises(RuntimeError, match="another"):
        rollup.compact(spark, ledger, "c2")
    rollup.compact(spark, ledger, "c1")
    assert rollup._names(spark, ledger) == ["base-c1"]
    assert [r.tokens for r in rollup.totals(spark, ledger).collect()] == [10] and not rollup.commit(batch, ledger, "b1")


def test_two_writers_of_one_batch(spark):
    ledger = store.new_path(spark, "ledger-two")
    batch = spark.createDataFrame([("insert", "a", "en", "1", 10, None, None, "")], CHANGE)
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: rollup.commit(batch, ledger, "b1"), range(4)))
    assert done.count(True) == 1 and [r.tokens for r in rollup.totals(spark, ledger).collect()] == [10]
    assert rollup._names(spark, ledger) == ["b1"]


def test_token_rollup_counts_by_both_libraries(spark, data, odd, tmp_path):
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = odd.select("doc_id", "text", "lang", "source", "key").withColumns({"version": F.lit("x"), "op": F.lit(1)})
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    byte, two = Tokenizer.from_file(P.path(queries.BYTE_BPE)), SentencePieceProcessor(model_file=P.path(queries.PIECE_BPE))
    want = Counter()
    for r in [*docs.collect(), *extra.collect()]:
        if r.doc_id is None or r.doc_id % 10 != 3:
            version = queries.BYTE_BPE if r.lang == "en" else queries.PIECE_BPE
            n = len(byte.encode(r.text or "", add_special_tokens=False).ids) if r.lang == "en" else len(two.encode(r.text or ""))
            want[r.source, r.lang, version, "docs"] += 1
            want[r.source, r.lang, version, "tokens"] += n
    got = Counter()
    for r in queries.op2_token_rollup(spark, str(tmp_path)).collect():
        got[r.source, r.lang, r.version, "docs"], got[r.source, r.lang, r.version, "tokens"] = r.docs, r.tokens
    assert got == want


# registration and the pipeline


def test_every_operator_has_its_query():
    names = queries.queries()
    assert {n[2:].split("_")[0] for n in names} == {str(i) for i in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_on_odd_rows(spark, data, odd, none, tmp_path):
    """Nulls, blank, long and repeated texts and clashing columns; every stage gives the columns that it got, and an empty table none."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1_000_000), allowMissingColumns=True)
    docs = docs.withColumns({name: F.lit("x") for name in ("n", "id", "chunk", "kept", "m", "r", "f", "tag", "starts", "ids", "length")})
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    none.write.parquet(f"{tmp_path}/b/documents.parquet")
    rows = c.run(spark, f"{tmp_path}/a").collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start * 4 == len(whole.setdefault(r.doc_id, b""))
        whole[r.doc_id] += r.ids
    assert 1_000_001 in whole and 1_000_002 not in whole  # one of the two copies and of their near copy
    stages = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        stages = spark.createDataFrame(stage(spark, stages, "").collect(), stages.schema)
        assert stages.columns == docs.columns
    assert {r.doc_id for r in stages.collect()} == set(whole)
    assert c.run(spark, f"{tmp_path}/b").count() == 0


def test_pipeline_stages_match_brute_force(spark, data):
    """Each stage against a plain reading of its rule on its own input."""
    import corpus_pipeline as c
    from tests.llm import test_documents as plain

    docs = spark.read.parquet(f"{data}/documents.parquet")
    written = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  a stage's tables go when the next one begins
    kept = written(c.quality_rules(spark, docs, data))
    judged = {r.doc.doc_id: r.kept for r in quality.judge(docs).collect()}  # tested against brute force by itself
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == {k for k, v in judged.items() if v}
    groups = plain.brute_components(sorted(rows.items()), 5, 80)
    first = written(c.near_duplicates(spark, kept, data))
    left = {r.doc_id: r.text for r in first.collect()}
    assert set(left) == {i for i, (_, low) in groups.items() if i == low}
    cut = {r.doc_id: r.text for r in c.repeated_passages(spark, first, data).collect()}
    ids = sorted(left)
    want = plain.brute_windows([left[i] for i in ids], 35)
    assert [plain.W.findall(cut[i] or "") for i in ids] == want


def test_pipeline(spark, data):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        now = {r.doc_id for r in docs.collect()}
        assert now and now <= ids
        ids = now
    packed = c.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert c.run(spark, data).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]
