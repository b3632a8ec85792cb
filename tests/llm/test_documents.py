import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import arrow, ctw, graph, hashing, near, quality, substring

W = re.compile(r"[^\x20\x09-\x0D]+")


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


# hashing


def test_words_and_windows():
    texts = ["a b\tc", None, "", "  b c a  ", "é\x0bx", "c"]
    w = hashing.Words(pa.array(texts))
    assert w.count.tolist() == [3, 0, 0, 3, 2, 1]
    h = w.hash.tolist()
    assert h[1] == h[3] and h[2] == h[4] and h[0] == h[5] and h[2] == h[8] and len(set(h)) == 5
    two, whole = w.windows(2), w.whole(2)
    assert two[1] == two[3] and whole.tolist() == [True, True, False, True, True, False, True, False]
    assert hashing.sliding(np.array([3, 1, 2, 0], np.uint64), 3).tolist() == [1, 0]


def test_long_words_and_blocks(monkeypatch):
    texts = ["ab " * 50 + "x" * 500 + " y " + "z" * 90, "q" * 300, "", "a b c " * 40]
    want = hashing.Words(pa.array(texts)).hash.tolist()
    assert want[0] == want[1] != want[50] and len(want) == 50 + 3 + 1 + 120
    monkeypatch.setattr(hashing, "LETTERS", 64)
    assert hashing.Words(pa.array(texts)).hash.tolist() == want
    monkeypatch.setattr(hashing, "TABLE", 8)
    assert hashing.Words(pa.array(texts)).hash.tolist() == want


def test_parts_end_with_words():
    rng = np.random.default_rng(1)
    for _ in range(50):
        text = "".join(rng.choice(list("ab \n\u00e9")) for _ in range(rng.integers(0, 200)))
        parts = list(arrow.word_parts(text, 20, 3))
        assert "".join(p for _, p in parts) == text
        assert sum((W.findall(p) for _, p in parts), []) == W.findall(text)
        done = []
        for before, part in parts:
            assert before.split(" ") == done[-3:] if done else before == ""
            done += W.findall(part)


# quality rules


def brute_quality(text):
    words = W.findall(text or "")
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_measures_match_brute_force(spark, odd, data):
    rows = odd.select("doc_id", "text").union(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    for r in quality.measure(rows, "text").collect():
        assert tuple(r.m)[:5] == brute_quality(r.text)


def test_many_repeats_take_the_sorting_path(spark):
    text = " ".join(f"v{i}" for i in range(400)) + " x " + " ".join(f"v{i}" for i in range(400))
    got = quality.measure(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert tuple(got.m)[:5] == brute_quality(text)


def test_buckets_are_close(spark):
    rows = spark.range(0, 200_000, 37).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id and (r.id - r.b) * 64 <= max(r.id, 64) for r in rows)
    assert all(r.b == r.id for r in rows if r.id < 128)


def test_quality_keeps_columns_and_handles_odd_rows(odd, none):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count()
    assert {r.kept for r in got if r.doc.doc_id == 1} == {True}
    assert {r.base_failed for r in got if r.doc.doc_id in (3, 5, 6, 7, 8)} == {True}
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 2
    assert quality.judge(none).count() == 0


def test_a_source_with_its_own_level_is_kept(spark):
    """A source of tables with symbols throughout is judged by its own fence, an outlier elsewhere by that source's."""
    body = " ".join(f"word{i}" for i in range(80))
    marked = " ".join(f"word{i}|" for i in range(80))
    rows = [(i, marked, "en", "tables") for i in range(30)] + [(100 + i, body, "en", "prose") for i in range(30)] + [(999, marked, "en", "prose")]
    got = {r.doc.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0] and got[100] and not got[999]


def test_a_few_symbols_stand_out_where_there_are_none(spark):
    body = " ".join(f"word{i}" for i in range(80))
    rows = [(i, body, "en", "a") for i in range(200)] + [(999, body + " " + "#" * 8, "en", "a")]
    got = {r.doc.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0] and not got[999]


@pytest.mark.parametrize("groups", [100_000, 0])
def test_verdicts_match_brute_force(spark, data, odd, monkeypatch, groups):
    monkeypatch.setattr(quality, "GROUPS", groups)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source").union(odd.select("doc_id", "text", "lang", "source"))
    texts = [(r.text, r.lang, r.source) for r in docs.collect()]
    rated = []
    for text, lang, source in texts:
        n, chars, symbols, dup, repeat = brute_quality(text)
        lines = sum(bool(W.search(x)) for x in (text or "").split("\n"))
        rates = {"symbol_pm": 1000 * symbols // max(chars, 1), "dup_line_pm": 1000 * dup // max(lines, 1), "repeat_pm": 1000 * repeat // max(n, 1), "chars_pw": 1000 * chars // max(n, 1)}
        rated.append((n < 50 or 2 * repeat > n, lang, source, {k: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0) for k, v in rates.items()}))

    def limit(k, lang, source):
        good = [r for r in rated if not r[0]]
        for level in ([r for r in good if r[1:3] == (lang, source)], [r for r in good if r[1] == lang], good):
            values, tail = sorted(r[3][k] for r in level), quality.TAIL[k]
            if len(values) * tail >= 3000 or (level is good and values):
                at = lambda share: values[-(-len(values) * share // 1000) - 1]  # noqa: E731, B023
                return at(tail) - (at(500) - at(tail)) // 2 if k == "chars_pw" else -1, at(1000 - tail) + (at(1000 - tail) - at(500)) // 2

    want = Counter()
    for (text, lang, source), (failed, _, _, rates) in zip(texts, rated, strict=True):
        inside = all(lo <= rates[k] <= hi for k in rates for lo, hi in [limit(k, lang, source)])
        want[text, lang, source, not failed and inside] += 1
    got = Counter((r.doc.text, r.doc.lang, r.doc.source, r.kept) for r in quality.judge(docs).collect())
    assert got == want and sum(n for (*_, kept), n in want.items() if not kept) > 10


# substring dedup


def brute_windows(texts, n):
    words = [W.findall(x or "") for x in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append([x for x, g in zip(w, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("n", [1, 3, 4, 7, 35])
def test_repeats_match_brute_force(spark, odd, n):
    rng = np.random.default_rng(n)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 60))) for _ in range(40)]
    texts += [r.text for r in odd.collect()] + ["a b a b a b a b a b", "a b c d e f g h"]
    rows = spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "id long, text string, starts string").repartition(3)
    got = {r.id: W.findall(r.text or "") for r in substring.remove_repeats(rows, "text", n).collect()}
    want = brute_windows(texts, n)
    assert [got[i] for i in range(len(texts))] == want


def test_levels_double(monkeypatch):
    assert substring.levels(35) == [9, 18, 35] and substring.levels(64) == [8, 16, 32, 64] and substring.levels(7) == [7]
    assert all(b in (2 * a, 2 * a - 1) for n in range(1, 300) for a, b in zip(substring.levels(n), substring.levels(n)[1:], strict=False))


def test_a_level_extends_only_what_is_repeated():
    """Of the windows of 35 words, the second level counts anchors of those alone whose first anchor was repeated."""
    words = [f"w{i}" for i in range(200)]
    w = hashing.Words(pa.array([" ".join(words)]))
    small, least = substring._least(w, 35, 9)
    keep = least[60]
    take, twice = substring._candidates(w, 35, 9, np.zeros(1, np.uint64), pa.array([[int(np.int64(keep.view(np.int64)))]]), {}, (0, 0))
    assert take.any() and not twice.any() and (least[take] == keep).all() and not (least[~take] == keep).any()
    at = substring._anchors_at(*(lambda s, x: (s, np.where(take, x, np.uint64(0))))(*substring._least(w, 35, 18)), 18)
    first, last = np.flatnonzero(take)[[0, -1]]
    assert len(at) and first <= at.min() and at.max() <= last + 17


@pytest.mark.parametrize("start", [1, 2, 50])
def test_any_number_of_levels_gives_the_same(spark, monkeypatch, start):
    monkeypatch.setattr(substring, "START", start)
    rng = np.random.default_rng(8)
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, 70)) for _ in range(12)] + [f"a{i} {shared} b{i}" for i in range(4)] + [shared, shared, "", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r.id: W.findall(r.text or "") for r in substring.remove_repeats(rows, "text", 12).collect()}
    assert [got[i] for i in range(len(texts))] == brute_windows(texts, 12)


def test_repeats_keep_rows_and_columns(odd, none):
    cut = substring.remove_repeats(odd, "text", 35)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert [r.text for r in cut.filter("doc_id = 3").collect()] == [None]
    assert substring.remove_repeats(none).count() == 0
    assert substring.digest(substring.find(none), "text", "doc_id", 35).count() == 0


def test_flushes_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 10)
    texts = ["common passage of eight words in every text " + f"own{i}" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(2)
    assert {r.text.strip() for r in substring.remove_repeats(rows, "text", 8).collect()} == {f"own{i}" for i in range(30)}


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    """With parts of 64 characters every operator gives what it gives for whole texts."""
    rng = np.random.default_rng(9)
    shared = " ".join(f"s{i}" for i in range(45))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 90)) for _ in range(6)]
    texts += [f"{texts[0]} {shared} {texts[1]}", f" {shared}\n{texts[2]} ", texts[3], texts[3] + " ", "x" * 500, f"{'y' * 200} {shared}", "", None, shared, shared]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = F.col("doc_id") % 3 != 1

    def everything():
        cut = {r.doc_id: r.text for r in substring.remove_repeats(rows, "text", 12).collect()}
        digest = sorted(tuple(r) for r in substring.digest(substring.find(rows, "text", 12), "text", "doc_id", 12).collect())
        classes = sorted(tuple(r) for r in near.classes(rows).collect())
        scores = sorted((r.doc_id, r.n_tokens, r.n_known, r.n_bytes, round(r.base_score, 6), round(r.score, 3)) for r in ctw.score(rows, train, carry=("doc_id",)).collect())
        return cut, digest, classes, scores

    want = everything()
    assert [W.findall(want[0][i] or "") for i in range(len(texts))] == brute_windows(texts, 12)
    monkeypatch.setattr(arrow, "SLICE_BYTES", 64)
    for module in (substring, near, ctw):
        monkeypatch.setattr(module, "LONG_TEXT", 64)
    monkeypatch.setattr(ctw, "SLICE", 64)
    monkeypatch.setattr(arrow.text_slices, "__defaults__", (64,))
    got = everything()
    assert got == want


def test_a_text_of_many_megabytes(spark):
    """20 MB of words, and 5 MB without a space."""
    words = " ".join(f"w{i % 1_000_003}x{i % 7}" for i in range(2_000_000))
    rows = spark.createDataFrame([(1, words), (2, "z" * 5_000_000), (3, words[:2000]), (4, words[-3000:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.digest(substring.find(rows), "text", "doc_id", 35).collect()}
    assert got[1][0] == 2_000_000 and got[2] == (1, 0) and got[3][0] - got[3][1] <= 1 and got[4][0] - got[4][1] <= 1
    assert {r.id: r.component_id for r in near.classes(rows).collect()} == {i: i for i in range(1, 5)}
    scores = {r.doc_id: r for r in ctw.score(rows, F.col("doc_id") != 1, carry=("doc_id",)).collect()}
    assert scores[1].n_bytes == len(words) + 1 and scores[2].n_tokens == 2 and scores[2].bits_per_byte < 0.1


# near-duplicates


def brute_components(rows, k, num):
    sets = []
    for _, x in rows:
        w = W.findall(low(x))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both * 100 >= num * len(sets[a] | sets[b]):
                up[max(root(a), root(b), key=lambda i: rows[i][0])] = min(root(a), root(b), key=lambda i: rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if root(j) == root(i))) for i in range(len(rows))}


def edited(rng, words, share):
    return [f"e{rng.integers(1 << 30)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, k, num):
    rng = np.random.default_rng(k)
    rows, ident = [], 100
    for size in (1, 2, 3, 6, 20, 58, 64, 70, 130, 600):
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.2):
            rows.append((ident, " ".join(edited(rng, base, share))))
            ident += 1
    rows += [(1, "Same Words HERE now and then"), (2, "same words here NOW and then"), (3, None), (4, "")]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in near.classes(df, k=k, num=num).collect()}
    assert got == brute_components(rows, k, num)


@pytest.mark.parametrize("block,sets,members,many", [(1 << 20, 1024, 4096, 1000), (1 << 9, 4, 5, 3), (1, 1, 1, 10)])
def test_blocks_change_no_link(spark, monkeypatch, block, sets, members, many):
    """A clump around the threshold, where hubs do not settle all, in one job or in many, with groups by a broadcast or by a join."""
    monkeypatch.setattr(near, "MANY", many)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "SETS", sets)
    monkeypatch.setattr(near, "MEMBERS", members)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.03))) for i in range(40)] + [(100 + i, " ".join(edited(rng, base[:30], 0.02))) for i in range(15)]
    got = {r.id: (r.n_shingles, r.component_id) for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_components(rows, 3, 85)
    assert got == want and 3 < len({c for _, c in want.values()}) < 40


def test_a_clump_of_many_sets(spark):
    """9,000 distinct near copies: a link to the next number alone would join them, and all are found."""
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*words[: i % 140], f"own{i}", *words[i % 140 + 1 :]])) for i in range(9000)]
    got = near.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).agg(F.min("component_id"), F.max("component_id"), F.sum(F.col("kept").cast("int")), F.count("*")).first()
    assert tuple(got) == (0, 0, 1, 9000)


def test_many_copies_take_the_broadcast(spark, monkeypatch):
    rows = [(i, "the same five words here now") for i in range(1200)] + [(5000 + i, f"some other text {i} with words") for i in range(300)] + [(9000, "the same five words here now and more words that differ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in near.classes(df, k=3, num=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_handles_odd_rows(odd, none):
    got = near.classes(odd).collect()
    assert len(got) == odd.count()
    assert {(r.component_id, r.kept) for r in got if r.id in (1, 2)} == {(1, True), (1, False)}
    assert [(r.component_id, r.kept) for r in got if r.id is None] == [(None, True)]
    assert {r.component_id for r in got if r.id in (3, 5, 6)} == {3, 5, 6}
    assert near.classes(none).count() == 0
    kept = near.first_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id is null").count() == 1
    assert kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id in (3, 5, 6)").count() == 3


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(1)
    for n in (80, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        o = n.bit_length() - 1
        x, y = near.registers(a, o), near.registers(b, o)
        used = (x != near.EMPTY) | (y != near.EMPTY)
        odds = near.chance(n, o)
        estimate = (((x == y) & used).sum() / used.sum() - odds) / (1 - odds)
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(estimate - truth) < near.MARGIN


@pytest.mark.parametrize("hub", [1000, 2])
def test_components_of_a_graph(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    monkeypatch.setattr(graph, "MOST", 20)
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)] + [(300, i) for i in range(200, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 301)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# context-tree weighting


def brute_ctw(texts, train):
    depth, counts = ctw.DEPTH, defaultdict(lambda: [0, 0])

    def steps(x):
        y = low(x).encode() + b"\xff"
        for i, c in enumerate(y):
            context, node = [y[i - k] if i >= k else 0 for k in range(1, depth + 1)], 1
            for k in range(8):
                bit = c >> (7 - k) & 1
                yield tuple(context), node, bit
                node = node * 2 + bit

    for x, t in zip(texts, train, strict=True):
        if t:
            for c, node, bit in steps(x):
                for d in range(depth + 1):
                    counts[c[:d], node][bit] += 1
    below = defaultdict(set)
    for c, node in list(counts):
        if c:
            below[c[:-1], node].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    known = {}

    def weight(c, node):
        if (c, node) not in known:
            e = kt(*counts.get((c, node), (0, 0)))
            known[c, node] = e if len(c) == depth else np.logaddexp(e, sum(weight(k, node) for k in below[c, node])) - math.log(2)
        return known[c, node]

    out = []
    for x in texts:
        total = 0.0
        for c, node, bit in steps(x):
            mixed, left = 0.0, 1.0
            for d in range(depth + 1):
                a, b = counts.get((c[:d], node), (0, 0))
                part = 1.0 if d == depth else math.exp(kt(a, b) - math.log(2) - weight(c[:d], node))
                mixed += left * part * (b + 0.5) / (a + b + 1)
                left *= 1 - part
            total += math.log10(mixed if bit else 1 - mixed)
        out.append(total)
    return out


def test_scores_match_brute_force(spark, odd, none):
    texts = ["the cat sat on the mat", "The hat of a cat", None, "", "zebra über 漢", "the cat sat on the mat", "mat cat hat " * 20]
    rows = [(i, x, i % 3 != 2) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, train boolean").repartition(2)
    got = {r.id: r for r in ctw.score(df, F.col("train"), carry=("id",)).collect()}
    want = brute_ctw(texts, [t for *_, t in rows])
    assert all(abs(got[i].score - want[i]) < 1e-4 for i in range(len(texts)))
    sizes = [len((x or "").encode()) + 1 for x in texts]
    assert all(got[i].n_bytes == sizes[i] and abs(got[i].bits_per_byte + want[i] / math.log10(2) / sizes[i]) < 1e-4 for i in range(len(texts)))
    counts = Counter(w for _, x, t in rows if t for w in [*W.findall(low(x)), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, x, _ in rows:
        w = [*W.findall(low(x)), None]
        base = sum(math.log10((counts.get(k, 0) + 1) / (total + distinct + 1)) for k in w)
        assert abs(got[i].base_score - base) < 1e-6
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts.get(k, 0) > 0 for k in w), total)
    assert ctw.score(odd, F.col("doc_id") == 1, carry=("doc_id",)).count() == odd.count()
    assert ctw.score(none, F.lit(True), carry=("doc_id",)).count() == 0
    assert all(r.score < 0 for r in ctw.score(odd, F.lit(False), carry=("doc_id",)).collect())


def test_odd_rows_are_scored_like_others(spark, odd):
    rows = [(i, r.text, r.lang == "en") for i, r in enumerate(odd.filter("doc_id is null or doc_id <> 8").collect())]
    got = {r.id: r for r in ctw.score(spark.createDataFrame(rows, "id long, text string, train boolean").repartition(3), F.col("train"), carry=("id",)).collect()}
    want = brute_ctw([x for _, x, _ in rows], [t for *_, t in rows])
    assert all(abs(got[i].score - want[i]) < 1e-3 for i, *_ in rows) and len(got) == len(rows)


@pytest.mark.parametrize("tree", [1, 50, 1 << 18])
def test_sub_trees_may_be_cut_anywhere(spark, monkeypatch, tree):
    monkeypatch.setattr(ctw, "TREE", tree)
    texts = ["the theme there then", "the thaw", "a b a b a c", "ünï ünï"] * 3
    df = spark.createDataFrame([(i, x, x, i) for i, x in enumerate(texts)], "id long, text string, kept string, chunk long").repartition(2)
    got = {r.id: r for r in ctw.score(df, F.col("id") % 4 != 1, carry=("id", "kept", "chunk")).collect()}
    want = brute_ctw(texts, [i % 4 != 1 for i in range(len(texts))])
    assert all(abs(got[i].score - want[i]) < 1e-4 and (got[i].kept, got[i].chunk) == (x, i) for i, x in enumerate(texts))


def test_held_out_text_is_coded_in_fewer_bits_with_training(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = ctw.score(docs.withColumn("held", held), ~held, carry=("doc_id", "held", ), scanned=True).filter("held").toPandas()
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    bits = -got["score"].sum() / math.log10(2) / sum(size[i] for i in got["doc_id"])
    assert bits < 3.2
    assert zlib.crc32(b"5") >= 0
