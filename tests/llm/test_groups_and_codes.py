"""Prefix trie, SimHash groups and vector codes against plain forms of their own."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import codes, queries, simhash, trie

# prefix trie

TURN = "conv_id long, turn long, role string, text string, place string, fp string"


def brute_trie(convs):
    """Nodes of {conversation: turns}, with each sequence of turns as its own key."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    own = {p: (len(m) - 1) * (len(p[-1][1].encode().split()) if p else 0) for p, m in members.items()}
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own[p]
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], digest(ends[p])) for p, m in members.items()), key=repr)


def grouped(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_turns(seed, convs, most):
    rng = random.Random(seed)
    rows = [(rng.randrange(-5, convs), rng.choice([None, *range(most)]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b c", "", None, "d"]), "x", "y") for _ in range(convs * most)]
    return [*rows, *rows[:5], (None, 1, "user", "lost", "x", "y")]


@pytest.mark.parametrize("chunk,bits,slot", [(4096, 64, 16), (2, 64, 1), (3, 1, 0), (4096, 0, 16)])
def test_trie_matches_brute_force(spark, monkeypatch, chunk, bits, slot):
    """Chunks of a few places, and hashes of one bit or none, whose groups all have to be split."""
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "HASH_BITS", bits)
    monkeypatch.setattr(trie, "SLOT", slot)
    rows = random_turns(5, 25, 5)
    turns = trie.numbered(spark.createDataFrame(rows, TURN))
    want = grouped(rows)
    got = trie.build(turns, turns.select("conv_id").union(spark.createDataFrame([(900,), (-9,), (None,)], "conv_id long")))
    assert found(got) == brute_trie(want | {900: [], -9: []})


def test_trie_of_growing_conversations(spark, monkeypatch):
    """Each conversation goes on where the one before ends, so paths hang from one another in a chain; one is long."""
    monkeypatch.setattr(trie, "CHUNK", 16)
    text = lambda i: ("user" if i % 2 else "assistant", f"turn {i}")
    convs = {c: [text(i) for i in range(c)] for c in range(1, 30)} | {100: [text(i) for i in range(150)]}
    rows = [(c, i, *t, "", "") for c, ts in convs.items() for i, t in enumerate(ts)]
    turns = trie.numbered(spark.createDataFrame(rows, TURN).repartition(7))
    assert found(trie.build(turns, turns.select("conv_id"))) == brute_trie(convs)


def test_trie_of_nothing(spark):
    turns = trie.numbered(spark.createDataFrame([], TURN))
    assert trie.build(turns, turns.select("conv_id")).count() == 0
    only = trie.build(turns, spark.createDataFrame([(4,), (3,)], "conv_id long"))
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in only.collect()] == [(3, 0, 2, 1)]


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c} {t}", "", "") for c in [0, 1, 2, 3, 19, 21, 25, 40, 41, 59] for t in range(1 if c == 40 else 4)]
    turns, ids = queries.rebuilt(spark.createDataFrame(rows, TURN))
    convs, want = grouped(rows), {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = convs.get(c - c % 20, [])[:h] + convs[c][h:]
    assert {len(v) for v in want.values()} > {4} and found(trie.build(turns, ids)) == brute_trie(want)


# SimHash groups


def brute_print(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints, distance=4):
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(prints):
            for j in range(i):
                if (x ^ prints[j]).bit_count() <= distance and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


@pytest.mark.parametrize("groups", [1, 2, 3, 5])
@pytest.mark.parametrize("distance", [2, 4])
def test_anchors_miss_no_pair(groups, distance):
    """Of any two fingerprints within the distance, one is a visitor at a home of the other."""
    rng = random.Random(groups)
    for _ in range(60 if groups > 1 else 5):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), distance):
            b ^= 1 << bit
        row, anchor, home = simhash.anchors(np.array([a, b], np.uint64), groups, distance)
        at_home = [set(anchor[(row == i) & home]) for i in range(2)]
        assert all(len(h) == groups for h in at_home)
        assert at_home[0] & set(anchor[row == 1]) and at_home[1] & set(anchor[row == 0])


@pytest.mark.parametrize("homed,visitors,groups", [(2048, 4096, 3), (5, 7, 3), (2048, 4096, 2)])
def test_links_match_brute_force(spark, monkeypatch, homed, visitors, groups):
    """Clusters of near fingerprints, chains of them, and single ones; small blocks split every anchor."""
    monkeypatch.setattr(simhash, "HOMED", homed)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    monkeypatch.setattr(simhash, "ROWS", 3)
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, 1, 3, 2**64 - 1]
    for _ in range(120):
        x = rng.choice(prints[:5] + prints[-30:])
        for bit in rng.sample(range(64), rng.randrange(1, 7)):
            x ^= 1 << bit
        prints.append(x)
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = simhash.links(df, 4, groups).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() and r.a != r.b for r in links)
    at, root = {signed(x): i for i, x in enumerate(prints)}, list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for r in links:
        a, b = find(at[r.a]), find(at[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == least_reachable(prints)


def test_fingerprints_of_texts(monkeypatch):
    texts = ["a b c d", "A B C D", "a b c", "", None, " \t\n", "x" * 50, "a  b\x0bc d e f" * 40, "naïve É 漢字 🙂 \x85 end", "one two three four five " * 900]
    want = [brute_print(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want and want[0] == want[1] and want[3] == want[4] == want[5] == 0
    monkeypatch.setattr(simhash, "LETTERS", 40)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert [simhash.fingerprint(t) for t in texts] == want


def test_simhash_groups_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in docs]
    root = least_reachable(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash_groups(spark, data).collect()}
    assert got == {r.doc_id: (f"{prints[i]:016x}", docs[root[i]].doc_id) for i, r in enumerate(docs)}
    assert len({v[1] for v in got.values()}) < len(got)


def test_simhash_groups_on_odd_rows(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    got = sorted((str(r.id), r.fp & (2**64 - 1), r.component_id) for r in simhash.classes(odd).collect())
    low = {}
    for r in rows:
        low.setdefault(brute_print(r.text), []).append(r.doc_id)
    assert got == sorted((str(r.doc_id), brute_print(r.text), min((i for i in low[brute_print(r.text)] if i is not None), default=None)) for r in rows)
    assert simhash.classes(none).count() == 0


# vector codes


def brute_codes(rows):
    kept = [(i, label, [int(np.floor(x * 256)) if abs(x) < 1e9 else int(x) * 256 for x in v]) for i, label, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == width]
    cut = [(i * width // 16, (i + 1) * width // 16) for i in range(16)]
    books = [[r[2][s:e] for r in kept[:64]] for s, e in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(r[2][s:e], b), k) for k, b in enumerate(books[p])) for p, (s, e) in enumerate(cut)] for r in kept]
    for _ in range(2):
        told = assign()
        for p, (s, e) in enumerate(cut):
            for k in range(len(books[p])):
                mine = [r[2][s:e] for r, t in zip(kept, told, strict=True) if t[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    told, per = assign(), defaultdict(int)
    out = [(r[0], "".join(f"{k:02x}" for _, k in t), sum(d for d, _ in t), r[1]) for r, t in zip(kept, told, strict=True)]
    for _, _, e, label in out:
        per[label] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, min(e, 2**63 - 1), min(per[label], 2**63 - 1), digest) for i, c, e, label in out), key=repr)


def coded(df):
    return sorted((tuple(r)[:5] for r in codes.compress(df).collect()), key=repr)


VECTOR = "vec_id long, label int, embedding array<double>, id string, v string, code string"


@pytest.mark.parametrize("scale,width,n", [(0.2, 64, 150), (3.0, 37, 90), (1e6, 48, 80), (0.01, 16, 200), (1.0, 5, 40)])
def test_codes_match_brute_force(spark, scale, width, n):
    """Widths that 16 does not divide, components beyond 64-bit squares, many ties, fewer vectors than entries."""
    rng = np.random.default_rng(width)
    rows = [(int(i), int(rng.integers(3)) if i % 7 else None, (rng.normal(size=width) * scale).tolist(), "", "", "") for i in range(n)]
    rows += [(3, 1, rows[5][2], "", "", ""), (3, 1, rows[5][2], "", "", ""), (None, 2, rows[6][2], "", "", ""), (-4, 2, rows[1][2], "", "", "")]
    df = spark.createDataFrame(rows, VECTOR).repartition(3)
    assert coded(df) == brute_codes([r[:3] for r in rows])


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0] * 16), (1, 1, [nan] * 16), (2, None, None), (3, 2, [None] + [1.0] * 15), (4, 2, [inf] * 16), (5, 1, [1e30] + [-1e300] * 15), (6, 1, []), (7, None, [2.0] * 17), (8, None, [-3e38] * 16), (9, None, [0.5] * 16)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], VECTOR)
    assert coded(df) == brute_codes(rows)
    assert codes.compress(df.limit(0)).count() == 0
    floats = df.withColumn("embedding", F.col("embedding").cast("array<float>")).filter("vec_id not in (5)")
    assert {r[0] for r in coded(floats)} == {0, 8, 9}


def test_bounds_spare_exact_distances():
    """Entries are filtered, the coarse level first, and none that is nearest is lost."""
    rng = np.random.default_rng(0)
    for length in (1, 2, 3, 4, 8, 13):
        x, entries = rng.integers(-150, 150, (400, length)), rng.integers(-150, 150, (64, length))
        entries[9] = entries[7]
        code, far, looked = codes.nearest(x, entries)
        every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
        assert looked < 0.5 * every.size
