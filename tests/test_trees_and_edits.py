"""Trees by pointer doubling; line matching, diffs and fuzzy scores against plain forms."""

import random
import re
import time

from pyspark.sql import functions as F

from quern.functions import lines, text
from quern.operators import joins


def below(spark, rows, root):
    df = spark.createDataFrame(rows, "id long, parent long")
    return {r.id: r.depth for r in joins.descendants(spark, df, "id", "parent", root).collect()}


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = joins.scratch
    monkeypatch.setattr(joins, "scratch", lambda s: rounds.append(real(s)) or rounds[-1])
    chain = [(i, i - 1) for i in range(5000)]
    assert below(spark, chain, 1000) == {i: i - 1000 for i in range(1000, 5000)}
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rounds[0])
    assert len(paths.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(paths)) <= 15


def test_rings_ends_and_repeats(spark):
    ring = [(1, 3), (2, 1), (3, 2), (4, 2), (10, 12), (11, 10), (12, 11), (13, 12), (20, None), (21, 20), (22, 99), (None, 1), (5, 4), (5, 1), (4, 2)]
    assert below(spark, ring, 1) == {1: 0, 2: 1, 3: 2, 4: 2, 5: 1}
    assert below(spark, ring, 20) == {20: 0, 21: 1} and below(spark, ring, 77) == {} and below(spark, ring, 99) == {}


def test_descendants_match_a_plain_walk(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, *range(max(0, i - 9), i)])) for i in range(1, 150)] + [(0, None)]
    want, level = {0: 0}, {0}
    while level:
        level = {i for i, p in rows if p in level and i not in want}
        want |= {i: max(want.values()) + 1 for i in level}
    assert below(spark, rows, 0) == want


# lines: distances, blocks, patches, scores


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_match_the_table():
    rng = random.Random(1)
    for n in range(400):
        a, b = ("".join(rng.choice("abcé🙂"[: rng.randrange(2, 6)]) for _ in range(rng.randrange(0, 90 if n % 5 == 0 else 9))) for _ in range(2))
        want = plain_distance(a, b)
        assert lines.edit_distance(a, b) == lines.edit_distance(b, a) == want
        for most in (0, 1, want - 1, want, want + 1, 99):
            assert lines.edit_distance(a, b, most) == (want if want <= most else None)
    long = "".join(rng.choice("ab") for _ in range(20_000))
    assert lines.edit_distance(long, long[:9_000] + "x" + long[9_000:], 3) == 1 and lines.edit_distance(long, long[::-1], 50) is None


def plain_candidates(content, old):
    """The matchers as they read, window by window."""
    have, want = content.split("\n"), old.split("\n")
    short = want[:-1] if len(want) > 1 and want[-1] == "" else want
    alike = lambda n, f: [x for x in ("\n".join(have[i : i + n]) for i in range(len(have) - n + 1)) if f(x)]
    strip = lambda x: [r.strip() for r in x.split("\n")]
    spans = [(i, j + 1) for i in range(len(have)) if have[i].strip() == short[0].strip() for j in [next((j for j in range(i + 2, len(have)) if have[j].strip() == short[-1].strip()), -1)] if j > 0]
    yield [old]
    yield alike(len(short), lambda x: strip(x) == strip("\n".join(short)))
    block = old.rstrip("\n").split("\n")
    found = [(i, j + 1) for i in range(len(have)) if have[i].strip() == block[0].strip() for j in [next((j for j in range(i + 2, len(have)) if have[j].strip() == block[-1].strip()), -1)] if j > 0] if len(block) > 2 else []

    def score(s):
        inner = min(len(block), s[1] - s[0]) - 2
        return sum(1 - plain_distance(a, b) / max(len(a), len(b), 1) for a, b in ((have[s[0] + k].strip(), block[k].strip()) for k in range(1, inner + 1))) / inner if inner > 0 else 1.0

    best = max(found, key=score, default=None)
    yield ["\n".join(have[best[0] : best[1]])] if best and (len(found) == 1 or score(best) >= 0.3) else []
    squeeze = lambda x: " ".join(x.split())
    inside = []
    for line in have:
        if squeeze(line) == squeeze(old):
            inside.append(line)
        elif squeeze(line) and squeeze(old) in squeeze(line) and (m := re.search(r"\s+".join(map(re.escape, old.split())), line)):
            inside.append(m[0])
    yield inside + (alike(len(want), lambda x: squeeze(x) == squeeze(old)) if len(want) > 1 else [])
    yield alike(len(want), lambda x: text._dedent(x) == text._dedent(old))
    meant = text._unescape(old)
    yield [meant] * (meant in content) + (alike(meant.count("\n") + 1, lambda x: text._unescape(x) == meant) if "\\" in content else [])
    yield ([old.strip()] * (old.strip() in content) + alike(len(want), lambda x: x.strip() == old.strip())) if old.strip() != old else []
    context = [s for s in spans if s[1] - s[0] == len(short)] if len(want) > 2 else []
    half = lambda s: [a == b for a, b in zip(strip("\n".join(have[s[0] + 1 : s[1] - 1])), strip("\n".join(short[1:-1])), strict=True) if a or b] if len(short) > 2 else []
    yield ["\n".join(have[a:b]) for a, b in context if 2 * sum(half((a, b))) >= len(half((a, b)))]
    yield [old] * content.count(old)


def test_matchers_match_their_plain_form():
    """All nine on random texts of few different lines, with odd margins, blanks and escapes."""
    rng = random.Random(6)
    bits = ["a", " a", "a ", "b c", "b  c", "\tb c", "", " ", "end", "  end", "x\\ty", "x\ty", "it\\'s", "abcdef", "abcxef", "\\"]
    some = lambda n: "\n".join(rng.choice(bits) for _ in range(rng.randrange(1, n)))
    hits = [0] * 9
    for _ in range(1500):
        content, old = some(14), some(5)
        if rng.random() < 0.5:  # a part of the content with a line changed
            rows = content.split("\n")
            i = rng.randrange(len(rows))
            part = rows[i : i + rng.randrange(2, 7)]
            part[rng.randrange(len(part))] = rng.choice(bits)
            old = "\n".join(x.strip() if rng.random() < 0.3 else x for x in part)
        if rng.random() < 0.3:
            old = old + "\n"
        got, want = [list(x) for x in text._candidates(content, old)], list(plain_candidates(content, old))
        assert got == want, (content, old)
        hits = [h + bool(x) for h, x in zip(hits, want, strict=True)]
    assert min(hits) > 20


def test_large_contents_take_seconds():
    rng = random.Random(2)
    rows = [f"  line {i} " + "".join(rng.choice("abc ") for _ in range(30)) for i in range(10_000)]
    block = [r.strip() for r in rows[4_000:4_400]]
    block[200] = "changed a little " + block[200]
    began = time.time()
    done = text.replace_once("\n".join(rows), "\n".join(block), "gone")
    assert done == "\n".join([*rows[:4_000], "gone", *rows[4_400:]])
    marked = [x for i in range(300) for x in ("begin", *rows[i * 30 : i * 30 + 30], "end")]
    text.replace_once("\n".join(marked), "\n".join(["begin", *(r.strip() + "!" for r in rows[3_000:3_030]), "end"]), "gone")
    assert time.time() - began < 10


def plain_apply(old, patch, new):
    """Both sides of a patch with whole context."""
    out = [[], []]
    for row in patch.split("\n")[3:-1] if patch else []:
        for side, marks in ((0, " -"), (1, " +")):
            if row[0] in marks:
                out[side].append(row[1:] + "\n")
        if row[0] == "\\":
            for side in (0, 1):
                if last in (" -" if side == 0 else " +"):
                    out[side][-1] = out[side][-1][:-1]
        last = row[0]
    return ("".join(out[0]), "".join(out[1])) if patch else (old, old)


def test_patches_apply(spark):
    rng, pairs = random.Random(9), [("", ""), ("", "a"), ("a\n", "a"), ("a", "a\n"), ("a\nb", ""), ("x y\x0bz\r\n", "x y\n")]
    for _ in range(400):
        a = [rng.choice("abcdefgh"[: rng.randrange(2, 9)]) for _ in range(rng.randrange(0, 25))]
        b = [x for x in a if rng.random() < 0.8] + [rng.choice("abz") for _ in range(rng.randrange(3))]
        rng.random() < 0.3 and rng.shuffle(b)
        pairs.append(("\n".join(a) + "\n" * rng.randrange(2), "\n".join(b) + "\n" * rng.randrange(2)))
    for a, b in pairs:
        assert plain_apply(a, lines.unified(a, b), b) == (a, b)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").withColumn("p", text.unified_patch("a", "b"))
    sides = df.filter("p <> ''").select("a", "b", text.patch_side(F.col("p"), False).alias("x"), text.patch_side(F.col("p"), True).alias("y")).collect()
    assert len(sides) > 200 and all((r.x, r.y) == (r.a, r.b) for r in sides)


def test_patches_are_short_and_bounded():
    rng = random.Random(3)
    for _ in range(200):  # no longer than the shortest one, where nothing is given up
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = lines.matching(a, b)
        assert all(a[i] == b[j] for i, j in kept) and all(p < q and r < s for (p, r), (q, s) in zip(kept, kept[1:]))
        assert len(kept) == table[-1][-1]
    began = time.time()
    same = ["same"] * 100_000
    assert len(lines.matching(same, same[:-7])) == 99_993
    mixed = [rng.choice("abcdefgh") for _ in range(20_000)]
    kept = lines.matching(mixed, [rng.choice("abcdefgh") for _ in range(20_000)])
    assert len(kept) > 5_000
    moved = same[:50_000] + ["x"] + same[50_000:] + ["y"] * 3
    assert len(lines.matching(same, moved)) == 100_000
    assert time.time() - began < 60


def plain_score(t, q):
    t, q, at, gaps, first = t.lower(), q.lower(), 0, 0, None
    for c in q:
        i = t.find(c, at)
        if i < 0:
            return None
        gaps += i - at if first is not None else 0
        first = i if first is None else first
        at = i + 1
    return 1.0 / (1.0 + gaps + 0.1 * (first or 0) + 0.01 * (len(t) - len(q)))


def test_fuzzy_scores(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcA_%\\é🙂") for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    pairs = [(t, q) for t in words for q in [*words[:10], "a", "%", "_a", "\\", ""]]
    df = spark.createDataFrame(pairs, "t string, q string")
    got = df.select("t", "q", text.fuzzy_score("t", "q").alias("s")).collect()
    assert [r.s for r in got] == [plain_score(t, q) for t, q in pairs]
    for q in ("a", "%", "_a", "\\", "", "aé"):
        fits = {r.t for r in df.filter(text.fuzzy_fits(F.col("t"), q)).collect()}
        assert fits == {t for t in words if plain_score(t, q) is not None}
