import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing, piece, sstable, store, tokens

PATH = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé.\n\t\x00\x1c'　 ,s1🙂", max_size=40), min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    enc = tokens.encoder(PATH)
    ids, at = enc.encode(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.model.encode(x, add_special_tokens=False).ids


def test_a_full_cache_keeps_the_batch(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    enc = tokens.Encoder(PATH)
    for texts in (["a b c d", "e f"], ["a b z", "y x w v u"], ["a b c"]):
        ids, at = enc.encode(pa.array(texts))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [enc.model.encode(x).ids for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=40))
def test_pack_is_exact(lengths):
    got, left = packing.pack(lengths, 64)
    assert not left
    seen = {}
    for d, start, n, s, at in got:
        assert n > 0
        seen.setdefault(d, []).append((start, n))
    for d, n in enumerate(lengths):
        pos = 0
        for start, size in sorted(seen.get(d, [])):
            assert start == pos
            pos += size
        assert pos == n
    by = {}
    for _, _, n, s, at in got:
        by.setdefault(s, []).append((at, n))
    for parts in by.values():
        pos = 0
        for at, n in sorted(parts):
            assert at == pos
            pos += n
        assert pos == 64 or pos & (pos - 1) == 0


def test_pack_prefers_the_cheapest():
    got, _ = packing.pack([40, 40, 30, 10, 8], 64)
    where = {d: s for d, _, _, s, _ in got if d < 2}
    assert where[0] != where[1]


def brute_pack(lengths, size):
    """The rule read literally, one piece at a time over a plain list."""
    rooms = [[size, 0.0] for _ in range(sum(lengths) // size)]
    todo, out, left = sorted(((-n, d, 0) for d, n in enumerate(lengths) if n)), [], 0
    while todo:
        n, d, start = todo.pop(0)
        n = -n
        fits = [r for r in rooms if r[0] >= min(n, size) and (n < size or r[1] == 0)] or [r for r in rooms if r[0] >= n] or [r for r in rooms if r[0]]
        if not fits:
            left += n
            continue
        r = min(fits, key=lambda r: r[1])
        take = min(n, r[0])
        out.append((d, start, take))
        r[0], r[1] = r[0] - take, r[1] + packing.cost(take)
        if take < n:
            todo = sorted([*todo, (take - n, d, start + take)])
    return out, left, sorted(round(r[1], 6) for r in rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=30))
def test_pack_matches_brute_force(lengths):
    got, left = packing.pack(lengths, 64, False)
    want, rest, costs = brute_pack(lengths, 64)
    assert sorted(x[:3] for x in got) == sorted(want) and sum(n for *_, n in left) == rest == sum(lengths) % 64
    spent = {}
    for *_, n, s, _ in got:
        spent[s] = spent.get(s, 0) + packing.cost(n)
    assert sorted(round(x, 6) for x in spent.values()) == costs


@pytest.mark.parametrize("parts,fan_in", [(1, 512), (50, 512), (50, 4)])
def test_one_short_tail_for_the_table(spark, data, monkeypatch, plain, parts, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").repartition(parts)
    rows = packing.pieces(docs, PATH).collect()
    size = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        size.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seen in size.values():
        at = 0
        for offset, n in sorted(seen):
            assert offset == at
            at += n
    short = [n for n in (sum(n for _, n in seen) for seen in size.values()) if n != packing.LENGTH]
    assert sum(short) < packing.LENGTH and len(set(short)) == len(short) and all(n & (n - 1) == 0 for n in short)
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start * 4 == len(whole.setdefault(r.doc_id, b""))
        whole[r.doc_id] += r.ids
    assert whole == {r.doc_id: np.array([*plain(r.text), 1], "<u4").tobytes() for r in docs.collect()}


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "LONG_TEXT", 200)
    enc = tokens.Encoder(PATH)
    texts = ["word and  more,\nLines " * 60, "x" * 900, "<|endoftext|> " * 40, "short", " \n " * 200]
    ids, at = enc.encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [enc.model.encode(x, add_special_tokens=False).ids for x in texts]
    assert all(len(x) <= tokens.LONG_PIECE for x in enc.slot) and len(enc.slot) == len(enc.at) == len(enc.size) and enc.chars == sum(map(len, enc.slot))


def test_packing_rows(odd, none, plain):
    got = packing.pieces(odd, PATH).collect()
    rows = {}
    for r in got:
        rows.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = sorted(len(plain(r.text)) + 1 for r in odd.collect())
    total = sum(r.length for r in got)
    assert total == sum(want)
    long = next(r for r in odd.collect() if r.doc_id == 8)
    ids = plain(long.text) + [1]
    for r in got:
        if r.doc_id == 8:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
    assert packing.pieces(none, PATH).count() == 0


def test_shards_round_trip(spark, odd, none, plain):
    folder = store.new_path(spark, "sst-test")
    shards = sstable.write(odd, folder, PATH)
    got = sstable.scan(shards, folder).orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), plain(r.text) + [2]) for r in odd.collect())
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in want]
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(ids) for _, ids in want)
    pos = 0
    for r in got:
        assert r.start == pos
        pos += r.n_tokens
    fs, _ = pafs.FileSystem.from_uri(folder)
    files = [sstable.Shard(fs.open_input_file(r.path)) for r in shards.collect()]
    assert sum(len(f.get(1)) for f in files) == 2
    assert sum(len(f.get(None)) for f in files) == 1
    assert sum(len(f.get(4)) for f in files) == 0
    empty = store.new_path(spark, "sst-empty")
    assert sstable.scan(sstable.write(none, empty, PATH), empty).count() == 0


def test_lookup_matches_brute_force(spark, data, odd, plain):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    folder = store.new_path(spark, "sst-lookup")
    shards = sstable.write(docs.repartition(3), folder, PATH)
    asked = [None, -5, 1, 2, 3, 5, 77, 10**9]
    wanted = spark.createDataFrame([(x,) for x in [*asked, 77]], "doc_id long")
    got = sorted((str(r.doc_id), r.ids) for r in sstable.lookup(shards, folder, wanted).collect())
    want = sorted((str(r.doc_id), [*plain(r.text), 2]) for r in docs.collect() if r.doc_id in asked)
    assert got == want and len(want) > 5
    ranges = shards.orderBy("shard").collect()
    assert all(a.last <= b.first for a, b in zip(ranges, ranges[1:], strict=False))
    monkey = sstable.RANGES
    try:
        sstable.RANGES = 0
        assert sorted((str(r.doc_id), r.ids) for r in sstable.lookup(shards, folder, wanted).collect()) == want
    finally:
        sstable.RANGES = monkey


def test_shard_blocks_and_damage(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2)
        for i in range(5000):
            w.add(sstable.key_of(i - 100), np.arange(i % 50, dtype=np.uint16))
        w.close()
    s = sstable.Shard(pafs.LocalFileSystem().open_input_file(str(path)))
    assert len(s.blocks) > 3 and s.docs == 5000
    assert all(len(s.get(i - 100)[0]) == i % 50 for i in range(0, 5000, 371))
    assert [sstable.id_of(k) for k, _ in s] == list(range(-100, 4900))
    assert not s.get(10_000)
    raw = bytearray(path.read_bytes())
    raw[10] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        sstable.Shard(pafs.LocalFileSystem().open_input_file(str(path))).get(-100)
    with pytest.raises(ValueError, match="ascend"):
        w = sstable.Writer(open(tmp_path / "y", "wb"), 2)
        w.add(b"b", np.zeros(1))
        w.add(b"a", np.zeros(1))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def same_as_library(library, texts):
    n, ids, back = piece.model(PIECES).batch(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        want = library.encode(x)
        assert ids[i] == ",".join(map(str, want)) and n[i] == len(want) and back[i] == library.decode(want), x


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab thernoiséñ▁ .\n\x00漢🙂", max_size=60), min_size=1, max_size=4))
def test_pieces_are_the_librarys(library, texts):
    same_as_library(library, texts)


def test_pieces_of_odd_and_real_texts(library, spark, data):
    real = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(60).collect()]
    same_as_library(library, ["", " ", "   a  b ", "x" * 5000, "the " * 2000, "\n\n", "▁▁", *real])


def test_backtracking_goes_back():
    m = piece.Model.__new__(piece.Model)
    scores = {"a": 0.0, "b": 0.0, "c": 0.0, "ab": -3.0, "bc": -1.0, "abc": -2.0}
    m.score, m.ids = scores, {p: i + 1 for i, p in enumerate(scores)}
    m.text, m.fits = {i: p for p, i in m.ids.items()}, {}
    own = {p: i for p, i in m.ids.items() if m.merge(p) == [p]}
    m.size = {i: len(p) for p, i in own.items()}
    m.shorter = {i: next((own[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in own), 0 if len(p) > 1 else None) for p, i in own.items()}
    for text in ("abc", "abab", "abbc", "aabcbc", "cabcab", "bcbcab"):
        longest = [max((len(p) for p in own if text.startswith(p, i)), default=0) for i in range(len(text) + 1)]
        assert [m.text[i] for i in m.walk(text, longest, 0)] == m.merge(text)


def test_piece_rows(odd, none):
    got = piece.digests(odd, PIECES).collect()
    assert len(got) == odd.count()
    assert {r.n_tokens for r in got if r.doc_id in (3, 5)} == {0}
    assert piece.digests(none, PIECES).count() == 0
