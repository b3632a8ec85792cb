"""Near-duplicate documents by SimHash fingerprints, joined within a Hamming distance through anchors of a covering code.

1. A text's ``k``-word shingles (A-Z lower-cased, repeats included) are hashed by XXH64; a bit of the fingerprint is 1 if
   more than half of the hashes have it.  Texts without words have fingerprint zero.  Equal fingerprints are one
   row from here on, however many documents have them.
2. The 64 bits are nine blocks of seven and one bit over.  Anchors are the words of a product of perfect Hamming codes
   (seven bits, four of them free): every seven bits lie within one bit of exactly one code word, so each fingerprint
   has one home anchor, within covering radius one a block.  Blocks are put into ``GROUPS`` groups: two fingerprints
   within ``distance`` differ by ``distance // GROUPS`` bits at most in one of the groups.
3. In each group a fingerprint goes to its home and, as a visitor, to every anchor that it could be homed at after that
   many bits more: all code words within covering radius plus threshold, summed over the blocks.  So of two linked
   fingerprints one is a visitor at the other's home.
4. At each anchor those at home are compared with all visitors, in blocks of bounded size where an anchor has many, and
   a spanning forest of the links found leaves the task, not the pairs.  Components over these are the groups.

More groups mean fewer copies and fewer anchors: three groups make some 27 copies of a fingerprint and 2**12 anchors each
(2**13 in the last), two groups 180 copies and 2**17 and more anchors.  Results are the same.

Null and blank texts have fingerprint zero and are linked like any other.  Rows without an id have a fingerprint and a
component, but name none: a component without any id has none.  Rows that repeat an id or a text are rows of their own.
Other columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import graph, store
from quern.llm.arrow import column, parts_of, tidied
from quern.llm.arrow import _WORD_END as WORD_END

U = np.uint64
GROUPS = 3
#: Fingerprints at home, and visitors, that are compared at once.
HOMED, VISITORS, ROWS = 2048, 4096, 256
#: Characters of a text, and shingles, that are handled at once.
LETTERS, SHINGLES = 4 << 20, 1 << 18
SEED = 42


def _add_bits(counts: np.ndarray, hashes: list[int]) -> None:
    for at in range(0, len(hashes), SHINGLES):
        raw = np.array(hashes[at : at + SHINGLES], U).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, k: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    counts, n, before = np.zeros(64, np.int64), 0, []
    for part in parts_of(text or "", LETTERS, WORD_END):
        words = before + part.encode().lower().split()
        if len(words) >= k:
            hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(k)), strict=False)]
            _add_bits(counts, hashes)
            n += len(hashes)
        before = words[max(0, len(words) - k + 1) :]
    if not n and before:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED)
    return int(np.packbits(2 * counts > n, bitorder="little").view(U)[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), k) for t in column(batch, "text")], U)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return run


def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """(code words, excess): by how much each of the 128 words of seven bits lies farther than one bit from each code word."""
    bits = (np.arange(128)[:, None] >> np.arange(7)) & 1
    syndrome = np.bitwise_xor.reduce(bits * np.arange(1, 8), axis=1)
    code = np.flatnonzero(syndrome == 0)
    return code, np.maximum(np.bitwise_count(np.arange(128)[:, None] ^ code[None, :]).astype(np.int64) - 1, 0)


def _blocks(groups: int) -> list[list[int]]:
    """The blocks (0 to 8 of seven bits, 9 of one bit) of each group."""
    return [list(x) for x in np.array_split(np.arange(10), groups)] if groups > 3 else [list(range(9 * g // groups, 9 * (g + 1) // groups)) + [9] * (g == groups - 1) for g in range(groups)]


def anchors(prints: np.ndarray, groups: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for every anchor that a fingerprint goes to; anchors of different groups have different numbers."""
    _, excess = _hamming()
    out = []
    for g, blocks in enumerate(_blocks(groups)):
        row, anchor, far = np.arange(len(prints)), np.full(len(prints), g, np.int64), np.zeros(len(prints), np.int64)
        for b in blocks:
            more = np.array([[0, 1], [1, 0]]) if b == 9 else excess
            value = ((prints >> U(7 * b)) & U(1 if b == 9 else 127)).astype(np.int64)
            reach = far[:, None] + more[value[row]]
            who, word = np.nonzero(reach <= distance // groups)
            row, anchor, far = row[who], anchor[who] * more.shape[1] + word, reach[who, word]
        out.append((row, anchor * groups + g, far == 0))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _replicated(groups: int, distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = column(batch, "fp").to_numpy().view(U)
            for at in range(0, len(prints), 4096):
                row, anchor, home = anchors(prints[at : at + 4096], groups, distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(prints[at + row].view(np.int64))], names=["anchor", "home", "fp"])

    return run


def forest(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two sets of fingerprints."""
    near = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(left), ROWS):
        apart = np.bitwise_count(left[at : at + ROWS, None] ^ right[None, :])
        near[at : at + ROWS] = (apart <= distance) & (apart > 0)
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, left, right = near[np.ix_(rows, cols)], left[rows], right[cols]
    # labels spread over the links until each part has its least fingerprint's
    mine, theirs, most = left.copy(), right.copy(), U(2**64 - 1)
    while len(rows):
        new = np.minimum(theirs, np.where(near, mine[:, None], most).min(axis=0))
        old, theirs = theirs, new
        new = np.minimum(mine, np.where(near, theirs[None, :], most).min(axis=1))
        if (new == mine).all() and (old == theirs).all():
            break
        mine = new
    a, b = np.concatenate([mine, theirs]), np.concatenate([left, right])
    return a[a != b], b[a != b]


def _compared(distance: int):
    """Rows sorted by (anchor, i, j): the links of each such group."""

    def links(prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return forest(np.unique(prints[home]), np.unique(prints[~home]), distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64), np.zeros(0, U), np.zeros(0, bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            new = np.stack([column(batch, c).to_numpy() for c in ("anchor", "i", "j")], axis=1), column(batch, "fp").to_numpy().view(U), column(batch, "home").to_numpy(zero_copy_only=False)
            keys, prints, home = (np.concatenate(x) for x in zip(held, new, strict=True))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            ends = [0, *cuts.tolist()]
            for s, e in zip(ends, ends[1:], strict=False):
                if home[s:e].any() and not home[s:e].all():
                    found.append(links(prints[s:e], home[s:e]))
            held = keys[ends[-1] :], prints[ends[-1] :], home[ends[-1] :]
            if sum(len(a) for a, _ in found) > 10_000:
                yield _edges(found)
                found = []
        found.append(links(held[1], held[2]))
        yield _edges(found)

    return run


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(prints: DataFrame, distance: int = 4, groups: int = GROUPS, owner: str = "") -> DataFrame:
    """(a, b): links that span every group of fingerprints (``fp``, distinct) within ``distance`` bits of one another."""
    went = store.table(prints.mapInArrow(_replicated(groups, distance), "anchor long, home boolean, fp long"), "anchors", owner)
    many = lambda n, size: F.ceil(n / size).cast("long")
    sizes = went.groupBy("anchor").agg(many(F.count_if("home"), HOMED).alias("rows"), many(F.count("*"), VISITORS).alias("cols"))
    cut = went.join(sizes.filter("rows * cols > 1"), "anchor", "left").withColumns({"rows": F.coalesce("rows", F.lit(1)), "cols": F.coalesce("cols", F.lit(1))})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    at_home = cut.filter("home").select("anchor", side("rows").alias("i"), upto("cols").alias("j"), "home", "fp")
    visits = cut.select("anchor", upto("rows").alias("i"), side("cols").alias("j"), F.lit(False).alias("home"), "fp")
    met = at_home.unionByName(visits).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return met.mapInArrow(tidied(_compared(distance)), "a long, b long")


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = 4, distance: int = 4, groups: int = GROUPS, owner: str = "") -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``: its fingerprint as a signed long, and the least id that is reachable over links."""
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = store.table(rows.mapInArrow(tidied(_fingerprints(k)), "id long, fp long"), "prints", owner)
    kinds = store.table(rows.groupBy("fp").agg(F.min("id").alias("low")), "kinds", owner)
    part = graph.components(links(kinds.select("fp"), distance, groups, owner), owner)
    rooted = store.table(kinds.join(part.select(F.col("node").alias("fp"), "root"), "fp", "left"), "rooted", owner)
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("low").alias("least"))
    # most fingerprints are linked with none and have no root: they don't meet under a null one
    named = rooted.filter("root is not null").join(least, "root").select("fp", F.col("least").alias("component_id"))
    named = named.union(rooted.filter("root is null").select("fp", "low"))
    return rows.join(named, "fp").select("id", "fp", "component_id")
