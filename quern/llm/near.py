"""Near-duplicate documents by HyperMinHash sketches, banding, and confirmation on whole shingle sets.

1. Each text becomes the set of its distinct ``k``-word shingles (64-bit hashes).  Equal sets are one class, whose
   representative is the least document; only representatives go on.
2. A class of 64 shingles or more gets a HyperMinHash sketch of 256 registers: per bucket the leading-zero count
   of the least hash and ten bits of its mantissa, in 16 bits.  Small sets spread several hash functions over fewer
   buckets, so that buckets are filled.  Bands of registers are the candidate keys, within a size octave
   (a set close below the next octave is sketched there too).  At the threshold a link is missed by all bands with a
   probability under 1e-8.  Smaller sets use their least hashes as keys: the prefix filter, which misses nothing.
   Sets that share a key are candidates, whatever the number of sets that share it.
3. Keys make stars, not pairs: a task links each key's other rows to its first one and sends one row per key.  The
   spokes of the stars (as many as rows) are estimated from the sketches, with the chance agreement of registers taken
   off, and those near the threshold or over it are confirmed on whole sets, each member alone against its hub.
4. Components over the links so far settle all keys whose sets lie in one component, as in a large group of copies.
   Of the other keys, candidates in different components are compared in blocks bounded by shingles: keys that hang
   together and fit one block as one job, the rest key by key and block pair by block pair.  Either way the same pairs
   are compared, those that share a key; work grows with the square of the sets of a key that are *not* linked by
   its star, and with nothing else.
5. Components over all links give every class, and so every row, its least document.  Classes with very many copies
   (at most ``HOT`` of them, by their least size) reach their rows by a broadcast, the others by a join.

Null or blank text has an empty set and is linked with nothing.  A null id gets a null component and is kept.  Rows
that repeat an id have their own sets, but are one node of the graph.  Ties in the least document are the same document.  An empty table gives an empty
result.  A long text is read in parts; what grows with it is its set, eight bytes for each distinct shingle.  Extra
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import graph, store
from quern.llm.arrow import column, signed, text_slices, tidied, word_parts
from quern.llm.hashing import U, Words, mix, seeded

REGISTERS = 256
MANTISSA = 10
EMPTY = 0xFFFF
#: Sets under so many shingles use the prefix filter.
SMALL = 64
#: Shingles, and sets, of one side of a block; members that a hub is compared with in one task.
BLOCK, SETS, MEMBERS = 1 << 19, 512, 4096
#: Most groups that are broadcast, and rows that one has at least.
HOT, MANY = 10_000, 1000
#: Sketch estimates spread by about 0.023; pairs whose estimate is more than six times that below the threshold are not confirmed.
MARGIN = 0.14
#: Bits of the map by which most documents that stay are told before any are moved.
MAP_BITS = 1 << 26
_SEEDS = seeded(16, 11)
_MIXERS = seeded(REGISTERS, 13)
FLUSH = 1 << 20
#: Texts over so many bytes are read in parts of as many characters.
LONG_TEXT = 4 << 20


def shingles(w: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the batch."""
    hashes, out = w.windows(k), []
    short = {j: w.windows(j) for j in range(1, k) if (w.count == j).any()}
    for s, c in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
        if c >= k:
            out.append(np.unique(hashes[s : s + c - k + 1]))
        elif c:
            out.append(mix(short[c][s : s + 1] ^ U(c)))
        else:
            out.append(np.zeros(0, U))
    return out


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """:func:`shingles` of a slice; a long text, which is a slice of its own, is read in parts."""
    if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > LONG_TEXT:
        found, words = [np.zeros(0, U)], 0
        for before, part in word_parts(texts[0].as_py(), LONG_TEXT, k - 1):
            w = Words(pa.array([before + part]), lower=True)
            words += int(w.count[0])
            found.append(np.unique(w.windows(k)))
        if words >= k:
            return [np.unique(np.concatenate(found))]
    return shingles(Words(texts, lower=True), k)


def registers(x: np.ndarray, octave: int) -> np.ndarray:
    """The sketch of a set at a size octave (6 and more): 256 registers of 16 bits."""
    bits = min(8, octave - 2)
    passes = REGISTERS >> bits
    h = np.sort(mix(x[None, :] ^ _SEEDS[:passes, None]), axis=1)
    at = (h >> U(64 - bits)).astype(np.int64) + (np.arange(passes) << bits)[:, None]
    at, h = at.ravel(), h.ravel()
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    rest = h[first] << U(bits)
    zeros = 63 - np.frexp(np.maximum(rest, U(1)).astype(np.float64))[1] + 1
    zeros = np.clip(zeros, 0, 62)
    zeros += (rest << zeros.astype(U)) < U(1 << 63)  # the float rounded up to the next power of two
    mantissa = ((rest << np.minimum(zeros + 1, 63).astype(U)) >> U(64 - MANTISSA)).astype(np.int64)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[at[first]] = np.minimum(zeros, 62) << MANTISSA | mantissa
    return out


def chance(n: float, octave: int) -> float:
    """The probability that registers of two unrelated sets of n shingles agree: same octave of the least hash, same mantissa."""
    load = n / (1 << min(8, octave - 2))
    p = [math.exp(-load * 2.0 ** -(z + 1)) - math.exp(-load * 2.0**-z) for z in range(40)]
    return sum(x * x for x in p) / (1 << MANTISSA)


def band_rows(threshold: float) -> int:
    return 6 if threshold >= 0.85 else 5


def octaves(n: int, num: int, den: int) -> list[int]:
    """The octaves at which a set of n shingles is sketched: its own, and the next one if it may be linked with a set there."""
    home = n.bit_length() - 1
    return ([home] if n >= SMALL else []) + ([max(home + 1, 6)] if n * den >= num * max(1 << (home + 1), SMALL) else [])


def keys_of(x: np.ndarray, sketch: list[tuple[int, np.ndarray]], num: int, den: int) -> np.ndarray:
    """The candidate keys of a set with its sketches by octave."""
    n, out = len(x), [np.zeros(0, U)]
    if 0 < n < SMALL:
        order = np.sort(mix(x))
        out.append(mix(order[: n - -(-num * n // den) + 1] ^ U(0x2545F4914F6CDD1D)))
    rows = band_rows(num / den)
    for o, regs in sketch:
        regs = regs[: REGISTERS // rows * rows].reshape(-1, rows)
        keys = mix((regs.astype(U) + U(1)) @ _MIXERS[:rows] + _MIXERS[rows : rows + len(regs)] + U(o))
        out.append(keys[(regs != EMPTY).any(axis=1)])
    return np.concatenate(out)


def _sketch(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for lo, hi in text_slices(texts):
                sets = sets_of(texts.slice(lo, hi - lo), k)
                with np.errstate(over="ignore"):
                    f1 = np.array([mix(x.sum(dtype=U) + U(len(x))) for x in sets], U)
                    f2 = np.array([mix(x ^ U(0xA0761D6478BD642F)).sum(dtype=U) for x in sets], U)
                sketches = [[(o, registers(x, o)) for o in octaves(len(x), num, den)] if len(x) else [] for x in sets]
                keys = [signed(keys_of(x, s, num, den)) for x, s in zip(sets, sketches, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                values = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                regs = pa.array([b"".join(r.tobytes() for _, r in s) for s in sketches], pa.binary())
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array(signed(f1)), pa.array(signed(f2)), pa.ListArray.from_arrays(pa.array(offsets), values), regs], ["id", "n", "f1", "f2", "keys", "regs"])

    return run


_odds = lru_cache(100_000)(chance)


def may_link(n: int, m: int, r: bytes, s: bytes, num: int, den: int) -> bool:
    """Can sets of n and m shingles with these sketches be linked, by their sizes and the corrected estimate?"""
    if min(n, m) * den < max(n, m) * num:
        return False
    if max(n, m) < SMALL:
        return True
    at = max(n, m).bit_length() - 1
    x, y = (np.frombuffer(b, np.uint16, REGISTERS, 2 * REGISTERS * octaves(c, num, den).index(at)) for c, b in ((n, r), (m, s)))
    full = (x != EMPTY) | (y != EMPTY)
    odds = _odds((n + m) // 2, at)
    return (np.count_nonzero(full & (x == y)) / max(np.count_nonzero(full), 1) - odds) / (1 - odds) >= num / den - MARGIN


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    n, m = len(x), len(y)
    if min(n, m) * den < max(n, m) * num:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * den >= (n + m - both) * num


def _with_hub(read, test):
    """Spokes (a, b) for which ``test`` holds; rows (a, side, hub, id and what ``read`` takes) are sorted, with the hub first in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for batch in batches:
            a, side, ident, hub = (column(batch, c).to_pylist() for c in ("a", "side", "id", "hub"))
            out: tuple[list, list] = ([], [])
            for at, x in read(batch):
                if (a[at], side[at]) != group:
                    group, hubs = (a[at], side[at]), []
                if hub[at]:
                    hubs.append(x)
                elif any(test(h, x) for h in hubs):
                    out[0].append(a[at])
                    out[1].append(ident[at])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return run


def _estimated(num: int, den: int):
    def read(batch: pa.RecordBatch):
        return enumerate(zip(column(batch, "n").to_pylist(), column(batch, "regs").to_pylist(), strict=True))

    return _with_hub(read, lambda x, y: may_link(x[0], y[0], x[1], y[1], num, den))


def _confirmed(k: int, num: int, den: int):
    def read(batch: pa.RecordBatch):
        texts = column(batch, "text")
        for lo, hi in text_slices(texts):
            yield from enumerate(sets_of(texts.slice(lo, hi - lo), k), lo)

    return _with_hub(read, lambda x, y: _linked(x, y, num, den))


def _per_group(rows: DataFrame, per: DataFrame, by: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``per``, which has one row, with its number of rows as ``size``, for each group of the columns ``by``.

    Groups with more than ``MANY`` rows and than the ``HOT``-th part of ``total`` (at least as many as all rows) are at
    most ``HOT``: they reach their rows by a broadcast, so that no group is dealt to one task by its key.
    """
    bound = max(MANY, total // HOT)
    more = [c for c in per.columns if c not in by]
    hot, cold = per.filter(F.col(size) > bound), per.filter(F.col(size) <= bound)
    flagged = rows.join(F.broadcast(hot), by, "left")
    return flagged.filter(F.col(size).isNotNull()).unionByName(flagged.filter(F.col(size).isNull()).drop(*more).join(cold, by))


def _round_hubs(spokes: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``spokes`` (a, b), at most ``total``, with the columns of ``nodes`` (id, ...) for the members and, once per ``MEMBERS`` of them, the hub; sorted by group."""
    sizes = spokes.groupBy("a").agg(F.count("*").alias("size")).withColumn("sides", F.ceil(F.col("size") / MEMBERS).cast("int"))
    members = _per_group(spokes, sizes, ["a"], "size", total).select("a", F.pmod(F.xxhash64("b"), F.col("sides")).cast("int").alias("side"), F.col("b").alias("id"), F.lit(False).alias("hub"))
    hubs = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), F.col("a").alias("id"), F.lit(True).alias("hub"))
    return members.union(hubs).join(nodes, "id").repartition("a", "side").sortWithinPartitions("a", "side", F.desc("hub"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, key, a, b): one row (b null) for each key and flush, to be met under g = key; the key's other rows as edges (a, b)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        key, ident = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((ident, key))
        key, ident = key[order], ident[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        hub = ident[new][np.cumsum(new) - 1]
        group = np.where(new, key, signed(mix(key.view(U) + mix(ident.view(U)))))
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(key), pa.array(hub), pa.array(ident, mask=new)], ["g", "key", "a", "b"])

    for batch in batches:
        keys = column(batch, "keys")
        ident = column(batch, "id").to_numpy()
        held.append((keys.flatten().to_numpy(), np.repeat(ident, pc.list_value_length(keys).to_numpy())))
        if sum(len(x[0]) for x in held) >= FLUSH:
            yield flush()
    if held:
        yield flush()


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links(sets: list[np.ndarray], side: np.ndarray, part: np.ndarray, keys: list[np.ndarray], num: int, den: int, both: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets that share a key and lie in different parts; with ``both``, only pairs across the two sides are looked at."""
    count = len(sets)
    n = np.array([len(x) for x in sets])
    if count < 2:
        return []
    owner, key = np.repeat(np.arange(count), [len(x) for x in keys]), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    owner, key = owner[order], key[order]
    share = np.zeros((count, count), bool)
    for who in np.split(owner, np.flatnonzero(key[1:] != key[:-1]) + 1):
        if len(who) > 1:
            share[np.ix_(who, who)] = True
    share &= part[:, None] != part[None, :]
    if both:
        share &= side[:, None] != side[None, :]
    if count <= 4:
        i, j = np.triu_indices(count, 1)
        ok = (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & share[i, j]
        picked = list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
    else:
        octave = np.array([x.bit_length() - 1 for x in n.tolist()])
        near = np.minimum.outer(n, n) * den >= np.maximum.outer(n, n) * num
        near &= np.triu(share, 1)
        for o in sorted(set(octave[octave >= 5].tolist()) | {6}):  # estimates need both sketches at one octave
            level = max(o, 6)
            at = np.flatnonzero((np.maximum(octave, 6) == level) | ((n * den >= num << level) & (octave < level)))
            at = at[n[at] >= SMALL // 2]
            if len(at) < 2:
                continue
            regs = np.stack([registers(sets[x], level) for x in at.tolist()])
            same, used = np.zeros((len(at), len(at)), np.int16), np.zeros((len(at), len(at)), np.int16)
            for r in regs.T:
                full = r != EMPTY
                same += (r[:, None] == r[None, :]) & full[:, None]
                used += full[:, None] | full[None, :]
            odds = chance(float(n[at].mean()), level)
            estimate = (same / np.maximum(used, 1) - odds) / (1 - odds)
            decided = np.maximum.outer(n[at], n[at]) >= max(1 << level, SMALL)
            near[np.ix_(at, at)] &= ~decided | (estimate >= num / den - MARGIN)
        i, j = np.nonzero(near)
        picked = list(zip(i.tolist(), j.tolist(), strict=True))
    found, forest = [], _Union(count)
    if len(picked) > 4 * count:  # many to confirm: all intersections at once, from the shingles that two sets share
        values, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(count), n)
        shared = np.bincount(where) > 1
        column_of = np.cumsum(shared) - 1
        held = shared[where]
        owner, where = owner[held], column_of[where[held]]
        common = np.zeros((count, count), np.float32)
        for c in range(0, int(shared.sum()), 4096):
            m = np.zeros((count, 4096), np.float32)
            part = (where >= c) & (where < c + 4096)
            m[owner[part], where[part] - c] = 1
            common += m @ m.T
        meet = common.astype(np.int64)
        for x, y in picked:
            if meet[x, y] * den >= (n[x] + n[y] - meet[x, y]) * num and forest.join(x, y):
                found.append((x, y))
        return found
    for x, y in picked:
        if forest.root(x) != forest.root(y) and _linked(sets[x], sets[y], num, den):
            forest.join(x, y)
            found.append((x, y))
    return found


def _across(k: int, num: int, den: int):
    """Links (a, b) within blocks: rows (grp, i, j, side, part, keys, id, text) are sorted by (grp, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        group = None

        def settle():
            ids, side, part, keys, sets = map(list, zip(*held, strict=True)) if held else ([], [], [], [], [])
            pairs = links(sets, np.array(side), np.array(part), keys, num, den, group is not None and group[1] != group[2])
            held.clear()
            return [ids[x] for x, _ in pairs], [ids[y] for _, y in pairs]

        for batch in batches:
            texts, keys = column(batch, "text"), column(batch, "keys")
            grp, i, j, ident, side, part = (column(batch, c).to_pylist() for c in ("grp", "i", "j", "id", "side", "part"))
            out: tuple[list, list] = ([], [])
            for lo, hi in text_slices(texts):
                sets = sets_of(texts.slice(lo, hi - lo), k)
                for at, x in enumerate(sets, lo):
                    if (now := (grp[at], i[at], j[at])) != group:
                        a, b = settle()
                        out[0].extend(a)
                        out[1].extend(b)
                        group = now
                    held.append((ident[at], side[at], part[at], keys[at].values.to_numpy(), x))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])
        a, b = settle()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _crossing(edges: DataFrame, part: DataFrame, sizes: DataFrame, named: DataFrame, k: int, num: int, den: int, owner: str) -> DataFrame | None:
    """Links (a, b) among candidates in different components of ``part`` (node, root); None if no key has such."""
    rows = edges.select(F.inline(F.array(F.struct("key", F.col("a").alias("id")), F.struct("key", F.col("b").alias("id"))))).distinct()
    rows = store.table(rows.join(part.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("part")), "keys", owner)
    keys = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("id").alias("hub"), F.count("*").alias("size")).filter("low <> high")
    rows = store.table(_per_group(rows, keys, ["key"], "size", rows.count()).join(sizes, "id").select("key", "id", "part", "n", "hub"), "open", owner)
    if rows.isEmpty():
        return None
    weight = F.greatest("n", F.lit(BLOCK // SETS))
    # keys that hang together: each set with the least one of its key
    clump = graph.components(rows.select(F.col("hub").alias("a"), F.col("id").alias("b")), owner)
    sets = rows.groupBy("id", "part", "n").agg(F.collect_set("key").alias("keys")).join(clump.select(F.col("node").alias("id"), "root"), "id")
    sets = store.table(sets, "clumps", owner)
    whole = sets.groupBy("root").agg(F.sum(weight).alias("weight"), F.count("*").alias("size"))
    sized = _per_group(sets, whole, ["root"], "size", sets.count())
    small = sized.filter(F.col("weight") <= BLOCK).select("id", "part", "n", "keys", F.col("root").alias("grp"), F.lit(1).alias("blocks"))
    large = store.table(sized.filter(F.col("weight") > BLOCK).select("id", "part", "n", F.explode("keys").alias("grp")), "large", owner)
    blocks = large.groupBy("grp").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("blocks"), F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size")).filter("low <> high")
    large = _per_group(large, blocks, ["grp"], "size", large.count()).select("id", "part", "n", F.array("grp").alias("keys"), "grp", "blocks")
    cut = small.union(large).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "grp", "side", "part", "keys", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a task's work is more than its bytes say
    met = cut.join(named, "id").repartition(tasks, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return store.table(met.mapInArrow(tidied(_across(k, num, den)), "a long, b long"), "links", owner)


def _maybe(rows: DataFrame, ident: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``__may``: false where the row's id is surely none of ``ids`` (id), by a map of hashed bits that is sent to all tasks.

    The map has sixteen bits for each id and ``MAP_BITS`` at most (8 MB); beyond that more rows may be among them.
    """
    bits = min(MAP_BITS, 1 << max(15, (16 * ids.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    split = lambda c: [F.floor(at(c) / 32768).alias("__page"), (at(c) % 32768).alias("__spot")]
    pages = ids.select(*split("id")).groupBy("__page").agg(F.bitmap_construct_agg("__spot").alias("__bits"))  # of 4 KB each
    byte = "cast(conv(hex(substring(__bits, cast(__spot div 8 as int) + 1, 1)), 16, 10) as int)"
    may = F.coalesce(F.expr(f"(shiftright({byte}, cast(__spot % 8 as int)) & 1) = 1"), F.lit(False)) & F.col(ident).isNotNull()
    return rows.select("*", *split(ident)).join(F.broadcast(pages), "__page", "left").select(*rows.columns, may.alias("__may"))


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = 3, num: int = 85, den: int = 100, owner: str = "") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``."""
    everything = docs.select(F.col(ident).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = everything.filter("id is not null")
    rows = store.table(everything.mapInArrow(tidied(_sketch(k, num, den)), "id long, n long, f1 long, f2 long, keys array<long>, regs binary"), "sketches", owner)
    proper = rows.filter("n > 0 and id is not null")
    same = ["f1", "f2", "n"]
    kinds = store.table(proper.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes", owner)
    reps = proper.join(kinds.withColumn("id", F.col("rep")), ["id", *same]).select("id", "n", "keys", "regs")
    stars = reps.select("id", "keys").mapInArrow(tidied(_stars), "g long, key long, a long, b long")
    met = stars.withColumn("hub", F.min("a").over(Window.partitionBy("g")))
    edges = met.select("key", F.when(F.col("b").isNull(), F.col("hub")).otherwise(F.col("a")).alias("a"), F.coalesce("b", "a").alias("b")).filter("a <> b")
    edges = store.table(edges, "stars", owner)

    # written, so that planning knows how many there are: while they are few, no text and no sketch without a candidate is shuffled
    ids = store.table(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids", owner)
    named = store.table(named.join(ids, "id", "left_semi"), "texts", owner)
    nodes = store.table(proper.select("id", "n", "regs").join(ids, "id", "left_semi"), "nodes", owner)
    total = edges.count()
    near = store.table(_round_hubs(edges.select("a", "b").distinct(), nodes, total).mapInArrow(tidied(_estimated(num, den)), "a long, b long").distinct(), "near", owner)
    sure = store.table(_round_hubs(near, named, total).mapInArrow(tidied(_confirmed(k, num, den)), "a long, b long"), "sure", owner)
    part = graph.components(sure, owner)
    crossing = _crossing(edges, part, kinds.select(F.col("rep").alias("id"), "n").groupBy("id").agg(F.max("n").alias("n")), named, k, num, den, owner)
    if crossing is not None:
        part = graph.components(part.select(F.col("root").alias("a"), F.col("node").alias("b")).union(crossing), owner)
    roots = part.select(F.col("node").alias("rep"), "root")

    found = store.table(kinds.join(roots, "rep", "left").select(*same, F.coalesce("root", "rep").alias("component_id"), "copies"), "components", owner)
    done = _per_group(proper.select("id", *same), found, same, "copies", rows.count()).select("id", "n", "component_id")
    done = done.union(rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    return done.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, owner: str = "") -> DataFrame:
    """``docs`` with one document of each group of near copies, its least; of rows that repeat its id and text one stays.  Rows without an id, and blank ones, stay."""
    found = store.table(classes(docs, "doc_id", "text", k, num, den, owner), "classes", owner)
    gone = found.filter("not kept").select(F.col("id").alias("__gone")).distinct()
    gone = store.table(gone, "gone", owner)
    told = _maybe(docs, "doc_id", gone.select(F.col("__gone").alias("id")))
    # only rows that may be gone are moved; all others stay where they are
    asked = told.filter("__may").drop("__may")
    left = told.filter("not __may").drop("__may").union(asked.join(gone, asked["doc_id"] == gone["__gone"], "left_anti"))
    again = found.filter("kept and id is not null and n_shingles > 0").groupBy(F.col("id").alias("__again")).agg(F.count("*").alias("__n")).filter("__n > 1").select("__again")
    if again.isEmpty():
        return left
    once = left.join(again, left["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, left["doc_id"] == again["__again"], "left_anti").unionByName(once)
