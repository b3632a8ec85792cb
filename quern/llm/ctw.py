"""Context-tree weighting over bytes, trained on one part of a corpus and scoring all of it.

Texts are their lower-cased (A-Z) UTF-8 bytes and one end byte, 0xFF.  Each byte is eight binary decisions; each
decision has a context tree over the ``DEPTH`` bytes before it.  A node holds how often 0 and 1 followed; its
Krichevsky-Trofimov estimate P_e and the product of its children's weighted probabilities mix evenly:
P_w = (P_e + prod P_w) / 2.  The probability of the next bit mixes the estimates along the path from the root,
each with the share that P_w gives its depth.

How it is spread:

* Rows are dealt into chunks by their place in their file, which no way of splitting files changes; input that is no
  plain Parquet scan is written once first.  A chunk gives its distinct (DEPTH + 1)-grams of bytes, and its distinct
  words for the baseline, with their counts in training texts (0 for the others), which are summed over all chunks:
  the whole tree follows from the grams, and one that training never saw is a leaf of count zero like any other.  A
  key has at most one row per chunk and flush, however frequent it is: there are as many rows of it as chunks, which is
  far fewer than a partition has, so no key is hot.
* Sub-trees that share their three nearest context bytes (``SPLIT``) are computed one after another in the partition
  they fall to, some ``TREE`` grams at a time, so a task holds one sub-tree more than that.  A sub-tree has the
  distinct grams of one three-byte context, however often they occur.  The tree above them is three aggregations by
  the nearer context (:func:`_above`), each spread by its nodes, and each level's way down is a join with the level
  above it, of which the two nearest have at most 2 ** 8 and 2 ** 16 nodes and are broadcast.
* The log-probability of each gram, and the count of each word, goes back to the chunks in which it occurs, and each
  chunk is scored against its own.  So nothing is broadcast, and what moves is the texts once, and distinct keys per
  chunk.  Words are told apart by 64 bits of hash.

Null text is an empty text (one end byte); rows are scored one by one whatever their ids; a hot source has no part in
any key; with no training text at all every bit has probability 1/2.  Repeated rows are counted and scored as often as
they come.  A long text is read in blocks, beside which a few bytes for each of its bytes are held.  Carried columns
may have any names but those of the results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import store
from quern.llm.arrow import column, text_slices, tidied, word_parts
from quern.llm.hashing import _LOWER, U, Words, bytes_of

DEPTH = 5
END = 0xFF
#: Nearest context bytes that the grams of one sub-tree share.
SPLIT = 3
#: Grams whose sub-trees are computed at once.
TREE = 1 << 18
#: Bytes of input to a chunk.
CHUNK_BYTES = 16 << 20
#: Distinct keys that a task gathers for a chunk before it sends them.
HELD = 3 << 20
SLICE = 1 << 20
#: Texts over so many bytes are read in blocks of as many.
LONG_TEXT = 4 << 20
LN2 = np.log(2.0)


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the (DEPTH + 1)-grams that end at each byte (context before it, zeros before the text's start), and len(texts) + 1 offsets.

    There is one block, but for a single long text, whose bytes come in several.
    """
    raw, offsets = bytes_of(texts)
    n = len(offsets) - 1
    place = offsets + np.arange(n + 1)
    full = np.full(len(raw) + n, END, np.uint8)
    if n == 1:
        full[:-1] = _LOWER[raw]
        for at in range(0, len(full), LONG_TEXT):
            end = min(at + LONG_TEXT, len(full))
            yield _grams(full[max(0, at - DEPTH) : end], np.arange(at, end) - at + min(at, DEPTH), np.arange(at, end)), np.array([0, end - at])
        return
    inside = np.ones(len(full), bool)
    inside[place[1:] - 1] = False
    full[inside] = _LOWER[raw]
    yield _grams(full, np.arange(len(full)), np.arange(len(full)) - np.repeat(place[:-1], np.diff(place))), place


def _grams(full: np.ndarray, at: np.ndarray, since: np.ndarray) -> np.ndarray:
    """The grams that end at places ``at`` of ``full``, which lie ``since`` bytes after their text's start."""
    out = full[at].astype(U)
    for back in range(1, DEPTH + 1):
        before = full[np.maximum(at - back, 0)].astype(U)
        before[since < back] = 0
        out |= before << U(8 * back)
    return out


def _words(texts: pa.Array) -> Iterator[Words]:
    """The words of a slice; those of a single long text in several parts."""
    if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > LONG_TEXT:
        for _, part in word_parts(texts[0].as_py(), LONG_TEXT):
            yield Words(pa.array([part]), lower=True)
    else:
        yield Words(texts, lower=True)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log(Gamma(n + 1/2) / Gamma(1/2)) by recurrence up to 8 and Stirling's series."""
    x = n + 0.5
    low = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        low[small] -= np.log(x[small])
        x[small] += 1
    return low + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 0.5 * np.log(np.pi)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    low = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        low[small] -= np.log(x[small])
        x[small] += 1
    return low + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT block probability of a zeros and b ones."""
    return _log_gamma_half(a.astype(float)) + _log_gamma_half(b.astype(float)) - _log_factorial((a + b).astype(float))


class Level:
    """The nodes at one depth: key = context bytes << 8 | bit prefix (1 .. 255), counts, and the children's summed log P_w (none at the last depth)."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.key, self.zeros, self.ones = key, zeros, ones
        kt = log_kt(zeros, ones)
        self.log_w = kt if below is None else np.logaddexp(kt, below) - LN2
        self.p = (ones + 0.5) / (zeros + ones + 1.0)
        self.share = np.ones(len(key)) if below is None else np.exp(kt - LN2 - self.log_w)

    def parents(self, depth: int) -> Level:
        """The nodes one byte of context nearer; ``depth`` is this level's."""
        keep = U((1 << 8 * (depth - 1)) - 1)
        key = (self.key >> U(8) & keep) << U(8) | self.key & U(255)
        unique, where = np.unique(key, return_inverse=True)
        total = lambda x: np.bincount(where, x, len(unique))
        return Level(unique, total(self.zeros), total(self.ones), total(self.log_w))


def leaves(gram: np.ndarray, count: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest nodes, and for each gram and bit the node's row (grams x 8) and the bit."""
    byte, context = gram & U(255), gram >> U(8)
    keys, bits = np.empty((len(gram), 8), U), np.empty((len(gram), 8), bool)
    for k in range(8):
        keys[:, k] = context << U(8) | (byte | U(256)) >> U(8 - k)
        bits[:, k] = byte >> U(7 - k) & U(1)
    unique, where = np.unique(keys.ravel(), return_inverse=True)
    weight = np.repeat(count.astype(float), 8)
    ones = np.bincount(where, weight * bits.ravel(), len(unique))
    return Level(unique, np.bincount(where, weight, len(unique)) - ones, ones, None), where.reshape(-1, 8), bits


def _subtree(gram: np.ndarray, count: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels DEPTH down to SPLIT of whole sub-trees."""
    level, where, bits = leaves(gram, count)
    out = [level]
    for depth in range(DEPTH, SPLIT, -1):
        out.append(out[-1].parents(depth))
    return out, where, bits


def _whole(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[pa.Array]]:
    """The columns ``names`` of rows that are sorted by ``near``, about TREE rows at a time, cut where ``near`` changes."""
    held: list[pa.RecordBatch] = []
    rows, due = 0, TREE
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < due:
            continue
        table = pa.Table.from_batches(held)
        near = table.column("near").to_numpy()
        cut = int(np.searchsorted(near, near[-1]))  # the last sub-tree may go on
        if cut:
            yield [table.column(c).slice(0, cut).combine_chunks() for c in names]
            held, rows = table.slice(cut).combine_chunks().to_batches(), rows - cut
        due = max(TREE, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held)
        yield [table.column(c).combine_chunks() for c in names]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes at depth SPLIT of the sub-trees in this partition."""
    for gram, n in _whole(batches, ("gram", "n")):
        level = _subtree(gram.to_numpy().view(U), n.to_numpy())[0][-1]
        yield pa.RecordBatch.from_arrays([pa.array(level.key.view(np.int64)), pa.array(level.zeros), pa.array(level.ones), pa.array(level.log_w)], ["node", "zeros", "ones", "log_w"])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one level with their weights, from the sums over their children."""
    for b in batches:
        node, zeros, ones, below = (column(b, c).to_numpy() for c in ("node", "zeros", "ones", "log_w"))
        level = Level(node, zeros, ones, below)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, zeros, ones, level.log_w, level.p, level.share)], ["node", "zeros", "ones", "log_w", "p", "share"])


_NODE = "node long, zeros double, ones double, log_w double"


def _nearer(depth: int):
    """The node one byte nearer, as an expression over ``node`` at ``depth``."""
    return F.expr(f"((node >> 8) & {(1 << 8 * (depth - 1)) - 1}L) << 8 | (node & 255L)")


def _above(level: DataFrame, depth: int) -> DataFrame:
    """The level above ``level``, which lies at ``depth``."""
    summed = level.groupBy(_nearer(depth).alias("node")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")])
    return summed.mapInArrow(tidied(_mixed), _NODE + ", p double, share double")


def _down(level: DataFrame, depth: int, above: DataFrame | None) -> DataFrame:
    """(node, mixed, left): the sum of the estimates above a node's children, and the share that is left for them; the level's own node included."""
    if above is None:
        return level.select("node", (F.col("share") * F.col("p")).alias("mixed"), (1 - F.col("share")).alias("left"))
    met = level.withColumn("up", _nearer(depth)).join(above.select(F.col("node").alias("up"), "mixed", "left"), "up")
    return met.select("node", (F.col("mixed") + F.col("left") * F.col("share") * F.col("p")).alias("mixed"), (F.col("left") * (1 - F.col("share"))).alias("left"))


def _top(roots: DataFrame, owner: str) -> DataFrame:
    """(near, node, mixed, left): for each node at depth SPLIT, what all depths above it give."""
    levels = {SPLIT: roots}
    for depth in range(SPLIT, 0, -1):
        levels[depth - 1] = store.table(_above(levels[depth], depth), f"depth{depth - 1}", owner)
    down = None
    for depth in range(SPLIT):
        down = _down(levels[depth], depth, down)
        if depth < 2:  # at most 2 ** 8 and 2 ** 16 nodes
            down = F.broadcast(down)
    met = roots.select("node", _nearer(SPLIT).alias("up")).join(down.withColumnRenamed("node", "up"), "up")
    return met.select(F.shiftright("node", 8).alias("near"), "node", "mixed", "left")


def _gram_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 probability of each gram's last byte; rows are grams (gram, n) and nodes at depth SPLIT (node, mixed, left) of whole sub-trees."""
    for rows in _whole(batches, ("gram", "n", "node", "mixed", "left")):
        is_gram = pc.is_valid(rows[0])
        gram, n = (x.filter(is_gram).to_numpy() for x in rows[:2])
        node, mixed, left = (x.filter(pc.invert(is_gram)).to_numpy() for x in rows[2:])
        levels, where, bits = _subtree(gram.view(U), n)
        order = np.argsort(node, kind="stable")
        mixed, left = mixed[order], left[order]  # in the order of levels[-1].key
        for depth in range(SPLIT, DEPTH):  # towards the leaves
            here, below = levels[DEPTH - depth], levels[DEPTH - depth - 1]
            keep = U((1 << 8 * depth) - 1)
            at = np.searchsorted(here.key, (below.key >> U(8) & keep) << U(8) | below.key & U(255))
            mixed, left = (mixed + left * here.share * here.p)[at], (left * (1 - here.share))[at]
        # an estimate is no nearer to 0 or 1 than 1e-12, as it is only after some 10**12 like bits
        one = np.clip(mixed + left * levels[0].p, 1e-12, 1 - 1e-12)[where]
        score = np.log10(np.where(bits, one, 1 - one)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(score)], ["gram", "score"])


GRAM, WORD, TEXT = 0, 1, 2


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x))).astype(np.int32)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, kind, key, n): distinct grams, words and the texts themselves, with their counts in training rows."""
    held: dict[int, dict[int, list[tuple[np.ndarray, np.ndarray]]]] = {}
    texts_seen = 0

    def settle(chunk: int) -> Iterator[pa.RecordBatch]:
        for kind, parts in held.pop(chunk).items():
            key, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk, np.int64)), pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["chunk", "kind", "key", "n"])

    for batch in batches:
        texts, chunks, train = column(batch, "text"), column(batch, "chunk").to_numpy(), column(batch, "train").to_numpy(zero_copy_only=False)
        for lo, hi in text_slices(texts, SLICE):
            part, ids, learn = texts.slice(lo, hi - lo), chunks[lo:hi], train[lo:hi]
            texts_seen += int(learn.sum())
            found = itertools.chain(((GRAM, x, np.diff(place)) for x, place in grams(part)), ((WORD, w.hash, w.count) for w in _words(part)))
            for kind, keys, size in found:
                for chunk in np.unique(ids).tolist():
                    own = held.setdefault(chunk, {})
                    mine = ids == chunk
                    for rows, counts in ((mine & learn, True), (mine & ~learn, False)):
                        key, n = _counted(keys[np.repeat(rows, size)])
                        own.setdefault(kind, []).append((key, n if counts else np.zeros(len(n), np.int32)))
                    if sum(len(k) for parts in own.values() for k, _ in parts) > HELD:
                        for each, parts in own.items():
                            own[each] = [_merged(parts)]
                        if sum(len(parts[0][0]) for parts in own.values()) > HELD // 4 * 3:
                            yield from settle(chunk)
    for chunk in list(held):
        yield from settle(chunk)
    if texts_seen:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([TEXT], pa.int8()), pa.array([0]), pa.array([texts_seen])], ["chunk", "kind", "key", "n"])


class _Lookup:
    """Values by 64-bit key: places in the sorted keys, addressed by the key's hash; keys that share an address are looked up in the sorted list."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        del order
        self.bits = max(10, len(key).bit_length() + 1)
        own, place = self._address(self.key), np.arange(len(key), dtype=np.int32)
        self.place = np.zeros(1 << self.bits, np.int32)
        self.place[own] = place
        self.shared = np.zeros(1 << self.bits, bool)
        self.shared[own[self.place[own] != place]] = True

    def _address(self, key: np.ndarray) -> np.ndarray:
        return (key * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)

    def __call__(self, key: np.ndarray, other: float) -> np.ndarray:
        """The values of ``key``, ``other`` where it has none."""
        if not len(self.key):
            return np.full(len(key), other)
        at = self._address(key)
        place = self.place[at]
        lost = np.flatnonzero(self.shared[at])
        place[lost] = np.minimum(np.searchsorted(self.key, key[lost]), len(self.key) - 1)
        return np.where(self.key[place] == key, self.value[place], other)


def _score_chunk(total: int, distinct: int, train_texts: int):
    """Scores of the rows of one chunk against the chunk's grams and words."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        kind, key, value = (table.column(c).to_numpy() for c in ("kind", "key", "value"))
        key = key.view(U)
        texts = docs.column("text").combine_chunks()
        scores: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        out: list[tuple] = []
        norm = np.log10(float(total + distinct + 1))
        look = _Lookup(key[kind == GRAM], value[kind == GRAM])
        for lo, hi in text_slices(texts, SLICE):
            score, size = np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
            for x, place in grams(texts.slice(lo, hi - lo)):
                logs = look(x, np.nan)
                if np.isnan(logs).any():
                    raise ValueError("a gram has no score: the chunk's rows are not those that were counted")
                sums = np.concatenate([[0], np.cumsum(logs)])
                score += sums[place[1:]] - sums[place[:-1]]
                size += np.diff(place)
            scores.append(score)
            sizes.append(size)
        look = _Lookup(key[kind == WORD], value[kind == WORD])
        del kind, key, value
        for lo, hi in text_slices(texts, SLICE):
            words, known, base = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
            for w in _words(texts.slice(lo, hi - lo)):
                c = look(w.hash, 1.0)
                sums = np.concatenate([[0], np.cumsum(np.log10(c + 1) - norm)])
                seen = np.concatenate([[0], np.cumsum(c > 0)])
                words += w.count
                known += seen[w.first[1:]] - seen[w.first[:-1]]
                base += sums[w.first[1:]] - sums[w.first[:-1]]
            out.append((words + 1, known + (train_texts > 0), base + np.log10(train_texts + 1) - norm))
        cols = [*(np.concatenate(x) for x in zip(*out, strict=True)), np.concatenate(scores), np.concatenate(sizes)] if out else [np.zeros(0)] * 5
        cols = [*cols, cols[3] / -np.log10(2) / np.maximum(cols[4], 1), np.full(len(docs), total)]
        docs = docs.select(["kept"])
        for (name, kind), x in zip(_RESULT.items(), cols, strict=True):
            docs = docs.append_column(name, pa.array(x).cast(kind))
        return docs

    return run


#: What :func:`score` gives; bits are code length per byte of the text and its end byte.
_RESULT = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(), "bits_per_byte": pa.float64(), "train_tokens": pa.int64()}


def score(docs: DataFrame, train, text: str = "text", carry: tuple[str, ...] = (), scanned: bool = False, owner: str = "") -> DataFrame:
    """``carry`` columns, n_tokens, n_known, base_score, score (log10 probability), n_bytes, bits_per_byte and train_tokens of every row.

    ``bits_per_byte`` is the code length per byte; the end byte counts as one.
    ``train`` is the condition on training rows.  ``scanned`` says that ``docs`` is a plain scan of Parquet files, whose
    rows keep their places; anything else is written into the shared folder first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.struct(*([F.col(c) for c in carry] or [F.lit(0)])).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    if not scanned:
        docs = store.table(docs, "texts", owner)
    size = docs.agg(F.count("*"), F.sum(F.octet_length("text")), F.max(F.col("_metadata.row_index")) + 1).first()
    n_rows, n_bytes, longest = (x or 1 for x in size)
    # as many equal runs as the longest file has chunks, so that runs and row groups of even files end together
    rows_each = -(-longest // max(1, round(longest * n_bytes / n_rows / CHUNK_BYTES)))
    chunked = docs.withColumn("chunk", F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / rows_each)))
    counts = chunked.select("chunk", "text", "train").mapInArrow(tidied(_count), "chunk long, kind byte, key long, n long")
    over = Window.partitionBy("kind", "key")
    summed = counts.withColumn("c", F.sum("n").over(over)).withColumn("first", F.row_number().over(over.orderBy("chunk")) == 1)
    summed = store.table(summed.select("chunk", "kind", "key", "c", "first"), "counts", owner)
    only = lambda kind, x: F.coalesce(F.sum(F.when((F.col("kind") == kind) & F.col("first"), x)), F.lit(0)).cast("long")
    words, distinct, texts = summed.agg(only(WORD, F.col("c")), only(WORD, (F.col("c") > 0).cast("int")), only(TEXT, F.col("c"))).first()

    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SPLIT) - 1).cast("long")).alias("near")
    total = store.table(summed.filter((F.col("kind") == GRAM) & F.col("first")).select(near, F.col("key").alias("gram"), F.col("c").alias("n")), "tree", owner)
    trees = lambda rows: rows.repartition("near").sortWithinPartitions("near")
    roots = store.table(trees(total).select("near", "gram", "n").mapInArrow(tidied(_roots), _NODE), "roots", owner)
    none = lambda kind: F.lit(None).cast(kind)
    both = total.select("near", "gram", "n", none("long").alias("node"), none("double").alias("mixed"), none("double").alias("left"))
    both = both.union(_top(roots, owner).select("near", none("long"), none("long"), "node", "mixed", "left"))
    scores = store.table(trees(both).mapInArrow(tidied(_gram_scores), "gram long, score double"), "scores", owner)
    grams_back = summed.filter(F.col("kind") == GRAM).join(scores, summed["key"] == scores["gram"]).select("chunk", "kind", "key", F.col("score").alias("value"))
    # most words are seen once: they are what a chunk takes a word for that it gets no row of
    words_back = summed.filter((F.col("kind") == WORD) & (F.col("c") != 1)).select("chunk", "kind", "key", F.col("c").cast("double").alias("value"))
    back = grams_back.union(words_back)
    rows = chunked.select("chunk", "text", "kept")
    more = [T.StructField(k, T.LongType() if pa.types.is_integer(x) else T.DoubleType()) for k, x in _RESULT.items()]
    run = _score_chunk(words + texts, distinct + (texts > 0), texts)
    scored = rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, T.StructType([rows.schema["kept"], *more]))
    return scored.select(*[F.col("kept")[c].alias(c) for c in carry], *_RESULT)
