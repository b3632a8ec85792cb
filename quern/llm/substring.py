"""Removal of passages that occur more than once, by level-wise doubling.

A window of ``n`` words that occurs twice has all its sub-windows twice.  :func:`levels` gives lengths that double from
a short one up to ``n``.  At each level a candidate window of ``n`` words stands on its *anchor*, the sub-window of that
length with the least hash, which every copy of the window picks at the same place (about one anchor in half the
difference of the lengths, so a level counts few rows).  A window whose anchor occurs once is finished; one whose anchor
is repeated is extended to twice that length and counted again, until ``n`` words decide or no candidate survives (the
levels after that one then read empty tables, which adaptive execution drops).  All windows are candidates at first.

Hot passages: a task keeps one row of each key for the count over all tasks and settles its other rows of that key
itself, under a key of their own, so a group has at most one row per task and flush, however many documents share the
passage.  Texts meet their surviving anchors by a join on a hash of the text: all levels read one exchange of the
texts.  Of rows that repeat a text, a task extends one (all their windows are repeated, and known to be so from a key
of the whole text).  Rows too short for a window are dealt by their own hash, so blank texts share no key.

Null or blank text has no words and stays as it is; texts under ``n`` words are never cut; repeated rows are all cut
alike (each one's windows start in the others); an empty table gives an empty result.  Other columns are carried along
untouched.  A long text is read in parts; what grows with it are the hashes of its candidate windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import column, signed, text_slices, tidied, word_parts
from quern.llm.hashing import U, Words, mix, sliding

#: Rows that a task gathers before it settles and sends them.
FLUSH = 1 << 20
#: Texts over so many bytes are read in parts of as many characters.
LONG_TEXT = 4 << 20
#: The first level has at least so many words.
START = 8


def levels(n: int) -> list[int]:
    """Window lengths that double, the last one cut to ``n``."""
    out = [n]
    while out[0] > 1 and -(-out[0] // 2) >= START:
        out.insert(0, -(-out[0] // 2))
    return out


def _least(w: Words, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``length`` words; for each window of n words its anchor, the least of them (0 where it leaves its text)."""
    small, whole = w.windows(length), w.whole(n)
    return small, np.where(whole, sliding(small, n - length + 1)[: len(whole)], U(0)) if len(whole) else np.zeros(0, U)


def _anchors_at(small: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """The places of the windows that are the anchor of a window of n words around them; ``least`` is 0 for those that are no candidates."""
    padded = np.concatenate([np.zeros(span - 1, U), least, np.zeros(span - 1, U)])
    # no window around a place has a greater anchor than the place's own hash
    most = sliding(padded, span, np.maximum)[: len(small)]
    return np.flatnonzero((most == small) & (most > 0))


def _combine(keys: list[np.ndarray], weight: np.ndarray, salt: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Map-side combine: of equal keys the first row stays, with all their weight (2 is enough); the others, of which it is now known that they are repeated, get keys of their own."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    at = np.flatnonzero(new)
    total = np.minimum(np.add.reduceat(weight[order], at), 2) if len(at) else weight[:0]
    weight = np.full(len(order), 2, np.int8)
    weight[order[at]] = total
    own = np.ones(len(order), bool)
    own[order[at]] = False
    keys = [k.copy() for k in keys]
    keys[0][own] = mix(salt[own])
    for k in keys[1:]:
        k[own] = 0
    return keys, weight


def _mark(key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """The key that stands for a whole text."""
    return mix(key.view(U) ^ (tag.astype(np.int64).view(U) << U(17)) ^ U(0x5851F42D4C957F2D))


def _candidates(w: Words, n: int, before: int, marks: np.ndarray, lists: pa.Array, seen: dict[int, tuple], row: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The windows of n words whose anchor of ``before`` words is repeated, and the texts that another row has too (taken whole, once per task, from the row that ``seen`` has for them); ``row`` names the first row."""
    _, least = _least(w, n, before)
    take, twice = np.zeros(len(least), bool), np.zeros(len(w.count), bool)
    for i in range(len(w.count)):
        s, e = w.first[i], min(w.first[i + 1] - n + 1, len(least))
        if e <= s:
            continue
        found = lists[i].values.to_numpy(zero_copy_only=False).view(U)
        if (found == marks[i]).any():
            if seen.setdefault(int(marks[i]), (*row, i)) == (*row, i):
                take[s:e], twice[i] = True, True
        else:
            found = np.sort(found)
            take[s:e] = found[np.minimum(np.searchsorted(found, least[s:e]), len(found) - 1)] == least[s:e]
    return take, twice


def _pieces(texts: pa.Array, n: int) -> Iterator[tuple[int, int, Words, int]]:
    """(row from, row to, words, place of the first word): slices of rows, and a long text in parts that share n - 1 words."""
    for lo, hi in text_slices(texts):
        if hi - lo == 1 and (pc.binary_length(texts[lo]).as_py() or 0) > LONG_TEXT:
            words = 0
            for before, part in word_parts(texts[lo].as_py(), LONG_TEXT, n - 1):
                w = Words(pa.array([before + part]))
                shared = int(Words(pa.array([before])).count[0])
                yield lo, hi, w, words - shared
                words += int(w.count[0]) - shared
        else:
            yield lo, hi, Words(texts.slice(lo, hi - lo)), 0


def _texts(batch: pa.RecordBatch, text: str) -> pa.Array:
    return column(batch, "text") if "text" in batch.schema.names else pc.fill_null(pc.struct_field(column(batch, "doc"), text), "")


def _level(text: str, n: int, before: int | None, length: int):
    """One level: (g, v, key, weight) of the anchors v of all candidates; at the first one (no ``before``) all windows are candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: dict[int, tuple] = {}

        def flush():
            v, key, weight, salt = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            (group,), weight = _combine([v], weight, salt)
            return pa.RecordBatch.from_arrays([pa.array(signed(group)), pa.array(signed(v)), pa.array(key), pa.array(weight)], ["g", "v", "key", "weight"])

        for no, batch in enumerate(batches):
            texts, keys = _texts(batch, text), column(batch, "key").to_numpy()
            marks = _mark(keys, column(batch, "tag").to_numpy())
            for lo, hi, w, place in _pieces(texts, n):
                small, least = _least(w, n, length)
                twice = np.zeros(hi - lo, bool)
                if before:
                    take, twice = _candidates(w, n, before, marks[lo:hi], column(batch, "anchors").slice(lo, hi - lo), seen, (no, lo))
                    least = np.where(take, least, U(0))
                at = _anchors_at(small, least, n - length + 1)
                doc = np.searchsorted(w.first, at, "right") - 1
                whole = np.flatnonzero((twice if before else w.count >= n) & (place == 0))
                v = np.concatenate([small[at], marks[lo:hi][whole]])
                key = keys[lo:hi][np.concatenate([doc, whole])]
                salt = mix(key.view(U) ^ (np.arange(len(key), dtype=U) << U(20)) ^ U(no * 1_000_003 + lo) ^ (U(place) << U(42)))
                held.append((v, key, np.where(twice, 2, 1).astype(np.int8)[np.concatenate([doc, whole])], salt))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return run


def _decide(text: str, n: int, before: int):
    """The last level: (a, b, key, tag, start, weight) of every candidate window, by 97 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: dict[int, tuple] = {}

        def flush():
            a, b, key, tag, start, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            salt = mix(key.view(U) ^ (start.astype(U) << U(24)) ^ (tag.astype(np.int64).view(U) << U(40)))
            (a, b), weight = _combine([a, b], weight, salt)
            return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array((b >> U(33)).astype(np.int32)), pa.array(key), pa.array(tag), pa.array(start), pa.array(weight)], ["a", "b", "key", "tag", "start", "weight"])

        for no, batch in enumerate(batches):
            texts, keys, tags = _texts(batch, text), column(batch, "key").to_numpy(), column(batch, "tag").to_numpy()
            marks = _mark(keys, tags)
            for lo, hi, w, place in _pieces(texts, n):
                take, twice = _candidates(w, n, before, marks[lo:hi], column(batch, "anchors").slice(lo, hi - lo), seen, (no, lo))
                at = np.flatnonzero(take)
                if not len(at):
                    continue
                a, b = w.windows(n), w.windows(n, 1)
                doc = np.searchsorted(w.first, at, "right") - 1
                held.append((a[at], b[at], keys[lo:hi][doc], tags[lo:hi][doc], (at - w.first[doc] + place).astype(np.int32), np.where(twice, 2, 1).astype(np.int8)[doc]))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


def find(docs: DataFrame, text: str = "text", n: int = 35) -> DataFrame:
    """Every row of ``docs`` as (doc: the whole row, tag: int, starts: list of (tag, start) or null).

    ``starts`` has the word positions at which a repeated window of n words starts; only entries with the row's own
    tag belong to its text (the join is on 64 bits of its hash, the tag has 32 more).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    plain = [F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    short = F.octet_length(body) < 2 * n - 1
    keyed = docs.select(
        F.struct("*").alias("doc"),
        F.when(short, F.xxhash64(*plain, F.lit(1))).otherwise(F.xxhash64(body)).alias("key"),
        F.pmod(F.xxhash64(F.lit(7), body), F.lit((1 << 31) - 1)).cast("int").alias("tag"),
    )
    rows, before, kind = keyed.select("key", "tag", F.coalesce(F.col(f"doc.{text}"), F.lit("")).alias("text")), None, "g long, v long, key long, weight byte"
    *lower, last = levels(n) if len(levels(n)) > 1 else (n, n)
    for length in lower:
        counted = rows.mapInArrow(tidied(_level(text, n, before, length)), kind)
        repeated = counted.withColumn("n", F.sum("weight").over(Window.partitionBy("g"))).filter("n >= 2")
        lists = repeated.groupBy("key").agg(F.collect_set("v").alias("anchors"))
        rows, before = keyed.join(lists, "key").select("key", "tag", "doc", "anchors"), length  # the whole row, so that all joins read one exchange
    found = rows.mapInArrow(tidied(_decide(text, n, before)), "a long, b int, key long, tag int, start int, weight byte")
    sure = found.withColumn("n", F.sum("weight").over(Window.partitionBy("a", "b"))).filter("n >= 2")
    starts = sure.groupBy("key").agg(F.collect_list(F.struct("tag", "start")).alias("starts"))
    return keyed.join(starts, "key", "left").select("doc", "tag", "starts")


def _covered(w: Words, tags: np.ndarray, starts: pa.Array, n: int, place: int = 0) -> np.ndarray:
    """Which words lie in a repeated window; ``place`` is that of the first word in its text, where it is a part of one."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    for i in range(len(w.count)):
        if starts[i].is_valid:
            pairs = starts[i].values
            at = np.unique(pairs.field(1).to_numpy()[pairs.field(0).to_numpy() == tags[i]]).astype(np.int64) - place
            at = at[(at > -n) & (at < w.count[i])]
            np.add.at(edge, np.maximum(at, 0) + w.first[i], 1)
            np.subtract.at(edge, np.minimum(at + n, w.count[i]) + w.first[i], 1)
    return np.cumsum(edge)[:-1] > 0


def _alone(texts: pa.Array, lo: int, hi: int) -> Iterator[tuple[Words, int]]:
    """The words of a slice of rows; of a long text part after part, with the place of the first word."""
    if hi - lo == 1 and (pc.binary_length(texts[lo]).as_py() or 0) > LONG_TEXT:
        place = 0
        for _, part in word_parts(texts[lo].as_py(), LONG_TEXT):
            w = Words(pa.array([part]))
            yield w, place
            place += int(w.count[0])
    else:
        yield Words(texts.slice(lo, hi - lo)), 0


def digest(found: DataFrame, text: str, ident: str, n: int) -> DataFrame:
    """(ident, n_words, n_removed, kept_sha256) of each row that :func:`find` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tags, starts = column(batch, "text"), column(batch, "tag").to_numpy(), column(batch, "starts")
            for lo, hi in text_slices(texts):
                words, removed = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                sha, kept = [hashlib.sha256() for _ in range(hi - lo)], [False] * (hi - lo)
                for w, place in _alone(texts, lo, hi):
                    gone = _covered(w, tags[lo:hi], starts.slice(lo, hi - lo), n, place)
                    words += w.count
                    raw = w.raw.tobytes()
                    for i in range(hi - lo):
                        s, e = w.first[i], w.first[i + 1]
                        lost = int(gone[s:e].sum())
                        removed[i] += lost
                        if lost:
                            left = np.flatnonzero(~gone[s:e]) + s
                            body = b" ".join(raw[a:b] for a, b in zip(w.start[left].tolist(), w.end[left].tolist(), strict=True))
                        else:
                            body = b" ".join(x for x in raw[w.offsets[i] : w.offsets[i + 1]].translate(_SPACED).split(b" ") if x)
                        if body:
                            sha[i].update(b" " + body if kept[i] else body)
                            kept[i] = True
                yield pa.RecordBatch.from_arrays([column(batch, "ident").slice(lo, hi - lo), pa.array(words), pa.array(removed), pa.array([x.hexdigest() for x in sha], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    inner = found.select(F.col(f"doc.{ident}").alias("ident"), F.coalesce(F.col(f"doc.{text}"), F.lit("")).alias("text"), "tag", "starts")
    return inner.mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


_SPACED = bytes(0x20 if c in (0x20, *range(0x09, 0x0E)) else c for c in range(256))


def cut(found: DataFrame, columns: list[str], text: str, n: int) -> DataFrame:
    """The rows with the repeated words, and the white space before each, taken out of the text; other columns and uncut texts unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tags, starts = column(batch, "text"), column(batch, "tag").to_numpy(), column(batch, "starts")
            out: list[str | None] = []
            for lo, hi in text_slices(texts):
                left: list[list[bytes]] = [[] for _ in range(hi - lo)]
                touched = np.zeros(hi - lo, bool)
                for w, place in _alone(texts, lo, hi):
                    gone = _covered(w, tags[lo:hi], starts.slice(lo, hi - lo), n, place)
                    for i in range(hi - lo):
                        s, e = w.first[i], w.first[i + 1]
                        body = w.raw[w.offsets[i] : w.offsets[i + 1]]
                        if gone[s:e].any():
                            touched[i] = True
                            edge = np.zeros(len(body) + 1, np.int32)
                            at = np.flatnonzero(gone[s:e]) + s
                            first = w.start[at] if not place else np.full(len(at), w.offsets[i])  # white space that a part begins with follows a word
                            begin = np.where(at > s, w.end[np.maximum(at - 1, 0)], first)
                            np.add.at(edge, begin - w.offsets[i], 1)
                            np.subtract.at(edge, w.end[at] - w.offsets[i], 1)
                            body = body[np.cumsum(edge)[:-1] == 0]
                        left[i].append(body.tobytes())
                out += [b"".join(parts).decode() if hit else texts[lo + i].as_py() for i, (parts, hit) in enumerate(zip(left, touched.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array(out, pa.string())], ["doc", "cut"])

    inner = found.select("doc", F.col(f"doc.{text}").alias("text"), "tag", "starts")
    done = inner.mapInArrow(tidied(run), _schema(found))
    return done.select(*[F.col("cut").alias(c) if c == text else F.col("doc")[c].alias(c) for c in columns])


def _schema(found: DataFrame):
    return T.StructType([found.schema["doc"], T.StructField("cut", T.StringType())])


def remove_repeats(docs: DataFrame, text: str = "text", n: int = 35) -> DataFrame:
    """``docs`` without the words that lie in a window of ``n`` words which occurs anywhere else."""
    return cut(find(docs, text, n), docs.columns, text, n)
