"""Exact merge-type piece encoding by backtracking, and decoding.

A merge-type (BPE) model joins the adjacent pair of highest score until nothing can be joined.  The same result comes
from left to right: take the longest piece that starts here (all are found at once by an Aho-Corasick automaton) and
accept it if the piece before and this one, joined and merged anew, come out as these two; else try its next shorter
prefix, else go back one piece.  Positions from which no encoding follows are kept in a bit field, so each is left for
good once.

A piece never has a space mark after another character, so a text is cut before each mark, and each distinct part of a
batch is encoded once (a bounded per-worker cache keeps them).  The run pieces of several marks share one score, for
which the pairwise rule does not hold; parts with two marks in a row are merged directly, highest score and leftmost
first.  A character without a piece stands alone and becomes its bytes' pieces.

Null text counts as empty and has no ids.  Rows are independent; empty tables give empty results.  A text over
``SLICE`` bytes is a batch of its own; one without any space is one part, walked in time and memory that grow with its
length (the bit field has one bit a character, and long parts leave the cache with their batch).  Of merges with equal
score the leftmost is made first.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import column, text_slices, tidied
from quern.llm.tokens import pieces

MARK = "▁"
#: Parts kept, and their characters; when they are more, those of the batch at hand stay.
CACHE, CACHE_CHARS = 700_000, 12 << 20
#: Parts over so many characters leave the cache with their batch.
LONG_PART = 256
#: New parts that are matched at once; their matches take some hundred bytes a part.
LEARNT = 20_000
#: Pairs of neighbours that are remembered.
FITS = 400_000
SLICE = 16 << 20
_CUT = re.compile(f"(?<!{MARK})(?={MARK})")


class Model:
    """A merge-type model with byte fallback, read from its file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("only merge-type models without normalisation are handled")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.byte = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
        self.text = {i: p for p, i in self.ids.items()}
        self.value = {i: b for b, i in enumerate(self.byte)}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, tuple[str, int, str | None]] = {}
        self.chars = 0
        self.automaton = ahocorasick.Automaton()
        own = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}  # a piece that merging never gives is never matched
        for p in own:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.size = {i: len(p) for p, i in own.items()}
        #: The next shorter prefix of a piece that is a piece; 0 where only a character without a piece is left.
        self.shorter = {i: next((own[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in own), 0 if len(p) > 1 else None) for p, i in own.items()}

    def merge(self, part: str) -> list[str]:
        """Direct merging: highest score first, leftmost of equals."""
        sym: list[str | None] = list(part)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score, queue = self.score, []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (s := score.get(whole := sym[a] + sym[b])) is not None:
                heapq.heappush(queue, (-s, a, b, whole))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, whole = heapq.heappop(queue)
            if sym[a] is None or sym[b] is None or right[a] != b or sym[a] + sym[b] != whole:
                continue
            sym[a], sym[b] = whole, None
            right[a] = right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in sym if x is not None]

    def fit(self, a: int, b: int) -> bool:
        """Do two neighbours, joined and merged anew, come out as these two?  (A character without a piece is minus its code.)"""
        if len(self.fits) > FITS:
            self.fits.clear()
        x, y = (self.text[i] if i > 0 else chr(-i) for i in (a, b))
        known = self.fits[a << 32 | b & 0xFFFFFFFF] = self.merge(x + y) == [x, y]
        return known

    def walk(self, part: str, longest: list[int], at: int) -> list[int]:
        """Backtracking over ``part``; ``longest`` has the longest match at each place from ``at``."""
        n, pos, failed = len(part), 0, None
        size, shorter, ids, fits = self.size, self.shorter, self.ids, self.fits
        out: list[int] = []
        last = 0
        k = longest[at]
        now = ids[part[:k]] if k else -ord(part[0])
        while True:
            end = pos + (size[now] if now > 0 else 1)
            good = not (failed and failed[end >> 3] >> (end & 7) & 1)
            if good and last:
                good = fits.get(last << 32 | now & 0xFFFFFFFF)
                if good is None:
                    good = self.fit(last, now)
            if good:
                out.append(now)
                if end == n:
                    return out
                last, pos = now, end
                k = longest[at + pos]
                now = ids[part[pos : pos + k]] if k else -ord(part[pos])
                continue
            now = shorter[now] if now > 0 else None
            while now is None:
                if not out:
                    raise ValueError("no encoding")
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                now = out.pop()
                pos -= size[now] if now > 0 else 1
                last = out[-1] if out else 0
                now = shorter[now] if now > 0 else None
            if not now:
                now = -ord(part[pos])

    def numbers(self, got: list[int]) -> list[int]:
        """Ids, with a character without a piece as its bytes."""
        if min(got) > 0:
            return got
        return [j for i in got for j in ([i] if i > 0 else [self.byte[b] for b in chr(-i).encode()])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with marks as spaces; the caller takes off the one that every text begins with."""
        if None not in (known := [self.text.get(i) for i in ids]):
            return "".join(known).replace(MARK, " ")
        out, held = [], bytearray()
        for i in ids:
            if (p := self.text.get(i)) is None:
                held.append(self.value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(p)
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def learn(self, parts: list[str]) -> None:
        for lo in range(0, len(parts), LEARNT):
            self._learn(parts[lo : lo + LEARNT])

    def _learn(self, parts: list[str]) -> None:
        joined = "\n".join(parts)
        found = np.fromiter(self.automaton.iter(joined), np.dtype([("end", np.int32), ("size", np.int32)]))
        first = np.zeros(len(joined) + 1, np.int32)
        first[found["end"] - found["size"] + 1] = found["size"]  # ends ascend, so the longest match at a place is written last
        del found
        longest = first.tolist()
        at = 0
        for part in parts:
            if MARK * 2 in part:
                got = [self.ids.get(x) or -ord(x) for x in self.merge(part)]
            else:
                got = self.walk(part, longest, at) if part else []
            ids = self.numbers(got) if got else got
            text = self.decode(ids)
            self.cache[part] = ",".join(map(str, ids)), len(ids), None if text == part.replace(MARK, " ") else text
            self.chars += len(part)
            at += len(part) + 1

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[tuple[str, int, str | None]], np.ndarray]:
        """(offsets per text, distinct parts, what is known of them, part numbers)."""
        full = pc.binary_join_element_wise(pa.scalar(MARK), pc.replace_substring(texts, " ", MARK), "")
        full = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", full)
        bounds, distinct, number = pieces(full, MARK, f"{MARK}{MARK}|\\x{{0}}", _CUT)
        distinct = distinct.to_pylist()
        if len(self.cache) + len(distinct) > CACHE or self.chars > CACHE_CHARS:
            self.cache = {x: self.cache[x] for x in distinct if x in self.cache}
            self.chars = sum(map(len, self.cache))
        if new := [x for x in distinct if x not in self.cache]:
            self.learn(new)
        got = [self.cache[x] for x in distinct]
        for x in new:
            if len(x) > LONG_PART:
                self.chars -= len(x)
                del self.cache[x]
        return bounds, distinct, got, number

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        bounds, _, got, number = self._split(texts)
        counts = np.array([x[1] for x in got], np.int64)[number] if len(number) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ends[bounds[1:]] - ends[bounds[:-1]]

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Per text: how many ids, the ids in decimal joined by commas, the decoded text."""
        bounds, distinct, got, number = self._split(texts)
        counts = np.array([x[1] for x in got], np.int64)[number] if len(number) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        full_parts = counts > 0  # the empty part before a first mark has no ids
        kept = pa.array(number[full_parts], pa.int64())
        offsets = pa.array(np.concatenate([[0], np.cumsum(full_parts)])[bounds].astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([x[0] for x in got], pa.string()).take(kept)), ",")
        decoded = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([x.replace(MARK, " ") if y[2] is None else y[2] for x, y in zip(distinct, got, strict=True)], pa.string()).take(kept)), "")
        return ends[bounds[1:]] - ends[bounds[:-1]], joined, pc.utf8_slice_codeunits(decoded, 1)

    def batch(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """:meth:`arrays` as lists."""
        counts, ids, decoded = self.arrays(texts)
        return counts.tolist(), ids.to_pylist(), decoded.to_pylist()


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _coded(docs: DataFrame, path: str, ident: str, text: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of ``docs``, with the ids in decimal, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for lo, hi in text_slices(texts, SLICE):
                n, ids, back = model(path).arrays(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), pa.array(n), ids, back], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids string, decoded string")


def encode(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of ``docs``; ``decoded`` is the text of the ids."""
    ids = F.when(F.col("n_tokens") == 0, F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return _coded(docs, path, ident, text).withColumn("ids", ids)


def decode(rows: DataFrame, path: str, ident: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) for every row of ``rows``: the text of its ids, which is empty for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model(path).decode(x or [])[1:] for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(ident).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(tidied(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``; ids count in decimal, joined by commas."""
    return _coded(docs, path, ident, text).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
