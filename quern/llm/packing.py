"""Cost-balanced packing of documents into training sequences.

Attention over a piece of n tokens costs about ``LINEAR * n + QUADRATIC * n * n``.  Within a window of some million
tokens, pieces go in descending length to the sequence of lowest cost so far that has room for them; where none has,
the piece is cut to fill the cheapest sequence with any room, and the rest goes on.  A window gives only full
sequences; the tokens left over (fewer than a sequence) move on to the task's next window.

Encoding and packing are one map over the rows, which gives the ids of every piece; nothing is shuffled, and memory is
bounded by the window.  What a task has left at its end is packed again together with what some ``FAN_IN`` other tasks
have left, and so on until one task is left, so the whole table has one short tail, however it is split: fewer tokens
than one sequence, in sequences of power-of-two length, so nothing is padded.

Null text counts as empty (one end token); a text of any length is cut; repeated rows and null ids are packed as they
come; of equal lengths the earlier row goes first, of equal costs the earlier sequence is taken; an empty table gives an
empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store, tokens
from quern.llm.arrow import column, text_slices, tidied

LENGTH = 2048
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
#: Tokens that are packed together.
WINDOW = 1 << 20
#: Sequences' worth of left-over tokens that one task of the next pass packs.
FAN_IN = 512


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], length: int = LENGTH, tail: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """(document, start, length, sequence, offset) of each piece, and (document, start, length) of what is left over.

    Sequences are full; with ``tail`` nothing is left over, and some sequences of power-of-two length follow.
    """
    full, rest = divmod(sum(lengths), length)
    short = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] if tail else []
    room = np.array([length] * full + short, np.int64)
    size = room.copy()
    spent = np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []
    queue = [(-n, d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    free = full  # full sequences that nothing has been put in yet come first
    while queue and -queue[0][0] >= length and free:
        n, d, start = heapq.heappop(queue)
        free -= 1
        out.append((d, start, length, free, 0))
        room[free], spent[free] = 0, cost(length)
        if -n > length:
            heapq.heappush(queue, (n + length, d, start + length))
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            fits = np.flatnonzero(room)
            if not len(fits):
                left.append((d, start, n))
                continue
        s = int(fits[np.argmin(spent[fits])])
        take = min(n, int(room[s]))
        out.append((d, start, take, s, int(size[s] - room[s])))
        room[s] -= take
        spent[s] += cost(take)
        if take < n:
            heapq.heappush(queue, (take - n, d, start + take))
    return out, left


#: A document's part that waits to be packed: its id, its place in the document, the document's tokens, its ids.
_Part = tuple[int | None, int, int, np.ndarray]
_ROW = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _windows(parts: Iterator[_Part], first: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of packed pieces, window by window, numbered from ``first``; a null sequence marks what is left at the end (nothing for the ``last`` task)."""
    held: list[_Part] = []

    def rows(placed: list[tuple], left: list[tuple], made: int) -> pa.RecordBatch:
        both = [(*x, first + made + s, at) for *x, s, at in placed] + [(*x, None, None) for x in left]
        out = [(held[d][0], held[d][1] + start, n, held[d][3][start : start + n].astype("<u4").tobytes(), held[d][2], s, at) for d, start, n, s, at in both]
        cols = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], [x.split()[0] for x in _ROW.split(", ")])

    made = waiting = 0
    for part in parts:
        held.append(part)
        waiting += len(part[3])
        if waiting >= WINDOW:
            placed, left = pack([len(x[3]) for x in held], LENGTH, False)
            yield rows(placed, [], made)
            made += waiting // LENGTH
            held[:] = [(held[d][0], held[d][1] + start, held[d][2], held[d][3][start : start + n]) for d, start, n in left]
            waiting %= LENGTH
    if held:
        yield rows(*pack([len(x[3]) for x in held], LENGTH, last), made)


def pieces(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", end: int = 1, owner: str = "") -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a tokenizer file; every document's ids end with ``end``.  The piece's ids are little-endian unsigned
    32-bit integers in a row, of which the checksum is taken.  The pieces are written into the shared folder, from
    which the left-over ones are read again.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
        for batch in batches:
            texts, names = column(batch, "text"), column(batch, "doc_id").to_pylist()
            for lo, hi in text_slices(texts, tokens.SLICE):
                ids, at = tokens.encoder(path).encode(texts.slice(lo, hi - lo))
                for i in range(hi - lo):
                    one = np.append(ids[at[i] : at[i + 1]], ids.dtype.type(end))
                    yield names[lo + i], 0, len(one), one

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
            yield from ((d, start, n, np.frombuffer(ids, "<u4")) for d, start, n, ids in zip(*cols, strict=True))

    def packed(read, level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _windows(read(batches), level << 58 | TaskContext.get().partitionId() << 32, last)

        return run

    named = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    done = store.table(named.mapInArrow(tidied(packed(encoded, 0, False), cached=True), _ROW), "pieces", owner)
    out, level = done.filter("sequence_id is not null"), 0
    while waiting := done.filter("sequence_id is null").agg(F.sum("length")).first()[0]:
        level, tasks = level + 1, -(-waiting // (FAN_IN * LENGTH))
        left = done.filter("sequence_id is null").repartition(tasks).mapInArrow(tidied(packed(again, level, tasks == 1)), _ROW)
        done = store.table(left, "pieces", owner)
        out = out.union(done.filter("sequence_id is not null"))
    return out.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
