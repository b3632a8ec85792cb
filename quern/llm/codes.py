"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

A vector's integer components floor(256 x) are cut into ``PARTS`` consecutive parts.  Each part position has a codebook of
``ENTRIES`` entries, which begins as that part of the first vectors by id and is trained by ``ROUNDS`` rounds of
assignment and rounded-down means.  The nearest entry is found through lower bounds of segment means, coarse to fine:

* In a block of n components with sums s and squared residuals r about the mean, two segments lie at least
  (s - s')**2 / n + (sqrt(r) - sqrt(r'))**2 apart.  One block is the whole part, then halves, down to two components.
* The entry of the least coarse bound gives an exact distance; entries whose bound exceeds it can't be nearest.  Each
  finer level filters those left, and survivors get exact integer distances.  Bounds are lowered by more than their
  rounding, so that none is lost.

Tasks send counts and sums per entry (:func:`_train`), which Spark adds up; only codebooks, 64 entries for all
dimensions, come to the driver and go out with the next round.  The input is read once for each round and twice more.

Vectors that are null, empty or hold null or non-finite components take no part, nor do those whose length is not that of
the first by id.  Where the length is no multiple of ``PARTS``, parts differ by one component.  Rows are ordered by id
(nulls last), then by their components; rows that repeat an id or a vector count as often as they are there.  Ties go to
the lower entry.  Components of any finite size are exact (Python's integers where 64 bits don't hold the squares);
errors over 2**63 - 1 are given as that.  With fewer than ``ENTRIES`` vectors the codebook has as many.  An
empty table gives an empty result.  Other columns but the label are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store
from quern.llm.arrow import column

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of vectors that are handled at once.
COMPONENTS = 1 << 18
#: Bits of a sum that travel in one row.
LIMB = 40
MOST = 2**63 - 1

Codebooks = list[np.ndarray]


def cuts(width: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    return [(i * width // PARTS, (i + 1) * width // PARTS) for i in range(PARTS)]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x), as int64 where squares of this many components fit, else as Python's integers."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() <= 2**29 / values.shape[-1]:
        return scaled.astype(np.int64)
    exact = [math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in values.astype(np.float64).ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def _levels(length: int) -> Iterator[list[tuple[int, int]]]:
    """Blocks of a part at each level: one, then twice as many, while they hold two components or more."""
    n = 1
    while n <= 1 or length // n >= 2:
        yield [(i * length // n, (i + 1) * length // n) for i in range(n)]
        n *= 2


def _shape(x: np.ndarray, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a block, and the norms of what its mean leaves over."""
    sums = x[:, s:e].sum(axis=1)
    return sums, np.sqrt(((e - s) * (x[:, s:e] ** 2).sum(axis=1) - sums**2) / (e - s))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) for each row of ``x``, and how many exact distances were taken."""
    rows, kinds, length = len(x), len(entries), x.shape[1]
    if not length:
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64), 0
    if x.dtype == object or entries.dtype == object:
        x, entries = x.astype(object), entries.astype(object)
        who, what, looked = np.repeat(np.arange(rows), kinds), np.tile(np.arange(kinds), rows), 0
    else:
        slack = 1e-12 * ((x**2).sum(axis=1)[:, None] + (entries**2).sum(axis=1)[None, :]) + 1e-6
        who = what = best = None
        looked = rows
        for blocks in _levels(length):
            low = 0.0
            for s, e in blocks:
                (a, p), (b, q) = _shape(x, s, e), _shape(entries, s, e)
                a, p, b, q = (a[:, None], p[:, None], b[None, :], q[None, :]) if who is None else (a[who], p[who], b[what], q[what])
                low = low + (a - b).astype(np.float64) ** 2 / (e - s) + (p - q) ** 2
            if who is None:
                best = ((x - entries[low.argmin(axis=1)]) ** 2).sum(axis=1)
                who, what = np.nonzero(low - slack <= best[:, None])
            else:
                left = low - slack[who, what] <= best[who]
                who, what = who[left], what[left]
    exact = ((x[who] - entries[what]) ** 2).sum(axis=1)
    starts = np.searchsorted(who, np.arange(rows))
    least = np.minimum.reduceat(exact, starts)
    hit = np.flatnonzero(exact == least[who])
    first = hit[np.searchsorted(who[hit], np.arange(rows))]
    return what[first], least, looked + len(who)


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, COMPONENTS // max(1, width))
    vectors = column(batch, "v")
    for at in range(0, len(vectors), step):
        piece = vectors.slice(at, step)
        yield at, integers(piece.flatten().to_numpy(zero_copy_only=False).reshape(len(piece), width))


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, signed limb) of an integer; zero has one."""
    sign, x, place = (-1 if x < 0 else 1), abs(x), 0
    while x or not place:
        yield place, sign * (x & ((1 << LIMB) - 1))
        x, place = x >> LIMB, place + 1


def _train(books: Codebooks, width: int):
    """Counts (position -1) and sums of the components that fall to each entry, once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for _, x in _matrices(batch, width):
                for p, (s, e) in enumerate(cuts(width)):
                    code, _, _ = nearest(x[:, s:e], books[p])
                    counts[p] += np.bincount(code, minlength=len(books[p]))
                    part = np.zeros(books[p].shape, x.dtype)
                    np.add.at(part, code, x[:, s:e])
                    sums[p] += part
        rows = [(p, int(e), -1, 0, int(counts[p][e])) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        rows += [(p, e, i, place, limb) for p, e, _, _, _ in rows for i, x in enumerate(sums[p][e]) for place, limb in _limbs(int(x))]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["part", "entry", "position", "place", "n"])

    return run


def _encode(books: Codebooks, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, PARTS), np.uint8)
            error, looked = np.zeros(batch.num_rows, object), np.zeros(batch.num_rows, np.int64)
            for at, x in _matrices(batch, width):
                for p, (s, e) in enumerate(cuts(width)):
                    code, far, exact = nearest(x[:, s:e], books[p])
                    codes[at : at + len(x), p] = code
                    error[at : at + len(x)] += far
                    looked[at] += exact
            text = pa.array([r.tobytes().hex() for r in codes], pa.string())
            error = pa.array([min(int(x), MOST) for x in error], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "label"), text, error, pa.array(looked)], names=["vec_id", "label", "code", "error", "n_exact"])

    return run


def train(part: DataFrame, width: int, first: list[list[float]], rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from the vectors ``v`` of ``part``; ``first`` holds the vectors that they begin with."""
    start = integers(np.array(first, np.float64).reshape(len(first), width))
    books = [start[:, s:e] for s, e in cuts(width)]
    for _ in range(rounds):
        told = part.mapInArrow(_train(books, width), "part long, entry long, position long, place long, n long").groupBy("part", "entry", "position", "place").agg(F.sum("n").alias("n"))
        books = [b.astype(object) for b in books]
        counts: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int, int], int] = {}
        for r in told.collect():  # entries times dimensions, whatever the number of vectors
            if r.position < 0:
                counts[r.part, r.entry] = r.n
            else:
                at = r.part, r.entry, r.position
                sums[at] = sums.get(at, 0) + (r.n << (LIMB * r.place))
        for (p, e, i), total in sums.items():
            books[p][e, i] = total // counts[p, e]
        top = max((abs(int(v)) for b in books for v in b.ravel()), default=0)
        if top <= 2**29 / max(1, width):
            books = [b.astype(np.int64) for b in books]
    return books


def compress(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", owner: str = "") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, n_exact) for each proper vector.

    ``n_exact`` counts the exact distances taken; the rows of a batch share it, and its first row has it.
    """
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    part = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(ident).alias("id"), F.col(label).alias("label"), x.cast("array<double>").alias("v"))
    first = [r.v for r in part.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()]
    width = len(first[0]) if first else 0
    first = [v for v in first if len(v) == width]
    kept = part.filter(F.size("v") == width)
    if first and len(first) < ENTRIES:  # others of the same length may follow those of another
        first = [r.v for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()]
    books = train(kept, width, first)
    told = ",".join(str(v) for b in books for e in b for v in e)
    kinds = f"vec_id {vectors.schema[ident].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, code string, error long, n_exact long"
    coded = store.table(kept.mapInArrow(_encode(books, width), kinds), "codes", owner)
    per = coded.groupBy(F.col("label").alias("same")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long").alias("label_error"))
    digest = F.lit(hashlib.sha256(told.encode()).hexdigest())
    return coded.join(per, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"), "n_exact")
