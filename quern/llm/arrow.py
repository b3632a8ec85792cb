"""Small helpers for operators that run on Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; the arrays made from them take up to fifty times as much.
SLICE_BYTES = 1 << 20
#: What this worker keeps from task to task.
_kept: list[dict] = []


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    yield lo, len(size)


def parts_of(text: str, most: int, cut: re.Pattern) -> list[str]:
    """``text`` in parts of about ``most`` characters, cut only where ``cut`` allows it."""
    out, at = [], 0
    while len(text) - at > most and (found := cut.search(text, at + most)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


_WORD = re.compile("[^ \t-\r]+")
_WORD_END = re.compile("(?<=[^ \t-\r])(?=[ \t-\r])")


def word_parts(text: str, most: int, overlap: int = 0) -> Iterator[tuple[str, str]]:
    """(the last ``overlap`` words before, part): a text in parts of about ``most`` characters that end with a word; the next one begins with white space."""
    before = ""
    for part in parts_of(text, most, _WORD_END):
        yield before, part
        if overlap:
            before = " ".join(_WORD.findall(before + part)[-overlap:])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return x.view(np.int64)


def tidy() -> None:
    """Gives memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worker_cache() -> dict:
    """A dictionary that a worker keeps from task to task, as long as these are ``tidied(..., cached=True)``."""
    _kept.append({})
    return _kept[-1]


def forget() -> None:
    """Empties the worker's caches."""
    if any(_kept):
        for cache in _kept:
            cache.clear()
        tidy()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cached: bool = False):
    """``run``, and :func:`tidy` after it: workers outlive their tasks, and allocators keep what was freed.

    A worker that served another operator holds that one's caches; they go first, unless this one is ``cached`` too.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            forget()
        yield from run(batches)
        tidy()

    return wrapped
