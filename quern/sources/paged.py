"""Sources of numbered pages, read in parallel and as streams.

A page source is a function of (page, size, options) that gives a page's rows; a page that is not full is the last.  How
many pages there are is found by doubling the page number until one is not full, and halving what lies between: as many
page reads as the logarithm of their number.  Then every task reads a run of pages.  As a stream the offset is the
number of rows, so that a last page that grows gives its new rows, and a stream that was stopped goes on where it ended.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Pages that one task reads.
RUN = 8

Fetch = Callable[[int, int, dict[str, str]], list[tuple]]


def count_rows(length: Callable[[int], int], size: int, known: int = 0) -> int:
    """Rows of a source whose page p has ``length(p)`` rows, ``size`` if it is full; ``known`` rows are there already."""
    full = known // size  # all pages below this one are full
    step = 1
    while length(full + step - 1) == size:
        full, step = full + step, step * 2
    low, high = full, full + step - 1  # the first page that is not full is one of these
    while low < high:
        middle = (low + high) // 2
        if length(middle) == size:
            low = middle + 1
        else:
            high = middle
    return low * size + length(low)


def file_page(page: int, size: int, options: dict[str, str]) -> list[tuple]:
    """A page that was written beforehand: the JSON lines in ``folder``/page=N, in the order of the named columns."""
    fs, path = pafs.FileSystem.from_uri(f"{options['folder'].rstrip('/')}/page={page}")
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return []
    names = [c.strip().split(" ")[0] for c in options["columns"].split(",")]
    out = []
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.base_name.endswith(".json"):
            with fs.open_input_stream(f.path) as lines:
                out += [tuple(json.loads(line).get(n) for n in names) for line in lines.read().decode().splitlines()]
    return out


class Rows(InputPartition):
    """Rows from one number up to another."""

    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.options, self.size = options, int(options.get("size", "100"))

    def fetch(self, page: int) -> list[tuple]:
        module, name = self.options["fetch"].rsplit(":", 1)
        fetch: Fetch = getattr(importlib.import_module(module), name)
        return fetch(page, self.size, self.options)

    def total(self, known: int = 0) -> int:
        return count_rows(lambda p: len(self.fetch(p)), self.size, known)

    def runs(self, first: int, end: int) -> list[Rows]:
        """Runs of whole pages between two rows."""
        cuts = [first, *range((first // self.size + RUN) * self.size, end, RUN * self.size), end]
        return [Rows(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Rows) -> Iterator[tuple]:
        for page in range(partition.first // self.size, -(-partition.end // self.size)):
            rows, at = self.fetch(page), page * self.size
            yield from rows[max(0, partition.first - at) : partition.end - at]


class PagesReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Rows]:
        return self.runs(0, self.total()) or [Rows(0, 0)]


class PagesStreamReader(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.known = 0

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        self.known = self.total(self.known)
        return {"rows": self.known}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return self.runs(start["rows"], end["rows"])


class Pages(DataSource):
    """Format ``pages``: ``fetch`` names a page source (module:name), ``size`` its page size, ``columns`` the schema; all options go to it."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema) -> PagesStreamReader:
        return PagesStreamReader(dict(self.options))
