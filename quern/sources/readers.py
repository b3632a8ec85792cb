"""Readers: CSV and JSON imports by column aliases, text lines, framed streams, key-addressed objects, paged sources."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type


def read_csv(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Quoted CSV with trimmed headers and cells; blank rows are dropped, missing cells are empty strings."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, recursiveFileLookup=recursive, pathGlobFilter="*.[cC][sS][vV]")
    df = df.toDF(*[c.strip() for c in df.columns])
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & (F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) == "")
    return df.filter(~blank).fillna("")


def read_json(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """An array of rows, or an object with them under results, data or rows; a nested ``data`` object lies over its row."""
    df = spark.read.json(path, multiLine=True, recursiveFileLookup=recursive, pathGlobFilter="*.[jJ][sS][oO][nN]")
    for c in ("results", "data", "rows"):
        if c in df.columns and df.schema[c].dataType.typeName() == "array":
            df = df.select(F.inline(c))
            break
    if "data" in df.columns and df.schema["data"].dataType.typeName() == "struct":
        inner = df.schema["data"].dataType.names
        df = df.select(*[c for c in df.columns if c != "data" and c not in inner], "data.*")
    return df


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def by_alias(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by any of their known headers, compared without case and punctuation; the first filled one counts."""
    have: dict[str, list[str]] = {}
    for c in df.columns:
        have.setdefault(plain(c), []).append(c)

    def pick(names) -> Column:
        cols = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for n in names for c in have.get(plain(n), [])]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    return df.select(*[pick((k, *names)).alias(k) for k, names in aliases.items()])


def kind_of(columns: list[str], kinds: dict[str, set[str]]) -> str:
    """The import whose headers the file has, the most specific if several fit."""
    have = {plain(c) for c in columns}
    fit = [k for k, need in kinds.items() if {plain(x) for x in need} <= have]
    if not fit:
        raise ValueError(f"no known import has the columns {sorted(columns)}")
    return max(fit, key=lambda k: len(kinds[k]))


def metric_lines(lines: DataFrame, prefix: str = "_metric:") -> DataFrame:
    """JSON objects (as maps of strings) of the lines that carry the prefix; others, and broken ones, are dropped."""
    body = F.substring("value", len(prefix) + 1, 1 << 30)
    return lines.filter(F.col("value").startswith(prefix)).select(F.from_json(body, "map<string,string>").alias("metric")).filter("metric is not null")


def folded_metrics(metrics: DataFrame, key: str, order: str, metric: str = "metric") -> DataFrame:
    """Per key one map with all fields, later lines winning."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.map_entries(metric).alias("e")))), lambda p: F.map_from_entries(p["e"]))  # a map has no order, its entries have
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fold = F.aggregate(pairs, nothing, lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m))
    return metrics.groupBy(key).agg(fold.alias(metric))


#: Fixed value: a routing key names a database and a table.
ROUTE = r"^([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)$"


def routed(rows: DataFrame, body: str, key: str = "_datalake_key", keep: bool = False) -> DataFrame:
    """(database, table, payload, ok): where a JSON event goes by its routing key, which is taken out of it; the body too, if it is to be kept."""
    route, shape = F.get_json_object(body, f"$.{key}"), ROUTE
    fields = F.from_json(body, "map<string,string>")
    return rows.select(*([body] if keep else []), F.nullif(F.regexp_extract(route, shape, 1), F.lit("")).alias("database"), F.nullif(F.regexp_extract(route, shape, 2), F.lit("")).alias("table"), F.to_json(F.map_filter(fields, lambda k, _: k != key)).alias("payload"), F.coalesce(route.rlike(shape), F.lit(False)).alias("ok"))


_BLANK, _LINE = re.compile(r"\r?\n\r?\n"), re.compile(r"\r?\n")


def _payload(frame: str) -> str:
    return "\n".join(x[5:].lstrip(" ") for x in _LINE.split(frame) if x.startswith("data:"))


def sse_events(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, position, data): payloads of a byte stream framed by blank lines; empty ones and the end mark are dropped.

    Streams are read in order, with what follows the last blank line at hand.
    """
    kind = to_arrow_type(chunks.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, place, begun = None, "", 0, False
        out: list[tuple] = []

        def take(frames: list[str]) -> None:
            nonlocal place
            for frame in frames:
                if (data := _payload(frame)) not in ("", "[DONE]"):
                    out.append((now, place, data))
                place += 1

        def rows() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate((kind, pa.int32(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, [key, "position", "data"])

        for batch in batches:
            for k, x in zip(batch.column("k").to_pylist(), batch.column("x").to_pylist(), strict=True):
                if begun and k != now:
                    take([rest])
                    rest, place = "", 0
                now, begun = k, True
                *frames, rest = _BLANK.split(rest + (x or ""))
                take(frames)
            yield rows()
        if begun:
            take([rest])
        yield rows()

    sorted_ = chunks.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("x")).repartition("k").sortWithinPartitions("k", "o", "x")
    return sorted_.mapInArrow(run, f"{key} {chunks.schema[key].dataType.simpleString()}, position int, data string")


def mart_daily(mart: DataFrame, columns: list[str]) -> DataFrame:
    """The day rows of a mart, with the columns that are named, by period."""
    return mart.filter("grain = 'day'").select("period_key", *columns).orderBy("period_key", *columns)


#: What a mart is read with where a key column is not given.
MART_KEYS = {"provider": "all", "model": "all", "product": "zen"}


def mart_period(mart: DataFrame, grain: str, period: str, **given: str) -> DataFrame:
    """The rows of one period that equal all key columns, by their defaults where not given."""
    wanted = {"grain": grain, "period_key": period, **{k: v for k, v in MART_KEYS.items() if k in mart.columns}, **given}
    out = mart
    for column, value in wanted.items():
        out = out.filter(F.col(column) == value)
    return out


def objects(spark: SparkSession, root: str, prefix: str = "", after: str | None = None, before: str | None = None) -> DataFrame:
    """(key, value): JSON objects under a root folder whose key has the prefix and lies between two keys, both left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    k = F.regexp_replace(F.regexp_extract("path", re.escape(root.split("://", 1)[-1].rstrip("/")) + "/(.*)$", 1), r"\.json$", "")
    rows = files.select(k.alias("key"), F.col("content").cast("string").alias("value")).filter(F.col("key").startswith(prefix))
    rows = rows if after is None else rows.filter(F.col("key") > after)
    return rows if before is None else rows.filter(F.col("key") < before)


def files(spark: SparkSession, root: str, glob: str = "*", ignore: tuple[str, ...] = (), hidden: bool = False, depth: int | None = None) -> DataFrame:
    """(path, size, modified) of files that fit a glob and no ignore pattern, at most ``depth`` folders down; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rel = F.regexp_extract("path", re.escape(root.split("://", 1)[-1].rstrip("/")) + "/(.*)$", 1)
    out = df.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if not hidden:
        out = out.filter(~F.col("path").rlike(r"(^|/)\."))
    for pattern in ignore:
        body = re.escape(pattern.rstrip("/")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out = out.filter(~F.col("path").rlike(f"(^|/){body}(/|$)"))
    return out if depth is None else out.filter(F.size(F.split("path", "/")) <= depth)


class _Page(InputPartition):
    pass


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_Page(i) for i in range(int(self.options["pages"]))] if "pages" in self.options else [_Page(None)]

    def read(self, partition) -> Iterator[tuple]:
        import importlib

        module, name = self.options["fetch"].rsplit(":", 1)
        fetch: Callable[[int, int], list[tuple]] = getattr(importlib.import_module(module), name)
        size = int(self.options.get("size", "100"))
        for page in itertools.count() if partition.value is None else [partition.value]:
            got = fetch(page, size)
            yield from got
            if len(got) < size:
                return


class PagedSource(DataSource):
    """A source of numbered pages: option ``fetch`` names a function (module:name) of page and size.

    With option ``pages`` there is one task a page; without it one task reads on until a page is not full.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
