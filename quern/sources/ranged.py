"""Tables in key ranges: a merge reads and writes only the files whose range holds one of its keys.

A table is a folder with ``data`` (Parquet files, each sorted by key, no two of them with a key in common), ``_manifests``
(for every state one row per file: its least and greatest key and its rows) and ``_commits`` (one small file per state,
numbered).  A state begins to exist when its commit file is renamed into place, which is one step; what the merge wrote
before is seen by nobody until then, and a merge that is cut short at any point leaves the state before it.  Files are
never changed, so a reader goes on with the state that it began with; :func:`vacuum` deletes what no kept state names.

Keys find their file by binary search over the files' least keys, in two levels: the square root of their number is sent
to all tasks, the rest is joined.  The driver holds the names of the files that a merge touches, one string each.

Keys are unique: of rows that repeat a key the greatest (by all columns in order) stays.  Null keys are keys like any
other, equal to one another and less than all others.  One writer at a time: a second that comes to the same number
fails with :class:`Conflict`, and its rows are not in the table.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import scratch

#: Rows of a file; one that would get more than twice as many is split.
FILE_ROWS = 1_000_000


class Conflict(RuntimeError):
    """Another writer has made the state that this one was about to make."""


@dataclass
class State:
    path: str
    version: int
    keys: list[str]
    schema: StructType
    manifest: str
    files: int
    note: dict

    def ranges(self, spark: SparkSession) -> DataFrame:
        """(place, file, low, high, rows) of every file, places in the order of keys."""
        return spark.read.parquet(f"{self.path}/_manifests/{self.manifest}")


_systems: dict[tuple, object] = {}


def _fs(spark: SparkSession, path: str):
    """A file system of its own, which writes no checksum files beside commits."""
    jvm = spark.sparkContext._jvm
    uri = jvm.org.apache.hadoop.fs.Path(path).toUri()
    key = spark.sparkContext.applicationId, uri.getScheme(), uri.getAuthority()
    if key not in _systems:
        _systems[key] = jvm.org.apache.hadoop.fs.FileSystem.newInstance(uri, spark.sparkContext._jsc.hadoopConfiguration())
        _systems[key].setWriteChecksum(False)
    return _systems[key], lambda s: jvm.org.apache.hadoop.fs.Path(s)


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    folder = at(f"{path}/_commits")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def state(spark: SparkSession, path: str, version: int | None = None) -> State | None:
    """The newest state of the table, or the one of that number; None where there is no table."""
    found = _versions(spark, path)
    if not found:
        return None
    version = found[-1] if version is None else version
    fs, at = _fs(spark, path)
    stream = fs.open(at(f"{path}/_commits/{version:010d}"))
    told = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return State(path, version, told["keys"], StructType.fromJson(told["schema"]), told["manifest"], told["files"], told["note"])


def _commit(spark: SparkSession, new: State) -> None:
    fs, at = _fs(spark, new.path)
    part, whole = at(f"{new.path}/_commits/.{uuid.uuid4().hex}"), at(f"{new.path}/_commits/{new.version:010d}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps({"keys": new.keys, "schema": json.loads(new.schema.json()), "manifest": new.manifest, "files": new.files, "note": new.note}).encode()))
    out.close()
    if fs.exists(whole) or not fs.rename(part, whole):
        fs.delete(part, False)
        raise Conflict(f"state {new.version} of {new.path} is there already")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's rows in its newest state, or in an earlier one that is still kept."""
    s = state(spark, path, version)
    if s is None:
        raise FileNotFoundError(f"no table at {path}")
    return _rows(spark, s, [r.file for r in s.ranges(spark).select("file").collect()])


def _rows(spark: SparkSession, s: State, files: list[str]) -> DataFrame:
    return spark.read.schema(s.schema).parquet(*[f"{s.path}/data/{f}" for f in files]) if files else spark.createDataFrame([], s.schema)


def _upto(lows: Column, key: Column, most: int) -> Column:
    """How many of the sorted ``lows`` (``most`` or fewer) are at or below ``key``, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        upper = F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))
        lower = F.struct(s["lo"].alias("lo"), middle.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(lows, middle) <= key, upper).otherwise(lower)

    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(lows), F.lit(0)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), start, halve)["lo"]


def _located(rows: DataFrame, s: State) -> DataFrame:
    """``rows`` with ``__at``, the place of the last file that begins at or before the row's key (of the first, where none does)."""
    step = math.isqrt(max(1, s.files)) + 1
    key = F.struct(*s.keys)
    parts = s.ranges(rows.sparkSession).groupBy(F.floor(F.col("place") / step).alias("__g")).agg(F.min("place").alias("__from"), F.array_sort(F.collect_list(F.struct("place", "low"))).alias("__lows"))
    parts = parts.withColumn("__lows", F.transform("__lows", lambda x: x["low"]))
    tops = parts.agg(F.array_sort(F.collect_list(F.struct("__g", F.get("__lows", F.lit(0)).alias("low")))).alias("__tops")).select(F.transform("__tops", lambda x: x["low"]).alias("__tops"))
    coarse = rows.crossJoin(F.broadcast(tops)).withColumn("__g", F.greatest(_upto(F.col("__tops"), key, step) - 1, F.lit(0)).cast("long"))  # one row, a root of the number of files
    fine = coarse.join(parts, "__g").withColumn("__at", F.col("__from") + F.greatest(_upto(F.col("__lows"), key, step) - 1, F.lit(0)))
    return fine.select(*rows.columns, "__at")


def _store(rows: DataFrame, path: str, keys: list[str], sizes: dict[int, int]) -> str:
    """Writes rows with their ``__at``, each place's files by themselves; ``sizes`` are rows by place.  Places that have become large are cut by key."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    target = f"{path}/data/{folder}"
    large = [p for p, n in sizes.items() if n > 2 * FILE_ROWS]
    writer = lambda df: df.sortWithinPartitions("__at", *keys).write.mode("append").partitionBy("__at").parquet(target)
    if large:
        marks = spark.createDataFrame([(p,) for p in large], "__at long")
        parts = max(1, math.ceil(sum(sizes[p] for p in large) / FILE_ROWS))
        writer(rows.join(F.broadcast(marks), "__at", "left_semi").repartitionByRange(parts, "__at", *keys))  # one row per large file
        rows = rows.join(F.broadcast(marks), "__at", "left_anti")
    if len(large) < len(sizes):
        writer(rows.repartition("__at"))
    return folder


def _ranges(spark: SparkSession, path: str, folder: str, keys: list[str], schema: StructType) -> DataFrame:
    """What the manifest says of the files in a folder of ``data``."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/data/{folder}")
    if len(keys) == 1:  # a plain value is aggregated by hash, a struct by sorting all rows; a null is less than all others
        k = F.col(keys[0])
        least = F.when(F.count(k) == F.count("*"), F.min(k))
        low, high = (F.struct(x.alias(keys[0])) for x in (least, F.max(k)))
    else:
        low, high = F.min(F.struct(*keys)), F.max(F.struct(*keys))
    per = rows.select(F.input_file_name().alias("file"), *keys).groupBy("file").agg(low.alias("low"), high.alias("high"), F.count("*").alias("rows"))
    return per.select(F.concat(F.lit(folder), F.element_at(F.split("file", folder), -1)).alias("file"), "low", "high", "rows")


def _advance(spark: SparkSession, s: State | None, path: str, keys: list[str], schema: StructType, gone: list[int], folder: str | None, note: dict) -> None:
    """The next state: the files before without those at ``gone``, and those of ``folder``."""
    ranges = None if folder is None else _ranges(spark, path, folder, keys, schema)
    if s is not None:
        left = s.ranges(spark).join(F.broadcast(spark.createDataFrame([(p,) for p in gone], "place long")), "place", "left_anti").drop("place")
        ranges = left if ranges is None else left.unionByName(ranges)
    name = uuid.uuid4().hex
    # one row per file, in one partition and by key, so that places are their numbers
    ranges.coalesce(1).sortWithinPartitions("low").select(F.monotonically_increasing_id().alias("place"), "*").write.parquet(f"{path}/_manifests/{name}")
    files = spark.read.parquet(f"{path}/_manifests/{name}").count()
    _commit(spark, State(path, s.version + 1 if s else 0, keys, schema, name, files, note))


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the greatest one."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    if len(rest) == 1:
        return rows.groupBy(*keys).agg(F.max(rest[0]).alias(rest[0])).select(*rows.columns)
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*[F.col(c) if c in keys else F.col("__r")[c].alias(c) for c in rows.columns])


def create(rows: DataFrame, path: str, keys: list[str], note: dict | None = None) -> None:
    """A table of ``rows``; there must be none at ``path``."""
    spark = rows.sparkSession
    between = scratch(spark)
    one_of_each(rows, keys).write.parquet(between)
    rows = spark.read.schema(rows.schema).parquet(between)
    folder = _store(rows.withColumn("__at", F.lit(0).cast("long")), path, keys, {0: rows.count()})
    _advance(spark, None, path, keys, rows.schema, [], folder, note or {})


def merge(rows: DataFrame, path: str, keys: list[str], change: dict[str, Column] | None = None, where: Column | None = None, insert: bool = True, remove: Column | None = None, note: dict | None = None) -> None:
    """Takes ``rows`` into the table.

    A stored row of equal key becomes ``change`` (column to expression over ``old.<column>`` and ``new.<column>``; columns
    that are not named keep what is stored, and all of ``rows``' columns are taken where ``change`` is None), if ``where``
    holds; a row without a stored one is put in with its own columns, if ``insert``.  Rows for which ``remove`` (over the
    same names) holds are not in the table afterwards.  ``note`` is kept with the state.
    """
    spark = rows.sparkSession
    s = state(spark, path)
    if s is None:
        gone = F.lit(False) if remove is None else F.coalesce(remove, F.lit(False))
        create(rows.select(F.struct(*rows.columns).alias("new"), F.lit(None).cast(rows.schema).alias("old")).filter(~gone).select("new.*") if insert else rows.limit(0), path, keys, note)
        return
    between = scratch(spark)
    own = one_of_each(rows, keys)
    (_located(own, s) if s.files else own.withColumn("__at", F.lit(0).cast("long"))).write.parquet(between)
    new = spark.read.schema(StructType(rows.schema.fields).add("__at", "long")).parquet(between)
    sizes = {r["__at"]: r["count"] for r in new.groupBy("__at").count().collect()}  # one row per touched file
    if not sizes:
        if note is not None:
            _commit(spark, State(path, s.version + 1, s.keys, s.schema, s.manifest, s.files, note))
        return
    marks = F.broadcast(spark.createDataFrame([(p,) for p in sizes], "place long"))
    touched = s.ranges(spark).join(marks, "place").select("place", "file", "rows").collect()
    for r in touched:
        sizes[r.place] += r.rows
    columns = s.schema.names
    places = F.broadcast(spark.createDataFrame([(r.file, r.place) for r in touched], "__file string, __old_at long"))  # one row per touched file
    old = _rows(spark, s, [r.file for r in touched]).withColumn("__file", F.element_at(F.split(F.input_file_name(), "/data/"), -1))
    old = old.join(places, "__file").select(F.struct(*columns).alias("old"), "__old_at")
    new = new.select(F.struct(*rows.columns).alias("new"), "__at")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    met = old.join(new, same, "full")
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    takes = has_old & has_new & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    change = {c: F.col(f"new.{c}") for c in rows.columns} if change is None else change
    fresh = lambda c: F.col(f"new.{c}") if c in rows.columns else F.lit(None)
    kept = has_old if not insert else F.lit(True)
    if remove is not None:
        kept = kept & ~F.coalesce(has_new & remove, F.lit(False))
    value = lambda c: F.when(~has_old, fresh(c)).when(takes, change.get(c, F.col(f"old.{c}"))).otherwise(F.col(f"old.{c}")).cast(s.schema[c].dataType).alias(c)
    out = met.filter(kept).select(*[value(c) for c in columns], F.coalesce("__old_at", "__at").alias("__at"))
    folder = _store(out, path, keys, sizes)
    _advance(spark, s, path, keys, s.schema, [r.place for r in touched], folder, s.note if note is None else note)


def delete(spark: SparkSession, path: str, where: Column) -> None:
    """Rows for which ``where`` holds are taken out; only files that hold such are written anew."""
    s = state(spark, path)
    every = read(spark, path).withColumn("__file", F.element_at(F.split(F.input_file_name(), "/data/"), -1))
    hit = F.coalesce(where, F.lit(False))
    files = s.ranges(spark).select("place", "file", "rows").join(every.filter(hit).select(F.col("__file").alias("file")).distinct(), "file").collect()
    if not files:
        return
    marks = F.broadcast(spark.createDataFrame([(r.file, r.place) for r in files], "__file string, __at long"))  # one row per touched file
    left = _rows(spark, s, [r.file for r in files]).withColumn("__file", F.element_at(F.split(F.input_file_name(), "/data/"), -1)).filter(~hit).join(marks, "__file").drop("__file")
    folder = _store(left, path, s.keys, {r.place: r.rows for r in files})
    _advance(spark, s, path, s.keys, s.schema, [r.place for r in files], folder, s.note)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes earlier states but the newest ``keep``, and all files that no kept state names; how many files went.  Readers of an earlier state must have ended."""
    versions = _versions(spark, path)
    states = [state(spark, path, v) for v in versions[-keep:]]
    fs, at = _fs(spark, path)
    for v in versions[:-keep]:
        fs.delete(at(f"{path}/_commits/{v:010d}"), False)
    for f in fs.listStatus(at(f"{path}/_manifests")):
        if f.getPath().getName() not in {s.manifest for s in states}:
            fs.delete(f.getPath(), True)
    named = {r.file for s in states for r in s.ranges(spark).select("file").collect()}
    gone, every = 0, fs.listFiles(at(f"{path}/data"), True)
    while every.hasNext():
        p = every.next().getPath()
        name = p.toString().split("/data/")[-1]
        if name.endswith(".parquet") and name not in named:
            fs.delete(p, False)
            gone += 1
    return gone


def upsert(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Rows replace those of equal keys, or are put in."""
    merge(rows, path, keys)


def increment(rows: DataFrame, path: str, keys: list[str], counters: list[str]) -> None:
    """Counters of equal keys add up; rows of one batch that share a key are summed first."""
    rows = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
    merge(rows, path, keys, {c: F.col(f"old.{c}") + F.col(f"new.{c}") for c in counters})


def set_columns(rows: DataFrame, path: str, keys: list[str], columns: list[str], revive: str | None = None, insert: bool = True) -> None:
    """Some columns are set; ``revive`` names a deletion time that is cleared.  Without ``insert`` only stored rows change."""
    merge(rows.select(*keys, *columns), path, keys, {c: F.col(f"new.{c}") for c in columns} | ({revive: F.lit(None)} if revive else {}), insert=insert)


def insert_ignore(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Rows whose key is not there yet are put in."""
    merge(rows, path, keys, where=F.lit(False))
