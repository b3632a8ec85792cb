"""Files of a tree without what its ignore files name.

Each folder may hold ignore files whose lines are patterns for what lies below it.  Of the patterns that fit a file or
folder the last one decides, in this order: kinds of ignore files as given (later kinds weigh more), then the deeper
folder, then the later line.  A pattern with a ``/`` before its end is anchored to its folder, one that ends with ``/`` fits
folders only, ``!`` takes back what an earlier pattern named, ``*``, ``?``, ``[...]`` stay within a name and ``**`` does not.
What lies in an ignored folder is ignored, whatever patterns say of it.

A tree is listed level by level, the folders of a level by many tasks, hidden names too.  Patterns are compiled once, where
their file is read.  Every folder meets the patterns of the folders above it by a join on the folder's name, so that
neither the listing nor the patterns are in one place.  Links of a local file system are left out, or followed unless
they lead to a folder that they lie in.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import scratch

#: Names of ignore files, the ones that weigh more last.
IGNORE_FILES = (".gitignore", ".ignore", ".rgignore")


def _body(pattern: str) -> str:
    """A pattern's regular expression; an unclosed bracket stands for itself."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i) and i + 2 == len(pattern) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, i = out + "(?!/)[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]", end
        else:
            out += re.escape(c)
        i += 1
    return out


def compiled(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression for a path below the ignore file's folder, negated, folders only), or None for a line without a pattern."""
    line = line.rstrip("\r\n")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    if not line:
        return None
    anchored = "/" in line
    return f"^{'' if anchored else '(?:.*/)?'}{_body(line.removeprefix('/'))}$", negated, folders


def _children(root: str, follow: bool):
    """What lies in each folder; ``chain`` has the real places of the folders on the way to one, a link to any of which would be a ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, chain in zip(batch.column("path").to_pylist(), batch.column("chain").to_pylist(), strict=True):
                fs, top = pafs.FileSystem.from_uri(root)
                local = isinstance(fs, pafs.LocalFileSystem)
                base = f"{top.rstrip('/')}/{folder}" if folder else top
                rows = []
                for info in fs.get_file_info(pafs.FileSelector(base)):
                    if info.type == pafs.FileType.NotFound or (local and not follow and os.path.islink(info.path)):
                        continue
                    is_folder = info.type == pafs.FileType.Directory
                    real = os.path.realpath(info.path) if local else info.path
                    if is_folder and real in chain:
                        continue
                    rows.append((f"{folder}/{info.base_name}".lstrip("/"), is_folder, info.size or 0, info.mtime, [*chain, real] if is_folder else None))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "is_folder", "size", "modified", "chain"])

    return run


def tree(spark: SparkSession, root: str, follow: bool = False, depth: int | None = None) -> DataFrame:
    """(path, is_folder, size, modified, chain) of all that lies below ``root``, level by level, at most ``depth`` names deep."""
    schema, out, n = "path string, is_folder boolean, size long, modified timestamp, chain array<string>", scratch(spark), 0
    fs, top = pafs.FileSystem.from_uri(root)
    level = spark.createDataFrame([("", [os.path.realpath(top)])], "path string, chain array<string>")
    while True:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        level.repartition(tasks, "path").mapInArrow(_children(root, follow), schema).write.parquet(f"{out}/{n}")
        found = spark.read.schema(schema).parquet(f"{out}/{n}")
        n += 1
        level = found.filter("is_folder").select("path", "chain")
        if n == depth or level.isEmpty():
            return spark.read.schema(schema).parquet(*[f"{out}/{i}" for i in range(n)])


def _patterns(root: str, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                folder, _, name = path.rpartition("/")
                fs, at = pafs.FileSystem.from_uri(f"{root.rstrip('/')}")
                with fs.open_input_stream(f"{at}/{path}") as stream:
                    content = stream.read().decode(errors="replace")
                for n, line in enumerate(content.split("\n")):
                    if (rule := compiled(line)) is not None:
                        rows.append((folder, names.index(name), n, *rule))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["folder", "kind", "line", "regex", "negated", "folders"])

    return run


def listed(spark: SparkSession, root: str, glob: str = "*", hidden: bool = False, depth: int | None = None, follow: bool = False, ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """(path, size, modified) of the files below ``root`` whose name fits ``glob`` and that no ignore file takes out, at most ``depth`` names deep; contents are not read, but those of ignore files."""
    every = tree(spark, root, follow, depth).filter("not is_folder").select("path", "size", "modified")
    name = F.element_at(F.split("path", "/"), -1)
    files = every.filter(name.rlike(fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")))
    if not hidden:
        files = files.filter(~F.col("path").rlike(r"(^|/)\."))
    rules = every.filter(name.isin(*ignore_files)).select("path").mapInArrow(_patterns(root, ignore_files), "folder string, kind int, line int, regex string, negated boolean, folders boolean")
    names = F.split("path", "/")
    upto = lambda n: F.array_join(F.slice(names, 1, n), "/")
    # every file, and every folder above one, once
    steps = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.struct(upto(n).alias("entry"), (n < F.size(names)).alias("is_folder"), n.alias("depth")))
    entries = files.select(F.inline(steps)).distinct()
    parts = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda n: F.struct(F.when(n == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/")).alias("folder"), n.alias("at"), F.array_join(F.slice(parts, n + 1, F.col("depth")), "/").alias("rest")))
    met = entries.select("entry", "is_folder", F.inline(above)).join(rules, "folder")
    fits = met.filter((F.col("is_folder") | ~F.col("folders")) & F.regexp_like("rest", F.col("regex")))
    decided = fits.groupBy("entry").agg(F.max_by("negated", F.struct("kind", "at", "line")).alias("kept"))
    out = decided.filter(~F.col("kept")).select("entry")
    gone = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), upto)).alias("entry")).join(out, "entry").select("path").distinct()
    return files.join(gone, "path", "left_anti").select("path", "size", "modified")
