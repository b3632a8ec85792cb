"""Token totals kept up to date by signed deltas.

A ledger folder holds one Parquet folder per committed batch.  A batch lists changes of documents: an insert adds the
document's tokens, a delete takes them away, and a revision does both with the old and the new count, each under its
own tokenizer version.  :func:`deltas` turns changes into additive rows (source, lang, version, docs, tokens), summed
within the batch before they are written; the totals are the sums over all batches.  A batch is written under a
temporary name of its own and renamed, and one that is there already is left alone, so a batch that is sent twice, also
by two writers at once, counts once (the store's rename must be atomic, as in HDFS and local file systems).
:func:`compact` replaces many small batches by one, which keeps their ids; :func:`count_tokens` gives the counts.

Null source, language or version is a group of its own; a null count is 0; groups whose documents and tokens
are both zero again are dropped from the totals; repeated rows count as often as they come; an empty batch is committed
and changes nothing.  Other columns are ignored.  All steps are partial aggregations, so a hot source is one row a task.
Texts of any length are counted in parts (see :mod:`~quern.llm.tokens`); null text has no tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import piece, store, tokens
from quern.llm.arrow import column, text_slices, tidied

GROUP = ("source", "lang", "version")
SCHEMA = "batch string, source string, lang string, version string, docs long, tokens long"


def _signed(df: DataFrame, version: str, tokens: str, sign: int) -> DataFrame:
    return df.select("source", "lang", F.col(version).alias("version"), F.lit(sign).cast("long").alias("docs"), (F.coalesce(F.col(tokens), F.lit(0)) * sign).cast("long").alias("tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Additive rows of changes (op: insert, delete or revise; source, lang; version, tokens; for revisions old_version, old_tokens too)."""
    plus = _signed(changes.filter(F.col("op").isin("insert", "revise")), "version", "tokens", 1)
    minus = _signed(changes.filter(F.col("op") == "delete"), "version", "tokens", -1)
    undone = _signed(changes.filter(F.col("op") == "revise"), "old_version", "old_tokens", -1)
    return plus.union(minus).union(undone).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def commit(changes: DataFrame, ledger: str, batch: str) -> bool:
    """Adds a batch to the ledger; False (and nothing added) if it is there already."""
    if batch.startswith("base-") or "/" in batch:
        raise ValueError("a batch's name holds no slash and does not begin with base-")
    spark = changes.sparkSession
    fs, done = store._fs(spark, f"{ledger}/batch={batch}")
    if fs.exists(done) or not _taken(spark, ledger).filter(F.col("taken") == batch).isEmpty():
        return False
    name = f"_pending-{uuid.uuid4().hex}"
    deltas(changes).write.parquet(f"{ledger}/{name}")
    return _publish(spark, f"{ledger}/{name}", f"{ledger}/batch={batch}")


def _publish(spark: SparkSession, part: str, done: str) -> bool:
    """Renames a finished folder; False if another one took the place first."""
    fs, at = store._fs(spark, part)
    target = store._fs(spark, done)[1]
    inside = store._fs(spark, f"{done}/{at.getName()}")[1]  # where some stores put a folder that is renamed to one that exists
    moved = bool(fs.rename(at, target)) and not fs.exists(inside)
    if not moved:
        fs.delete(inside, True)
        fs.delete(at, True)
        if not fs.exists(target):
            raise OSError(f"could not rename {part}")
    return moved


def _names(spark: SparkSession, ledger: str) -> list[str]:
    """The folders that are batches, bases included."""
    fs, root = store._fs(spark, ledger)
    found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n.removeprefix("batch=") for n in found if n.startswith("batch="))


def _read(spark: SparkSession, ledger: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], SCHEMA + ", batches array<string>")
    kind = "source string, lang string, version string, docs long, tokens long, batches array<string>, batch string"
    return spark.read.schema(kind).option("basePath", ledger).parquet(*[f"{ledger}/batch={n}" for n in names])


def _taken(spark: SparkSession, ledger: str, names: list[str] | None = None) -> DataFrame:
    """(taken): ids of batches that a compaction has taken in."""
    names = _names(spark, ledger) if names is None else names
    return _read(spark, ledger, [n for n in names if n.startswith("base-")]).select(F.explode("batches").alias("taken")).distinct()


def totals(spark: SparkSession, ledger: str, names: list[str] | None = None) -> DataFrame:
    """(source, lang, version, docs, tokens) over all committed batches (or those of ``names``)."""
    names = _names(spark, ledger) if names is None else names
    live = _read(spark, ledger, names).join(_taken(spark, ledger, names), F.col("batch") == F.col("taken"), "left_anti")
    summed = live.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return summed.filter("docs <> 0 or tokens <> 0")


def compact(spark: SparkSession, ledger: str, name: str) -> bool:
    """One base batch in place of all batches there are now; False (and nothing done) if this compaction has been made.

    The base lists what it has taken in (in rows of zeros), so none of these can be committed or counted again; it
    appears by one rename, and only then are the old folders deleted, never the base itself.  Batches that are committed
    meanwhile stay as they are.  One compaction runs at a time: a second one under another name is refused, and one
    that was cut short is finished by calling it again under its name.
    """
    fs, lock = store._fs(spark, f"{ledger}/_compacting={name}")
    names = _names(spark, ledger)
    made = f"base-{name}"
    if not names:
        return False
    if made not in names:
        mine = not fs.exists(lock)
        fs.mkdirs(lock)
        others = {s.getPath().getName() for s in fs.listStatus(lock.getParent()) if s.getPath().getName().startswith("_compacting=")} - {lock.getName()}
        if others:  # of two that begin at once at least one sees the other
            if mine:
                fs.delete(lock, True)
            raise RuntimeError(f"another compaction is at work: {sorted(others)}")
        names = _names(spark, ledger)
        base = totals(spark, ledger, names).withColumn("batches", F.lit(None).cast("array<string>"))
        known = spark.createDataFrame([(n,) for n in names], "taken string").union(_taken(spark, ledger, names)).distinct()
        nothing = [F.lit(None).cast("string").alias(c) for c in GROUP] + [F.lit(0).cast("long").alias(c) for c in ("docs", "tokens")]
        mark = known.select(*nothing, F.array("taken").alias("batches"))
        part = f"{ledger}/_pending-{uuid.uuid4().hex}"
        base.union(mark).write.parquet(part)
        fresh = _publish(spark, part, f"{ledger}/batch={made}")
    else:
        fresh = False
    if fs.exists(lock):
        gone = {r.taken for r in _read(spark, ledger, [made]).select(F.explode("batches").alias("taken")).toLocalIterator()}
        for x in _names(spark, ledger):
            if x in gone and x != made:
                fs.delete(store._fs(spark, f"{ledger}/batch={x}")[1], True)
        fs.delete(lock, True)
    return fresh


def count_tokens(docs: DataFrame, byte_path: str, piece_path: str, second: Column, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``first_tokens`` (by the byte-level tokenizer file) and ``second_tokens`` (by the piece file; null where ``second`` does not hold)."""
    carried = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = column(batch, "__text"), column(batch, "__second").to_numpy(zero_copy_only=False)
            one, two = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for lo, hi in text_slices(texts, tokens.SLICE):
                part = texts.slice(lo, hi - lo)
                one[lo:hi] = np.diff(tokens.encoder(byte_path).encode(part)[1])
                two[lo:hi][wanted[lo:hi]] = piece.model(piece_path).count(part.filter(pa.array(wanted[lo:hi])))
            yield pa.RecordBatch.from_arrays([column(batch, "__kept"), pa.array(one), pa.array(two, mask=~wanted)], ["__kept", "first_tokens", "second_tokens"])

    named = docs.select(F.struct(*[docs[c] for c in carried]).alias("__kept"), F.coalesce(docs[text], F.lit("")).alias("__text"), F.coalesce(second, F.lit(False)).alias("__second"))
    kind = named.select("__kept", F.lit(0).cast("long").alias("first_tokens"), F.lit(None).cast("long").alias("second_tokens")).schema
    return named.mapInArrow(tidied(run, cached=True), kind).select("__kept.*", "first_tokens", "second_tokens")
