"""Sinks over plain Parquet and CSV: upserts by rewriting, routed appends, idempotent batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import scratch
from quern.sources.readers import routed


def _exists(spark: SparkSession, path: str) -> bool:
    _restore(spark, path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _renamed(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"{old} could not be renamed to {new}")


def _swap(df: DataFrame, path: str) -> None:
    """``df`` (which may read ``path``) in place of what is there: written beside it, then renamed.

    A reader may find no table between the two renames, for which :mod:`quern.sources.ranged` has none; where the driver
    ended there, the next call puts the old table back first.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, here = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + s) for s in ("._new", "._old", ""))
    fs = here.getFileSystem(conf)
    df.write.mode("overwrite").parquet(new.toString())
    if fs.exists(here):
        fs.delete(old, True)
        _renamed(fs, here, old)
    _renamed(fs, new, here)
    fs.delete(old, True)


def _restore(spark: SparkSession, path: str) -> None:
    """Puts back what :func:`_swap` had set aside when its driver ended."""
    jvm = spark.sparkContext._jvm
    old, here = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + s) for s in ("._old", ""))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(here) and fs.exists(old):
        _renamed(fs, old, here)


def merge_overwrite(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert: rows replace those of equal keys; of rows that repeat a key one stays."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys)
    if _exists(spark, path):
        old = spark.read.parquet(path)
        rows = old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)
    _swap(rows, path)


def merge_increment(rows: DataFrame, path: str, keys: list[str], counters: list[str]) -> None:
    """Upsert: counters of equal keys add up."""
    spark = rows.sparkSession
    both = spark.read.parquet(path).unionByName(rows) if _exists(spark, path) else rows
    _swap(both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]), path)


def merge_columns(rows: DataFrame, path: str, keys: list[str], columns: list[str], revive: str | None = None) -> None:
    """Upsert of some columns; ``revive`` names a deletion time that is cleared."""
    spark = rows.sparkSession
    _restore(spark, path)
    old = spark.read.parquet(path)
    new = rows.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    met = old.join(new, keys, "full")
    cols = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == revive else F.col(c) for c in old.columns]
    _swap(met.select(*cols), path)


def merge_where(rows: DataFrame, path: str, keys: list[str], where) -> None:
    """Upsert under a condition: rows replace those of equal keys where ``where`` (over the stored row's columns, and the new ones as ``new.<column>``) holds, and are inserted where there are none."""
    spark = rows.sparkSession
    _restore(spark, path)
    old, new = spark.read.parquet(path), rows.dropDuplicates(keys).select(*keys, F.struct(*rows.columns).alias("new"))
    met = old.withColumn("__old", F.struct(*old.columns)).join(new, keys, "full")
    takes = F.col("new").isNotNull() & (F.col("__old").isNull() | F.coalesce(where, F.lit(False)))
    _swap(met.select(*[F.when(takes, F.col("new")[c]).otherwise(F.col("__old")[c]).alias(c) for c in old.columns]), path)


def accumulate(rows: DataFrame, path: str, key: str, usage: str, updated: str, bound) -> None:
    """Counters (key, usage, updated) grow by the rows' (key, cost, at), or start again where they were last updated before ``bound`` (an expression over ``at``)."""
    spark = rows.sparkSession
    _restore(spark, path)
    old = spark.read.parquet(path)
    met = old.join(rows.select(key, "cost", "at"), key, "full")
    known = F.when(F.col("cost").isNull(), F.col(usage)).otherwise(accumulate_or_reset(F.col(usage), F.col(updated), bound, F.col("cost")))
    _swap(met.select(key, F.coalesce(known, F.col("cost")).alias(usage), F.coalesce("at", updated).alias(updated)), path)


def upsert_periods(rows: DataFrame, path: str, by: list[str], keys: list[str]) -> None:
    """Upsert into a table that is partitioned by ``by``: only partitions that rows touch are read and written, each replaced as a whole.

    ``by`` are among ``keys``.  The new partitions are written into the shared folder first, since they read what they replace.
    """
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys)
    if _exists(spark, path):
        kept = spark.read.parquet(path).join(rows.select(*by).distinct(), by, "left_semi").join(rows.select(*keys), keys, "left_anti")
        rows = kept.unionByName(rows)
    between = scratch(spark)
    rows.write.parquet(between)
    replace_partitions(spark.read.schema(rows.schema).parquet(between), path, by)


def update_from(rows: DataFrame, path: str, keys: list[str], columns: list[str]) -> None:
    """Columns of stored rows set from the rows of equal keys; rows without a stored one are left out."""
    spark = rows.sparkSession
    _restore(spark, path)
    old = spark.read.parquet(path)
    new = rows.dropDuplicates(keys).select(*keys, F.struct(*columns).alias("__new"))
    met = old.join(new, keys, "left")
    _swap(met.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns]), path)


def import_sessions(nested: DataFrame, root: str) -> None:
    """Nested session documents (id, title, messages: list of (id, role, parts: list of (id, text))) taken apart into three tables: sessions are upserted, messages and parts inserted where they are absent."""
    messages = nested.select(F.col("id").alias("session"), F.inline("messages")).select("session", "id", "role", "parts")
    merge_overwrite(nested.select("id", "title"), f"{root}/session", ["id"])
    insert_ignore(messages.select("id", "session", "role"), f"{root}/message", ["id"])
    insert_ignore(messages.select(F.col("id").alias("message"), F.inline("parts")).select("id", "message", "text"), f"{root}/part", ["id"])


#: Fixed value: a row of a history table: a day, and numbers with their changes in brackets.
HISTORY_ROW = r"^\|\s*[\d-]+\s*(\|\s*[\d,]+\s*(\([^)]*\))?\s*)+\|$"


def append_history(spark: SparkSession, path: str, title: str, day: str, totals: dict[str, int]) -> None:
    """Appends to a Markdown table one row of totals with their change against the last row (a small file, which the driver reads and writes)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    head = f"# {title}\n\n| Date | {' | '.join(totals)} |\n|{'---|' * (len(totals) + 1)}\n"
    content = "\n".join(r.value for r in spark.read.text(path).toLocalIterator()) + "\n" if fs.exists(p) else head
    rows = [line for line in content.split("\n") if re.match(HISTORY_ROW, line.strip())]
    before = [int(re.match(r"\s*([\d,]+)", cell)[1].replace(",", "")) for cell in rows[-1].strip().strip("|").split("|")[1:]] if rows else [0] * len(totals)
    cells = [f"{now:,} ({now - then:+,})" for now, then in zip(totals.values(), before, strict=True)]
    part = jvm.org.apache.hadoop.fs.Path(path + "._new")
    out = fs.create(part, True)
    out.write(bytearray((content + f"| {day} | {' | '.join(cells)} |\n").encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(part, p, options)  # in one step, where the file system has it


def insert_ignore(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows whose key is not there yet."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys)
    if _exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Delete-then-insert of whole partitions that rows touch."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def without(path: str, spark: SparkSession, retired) -> None:
    """Scoped delete: what ``retired`` (a condition) holds for is taken out."""
    _restore(spark, path)
    _swap(spark.read.parquet(path).filter(~F.coalesce(retired, F.lit(False))), path)


def accumulate_or_reset(usage, updated, bound, cost):
    """usage + cost while last updated within the window, else the cost alone."""
    return F.when(updated >= bound, usage + cost).otherwise(cost)


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes only where a comma, a quote or a line end asks for them."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def append_routed(rows: DataFrame, root: str, batch: int) -> None:
    """One micro-batch of routed events, partitioned by target; any unroutable event fails the whole batch, and a batch that is sent again replaces itself."""
    bad = rows.filter(~F.col("ok")).limit(1).collect()
    if bad:
        raise ValueError("an event has no valid route")
    rows.select("database", "table", "payload", F.lit(batch).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("database", "table", "batch").parquet(root)


def routed_sink(root: str, rejects: str):
    """A ``foreachBatch`` function for events as ``body`` texts: routed ones are appended by target, others go to ``rejects`` as they came, each batch once."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select("body")
        rows.persist()
        try:
            split = routed(rows, "body", keep=True)
            append_routed(split.filter("ok"), root, number)
            split.filter("not ok").select("body", F.lit(number).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejects)
        finally:
            rows.unpersist()

    return run


def history_line(history: DataFrame, order: str, totals: list[str]) -> DataFrame:
    """Totals with their change against the line before."""
    from pyspark.sql import Window

    w = Window.orderBy(order)
    return history.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in totals])
