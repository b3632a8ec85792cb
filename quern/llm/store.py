"""Intermediate tables in the folder that the driver and all executors share.

A table written here survives the loss of executors: a later stage re-reads files instead of asking for shuffle
blocks that may be gone.  The folder is ``spark.checkpoint.dir``; where that is unset, a local session gets a
temporary folder, and any other an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.session import shared_base

#: Folders made so far by owner, so that a pipeline can drop what its finished stages left.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    base = shared_base(spark)
    fs, path = _fs(spark, base)
    return str(fs.makeQualified(path).toString()).rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, label: str, owner: str = "") -> str:
    """A fresh path in the shared folder, deleted when the driver ends, or by :func:`release`."""
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}-{label}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    _made.setdefault(owner, []).append(path)
    return path


def table(df: DataFrame, label: str, owner: str = "") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: it is computed once and its lineage is cut."""
    spark = df.sparkSession
    path = new_path(spark, label, owner)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, owner: str = "") -> None:
    """Delete the tables of ``owner``.  Only for callers that have written all results that read them."""
    for path in _made.pop(owner, []):
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def keep(owner: str, new_owner: str) -> None:
    """Hand the tables of ``owner`` over to another one."""
    _made.setdefault(new_owner, []).extend(_made.pop(owner, []))
