"""Pages of ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import scratch


def keyset(rows: DataFrame, time: str, ident: str, limit: int, before: tuple | None = None, newest_first: bool = True) -> DataFrame:
    """The rows next to a (time, id) position, which is not included."""
    t, i = F.col(time), F.col(ident)
    if before is not None:
        at, name = before
        rows = rows.filter((t < at) | ((t == at) & (i < name))) if newest_first else rows.filter((t > at) | ((t == at) & (i > name)))
    order = [F.desc(time), F.desc(ident)] if newest_first else [time, ident]
    return rows.orderBy(*order).limit(limit)


def has_more(rows: DataFrame, time: str, ident: str, limit: int, before: tuple | None = None) -> tuple[list, bool]:
    """One page's rows and whether there are more, from one row beyond the page."""
    got = keyset(rows, time, ident, limit + 1, before).collect()
    return got[:limit], len(got) > limit


def page_with_more(rows: DataFrame, time: str, ident: str, limit: int, before: tuple | None = None) -> DataFrame:
    """One page, each of its rows with ``has_more``: is there a row beyond the page?"""
    page = keyset(rows, time, ident, limit + 1, before)
    place = F.row_number().over(Window.orderBy(F.desc(time), F.desc(ident)))  # of a page's rows
    return page.withColumn("__place", place).withColumn("has_more", F.max("__place").over(Window.partitionBy(F.lit(1))) > limit).filter(F.col("__place") <= limit).drop("__place")


def newest(rows: DataFrame, modified: str, order: list, limit: int = 100) -> DataFrame:
    """The rows modified last, each with the ``total`` of all rows, which are computed once and written in between."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc(modified), *order).limit(limit).crossJoin(F.broadcast(total))  # one row


def offset_page(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(page * size).limit(size)


def stream_rows(rows: DataFrame):
    """All rows in order, a partition at a time."""
    return rows.toLocalIterator(prefetchPartitions=True)
