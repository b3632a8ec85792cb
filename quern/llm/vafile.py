"""Exact top-k search with vector-approximation files.

1. Vectors are dealt into blocks by a hash of the row, and each block is quantised by its own grid, ``BITS`` bits a
   dimension: the cell file, one row per block, is written into the shared folder, an eighth the size of the vectors.
2. Queries are dealt into groups, and each group scans the cells only.  A cell bounds its vector's inner product with
   a query from both sides, by one matrix product for the cells' lower corners and a width that depends on the query
   alone.  A run of blocks gives those candidates whose upper bound reaches its own k-th largest lower bound.
3. The k-th largest lower bound over all blocks is a first threshold for each query.  Of what reaches it, the
   ``FIRST * k`` highest upper bounds have their exact vectors read by row number and scored; then, in a second round,
   all whose upper bound reaches the k-th exact score so far.  No other can be among the k best.

A scanning task holds a group of queries and a run of cell blocks, both bounded by their components; query groups meet
every block, which is the stated query set against all rows in blocks.  Equal vectors are spread by the hash.  Vectors
that are null, or hold null or non-finite components, and rows without an id take no part; vectors of different length
are not comparable.  Rows that repeat an id are candidates of their own (only a query's own row is left out).  Ties go
to the smaller id, and among rows of one id to any.  Other columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import store

BITS = 5
#: Vector components in a block of cells and in a group of queries, and blocks that a task scans at most.
BLOCK, GROUP, RUN = 1 << 20, 1 << 18, 8
#: Queries whose bounds a task has at once.
ROWS = 256
#: Times k candidates that are scored in the first round.
FIRST = 4
SCALE = 256


def _matrix(values: pa.ChunkedArray, width: int) -> np.ndarray:
    return values.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, step, cells): each component lies in [low + cell * step, low + cell * step + step - 1]."""
    low = vectors.min(axis=0)
    step = ((vectors.max(axis=0) - low) >> BITS) + 1
    return low, step, ((vectors - low) // step).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's inner product with each cell's vector."""
    q, low, step = queries.astype(np.float64), low.astype(np.float64), step.astype(np.float64)
    corner = (q * step) @ cells.T.astype(np.float64) + (q @ low)[:, None]
    rounding = 4e-16 * (q.shape[1] + 8) * (np.abs(q) @ (np.abs(low) + step * (1 << BITS)))  # of the sums above
    more = np.maximum(q, 0) @ (step - 1) + rounding
    less = np.minimum(q, 0) @ (step - 1) - rounding
    return corner + less[:, None], corner + more[:, None]


def _quantised(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
    """One row of the cell file."""
    width = key[1].as_py()
    low, step, cells = quantise(_matrix(block.column("v"), width))
    rows = block.column("row").to_numpy()
    kinds = {"block": pa.int64(), "w": pa.int32(), "rows": pa.binary(), "low": pa.binary(), "step": pa.binary(), "cells": pa.binary()}
    cols = [key[0].as_py(), width, rows.tobytes(), low.tobytes(), step.tobytes(), cells.tobytes()]
    return pa.table([pa.array([x], kind) for x, kind in zip(cols, kinds.values(), strict=True)], list(kinds))


def _scan(k: int):
    def run(key, q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        width = key[2].as_py()
        if len(q):
            queries, asking = _matrix(q.column("v"), width), q.column("row").to_numpy()
            blocks = []
            for raw in c.to_pylist():
                rows, low, step = (np.frombuffer(raw[x], np.int64) for x in ("rows", "low", "step"))
                blocks.append((rows, np.argsort(rows), low, step, np.frombuffer(raw["cells"], np.uint8).reshape(-1, width)))
            for at in range(0, len(queries), ROWS):
                mine, seen = asking[at : at + ROWS], []
                best = np.full((len(mine), k), -np.inf)  # each query's k largest lower bounds over the blocks so far
                for rows, order, low, step, cells in blocks:
                    bottom, top = bounds(queries[at : at + ROWS], low, step, cells)
                    place = order[np.minimum(np.searchsorted(rows, mine, sorter=order), len(rows) - 1)]
                    own = np.flatnonzero(rows[place] == mine)
                    top[own, place[own]] = bottom[own, place[own]] = -np.inf
                    high = np.partition(bottom, -k, axis=1)[:, -k:] if len(rows) > k else bottom
                    best = np.partition(np.concatenate([best, high], axis=1), -k, axis=1)[:, -k:]
                    who, what = np.nonzero((top >= best.min(axis=1)[:, None]) & (top > -np.inf))
                    seen.append((who, rows[what], bottom[who, what], top[who, what]))
                who, what, bottom, top = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
                reach = top >= best.min(axis=1)[who]
                out.append((mine[who[reach]], what[reach], bottom[reach], top[reach]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table([pa.array(x) for x in cols], ["query_row", "row", "bottom", "top"])

    return run


def search(vectors: DataFrame, is_query, ident: str = "vec_id", vector: str = "embedding", k: int = 5, owner: str = "") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of floor(256 x) for each row where ``is_query`` holds, ties to the smaller id."""
    x = F.col(vector)
    fine = F.col(ident).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    part = vectors.filter(F.coalesce(fine, F.lit(False)))
    part = part.select(F.col(ident).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    part = store.table(part.withColumn("w", F.size("v")), "vectors", owner)
    total, asking = part.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asks"), F.col("w"))), F.lit(0))).first()
    blocks, groups = max(1, -(-total // BLOCK)), max(1, -(-asking // GROUP))
    runs = max(1, -(-blocks // max(1, min(RUN, blocks // 64))))

    dealt = part.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)))
    kind = "block long, w int, rows binary, low binary, step binary, cells binary"
    file = store.table(dealt.groupBy("block", "w").applyInArrow(_quantised, kind), "cells", owner)

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = part.filter("asks").withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).withColumn("r", every(runs)).select("r", "g", "w", "row", "v")
    c = file.withColumn("r", F.pmod("block", F.lit(runs))).withColumn("g", every(groups))
    met = q.groupBy("r", "g", "w").cogroup(c.groupBy("r", "g", "w")).applyInArrow(_scan(k), "query_row long, row long, bottom double, top double")
    met = store.table(met, "bounds", owner)

    best = lambda df, by, n: df.withColumn("place", F.row_number().over(Window.partitionBy("query_row").orderBy(*by))).filter(F.col("place") <= n)
    kth = lambda df, by, c: best(df, by, k).groupBy("query_row").agg(F.when(F.count("*") == k, F.min(c)).alias("kth"))
    reach = lambda df, least: df.join(least, "query_row").filter(F.col("kth").isNull() | (F.col("top") >= F.col("kth"))).drop("kth")
    left = reach(met, kth(met, [F.desc("bottom")], "bottom"))
    left = store.table(left.withColumn("place", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("top"), "row"))), "left", owner)

    asked = part.filter("asks").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    product = F.expr("aggregate(zip_with(q, v, (a, b) -> a * b), 0L, (s, p) -> s + p)").alias("score")
    exact = lambda df: df.select("query_row", "row").join(part.select("row", F.col("id").alias("vec_id"), "v"), "row").join(asked, "query_row").select("query_row", "query_id", "vec_id", product)
    first = store.table(exact(left.filter(F.col("place") <= FIRST * k)), "first", owner)
    second = exact(reach(left.filter(F.col("place") > FIRST * k), kth(first, [F.desc("score")], "score")))
    ranked = best(first.union(second), [F.desc("score"), "vec_id"], k)
    return ranked.select("query_id", F.col("place").alias("rank"), "vec_id", "score")
