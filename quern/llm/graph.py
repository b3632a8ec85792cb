"""Distributed connected components: alternating large-star and small-star steps over an edge table.

Each step is a partial aggregation (the least neighbour of every node) and a join, so a node with very many neighbours
is one row per task before the shuffle.  Its edges do not meet in one task either: the nodes with more neighbours than
``HUB`` and than the ``MOST``-th part of all edges' ends are at most ``MOST``, and reach their edges by a broadcast.
Steps are written into the shared folder, which keeps plans short and survives lost executors; a step that the next one
has replaced is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import store


HUB, MOST = 1000, 10_000


def _ends(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends; ``up`` where u is its greater one."""
    end = lambda u, v, up: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(up).alias("up"))
    return edges.select(F.inline(F.array(end("a", "b", False), end("b", "a", True))))


def _step(edges: DataFrame, large: bool, most: int | None) -> DataFrame:
    """One star step over edges (a, b) with a < b; nodes with more than ``most`` neighbours, if any, are broadcast."""
    near = _ends(edges).select("u", "v") if large else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = near.groupBy("u").agg((F.least(F.min("v"), F.col("u")) if large else F.min("v")).alias("m"), F.count("*").alias("d"))
    if most is None:
        met = near.join(least.drop("d"), "u")
    else:
        hubs, others = least.filter(F.col("d") > most).drop("d"), least.filter(F.col("d") <= most).drop("d")
        flagged = near.join(F.broadcast(hubs), "u", "left")
        met = flagged.filter("m is not null").union(flagged.filter("m is null").drop("m").join(others, "u").select("u", "v", "m"))
    if large:
        moved = met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = met.select(F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))))
    return moved.filter("a < b").distinct()


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """(ends, most neighbours of a node, nodes that are not yet at rest): edges are stars when no node has two lesser neighbours, or a lesser and a greater one."""
    per = _ends(edges).groupBy("u").agg(F.count("*").alias("d"), F.count_if("up").alias("lesser"))
    busy = (F.col("lesser") > 1) | ((F.col("lesser") == 1) & (F.col("d") > 1))
    return tuple(x or 0 for x in per.agg(F.sum("d"), F.max("d"), F.count_if(busy)).first())


def components(edges: DataFrame, owner: str = "") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that it is connected with.

    Self-loops and nulls are ignored; an empty edge table gives an empty result.
    """
    spark, step, own = edges.sparkSession, 0, uuid.uuid4().hex
    edges = store.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges", f"{own}-0")
    ends, most, busy = _state(edges)
    while busy:
        bound = max(HUB, ends // MOST)
        bound = bound if most > bound else None
        edges = store.table(_step(_step(edges, True, bound), False, bound), "star", f"{own}-{step + 1}")
        store.release(spark, f"{own}-{step}")  # what the written step was made from
        step += 1
        ends, most, busy = _state(edges)
    store.keep(f"{own}-{step}", owner)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a"), F.col("a")).distinct())
