"""Joins with more than a plain key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import scratch


def hydrate(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: str, name: str = "parts") -> DataFrame:
    """Each parent with the ordered list of its children (empty without any)."""
    cols = [c for c in children.columns if c not in (child_key, order)]
    nested = children.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias(name))
    out = parents.join(nested, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def enrich(rows: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from the lookup's largest non-empty value of the key, else the row's own."""
    best = lookup.groupBy(key).agg(F.max(F.nullif(F.col(column), F.lit(""))).alias("__best"))
    return rows.join(best, key, "left").withColumn(column, F.coalesce("__best", column)).drop("__best")


def dense(rows: DataFrame, keys: DataFrame, steps: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Every key at every step, with ``fill`` where there is no row.  ``steps`` is a generated list (minutes, days)."""
    return keys.crossJoin(F.broadcast(steps)).join(rows, on, "left").fillna(fill)


def days(spark, first: str, last: str, name: str = "day") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(name))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of rows that are new, changed or gone."""
    cols = [c for c in before.columns if c != key]
    a = before.select(F.col(key).alias("__k"), F.struct(*cols).alias("__a"))
    b = after.select(key, F.struct(*cols).alias("__b"))
    met = a.join(b, a["__k"] == b[key], "full")
    kind = F.when(F.col("__k").isNull(), "new").when(F.col(key).isNull(), "gone").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return met.select(F.coalesce("__k", key).alias(key), kind.alias("change")).filter("change is not null")


def after_clock(events: DataFrame, clock: DataFrame, key: str, seq: str) -> DataFrame:
    """Events that a vector clock (key, seq) has not seen."""
    c = clock.select(F.col(key).alias("__k"), F.col(seq).alias("__s"))
    return events.join(c, events[key] == c["__k"], "left").filter(F.col("__s").isNull() | (F.col(seq) > F.col("__s"))).drop("__k", "__s")


def copy_with_ids(rows: DataFrame, ident: str, references: list[str], new_id: Column) -> DataFrame:
    """Rows under new ids, with references to one another rewritten; references to others become null."""
    mapping = rows.select(F.col(ident).alias("__old"), new_id.alias("__new"))
    out = rows
    for c in (ident, *references):
        m = mapping.select(F.col("__old").alias(f"__o_{c}"), F.col("__new").alias(f"__n_{c}"))
        out = out.join(m, out[c] == m[f"__o_{c}"], "left").withColumn(c, F.col(f"__n_{c}")).drop(f"__o_{c}", f"__n_{c}")
    return out


def descendants(spark, rows: DataFrame, ident: str, parent: str, root) -> DataFrame:
    """(ident, depth) of a node and all below it, however deep and many, by pointer doubling.

    After k rounds every node points 2**k steps up, or to ``root`` with the number of steps to it where that is nearer; so a
    depth of d takes log d rounds, each written before the next one.  Nodes whose way up ends elsewhere drop out when
    they reach its end; those on a ring, or below one, never reach ``root`` nor an end, and go when as many steps have
    been taken as there are nodes.  A ring through ``root`` ends where it began.  Of rows that repeat an id each
    way counts, and the shortest one gives the depth.
    """
    tree = rows.select(F.col(ident).alias("id"), F.col(parent).alias("up")).filter("id is not null").distinct()
    start = tree.filter(F.col("id") == root).select("id").distinct().withColumn("depth", F.lit(0))
    if start.isEmpty():
        return start
    path, step, far = scratch(spark), 0, 1
    ways = tree.filter((F.col("id") != root) & F.col("up").isNotNull()).withColumn("steps", F.lit(1))
    while True:
        ways.write.parquet(f"{path}/{step}")
        ways = spark.read.schema(ways.schema).parquet(f"{path}/{step}")
        arrived, going = ways.filter(F.col("up") == root), ways.filter(F.col("up") != root)
        left = going.count()
        if not left or far > left + arrived.count():
            break
        above = ways.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        on = going.join(above, "up").select("id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        ways = arrived.union(on).groupBy("id", "up").agg(F.min("steps").alias("steps"))
        step, far = step + 1, far * 2
    return start.union(arrived.groupBy("id").agg(F.min("steps").alias("depth")))


def first_wins(*frames: DataFrame, key: str) -> DataFrame:
    """The union by key in which earlier frames take precedence."""
    from functools import reduce

    numbered = [f.withColumn("__ord", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b), numbered)
    cols = [c for c in frames[0].columns]
    return both.groupBy(key).agg(F.min_by(F.struct(*cols), "__ord").alias("__r")).select("__r.*")


def directory_counts(paths: DataFrame, path: str) -> DataFrame:
    """(directory, depth, files) for every directory above a file."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("directory"), i.alias("depth")))
    return paths.filter(F.size(parts) > 1).select(path, F.inline(above)).groupBy("directory", "depth").agg(F.countDistinct(path).alias("files"))
