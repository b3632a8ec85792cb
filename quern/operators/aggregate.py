"""Usage aggregates: measures by any dimensions at day and ISO-week grain, collapsing, the all-tier rollup.

A usage row has: time, session, status, duration, ttfb, tps, input/output/reasoning/cache tokens, costs in microcents,
tier, and dimension columns.  Measures that a frame lacks are taken as null.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.exprs import day_key, iso_week_key
from quern.session import scratch

SUMS = ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "total_tokens", "input_cost", "output_cost", "total_cost")
LEVELS = ("avg_duration", "avg_ttfb", "avg_tps")
QUANTILES = {"p50_duration": ("duration", 0.5), "p95_duration": ("duration", 0.95), "p50_ttfb": ("ttfb", 0.5), "p95_ttfb": ("ttfb", 0.95)}


#: A sketch places a value at most one in so many rows off its rank.
SKETCH = 10_000
#: Groups up to which their bounds are sent to all tasks.
FEW = 100_000


def beside(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """``left`` with the other columns of ``right``, which has at most one row for equal keys; null keys are equal."""
    named = right.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(by)})
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]
    return left.join(named, reduce(lambda a, b: a & b, same, F.lit(True)), how).drop(*[f"__k{i}" for i in range(len(by))])


def quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Per group the exact quantiles that ``wanted`` names by (column, part): the least value that so large a part of the values is at or below; null for no values.

    A mergeable sketch gives two values that a quantile lies between.  Values between them (at most some 8 in ``SKETCH`` of a group,
    repeats apart) are then counted one by one and those below by their number, so that no group meets in one row or task.
    """
    spark, path, off = rows.sparkSession, scratch(rows.sparkSession), Decimal(4) / SKETCH
    parts = {name: Decimal(str(p)) for name, (_, p) in wanted.items()}
    value = {c: F.col(c).cast("double") for c, _ in wanted.values()}
    low = {n: F.percentile_approx(value[c], [float(max(parts[n] - off, Decimal(0))), float(min(parts[n] + off, Decimal(1)))], SKETCH).alias(f"__b{i}") for i, (n, (c, _)) in enumerate(wanted.items())}
    rank = {n: F.greatest(F.ceil(F.count(c) * F.lit(parts[n])), F.lit(1)).cast("long").alias(f"__r{i}") for i, (n, (c, _)) in enumerate(wanted.items())}
    rows.groupBy(*by).agg(*low.values(), *rank.values()).write.parquet(path)
    bounds = spark.read.parquet(path)
    met = beside(rows.select(*by, *value), F.broadcast(bounds) if bounds.count() <= FEW else bounds, by, "inner")  # a row per group, if they are few
    out = bounds.select(*by)
    for kind in {rows.schema[c].dataType.simpleString() for c, _ in wanted.values()}:
        own = [(i, n, c) for i, (n, (c, _)) in enumerate(wanted.items()) if rows.schema[c].dataType.simpleString() == kind]
        near = [F.when(value[c] <= F.col(f"__b{i}")[1], F.struct(F.lit(i).alias("__q"), F.when(value[c] >= F.col(f"__b{i}")[0], F.col(c)).alias("__v"), F.col(f"__r{i}").alias("__rank"))) for i, _, c in own]
        counted = met.select(*by, F.inline(F.array_compact(F.array(*near)))).groupBy(*by, "__q", "__rank", "__v").agg(F.count("*").alias("__n"))
        upto = counted.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by, "__q").orderBy(F.asc_nulls_first("__v"))))
        reached = F.col("__upto") >= F.col("__rank")
        outside = F.raise_error(F.lit("a quantile outside its bounds")).cast(kind)
        least = F.when(reached & F.col("__v").isNull(), outside).when(reached, F.col("__v"))
        of = lambda i, x: F.when(F.col("__q") == i, x)
        picked = upto.groupBy(*by).agg(*[F.when(F.max(of(i, F.col("__upto"))) < F.max(of(i, F.col("__rank"))), outside).otherwise(F.min(of(i, least))).alias(n) for i, n, _ in own])
        out = beside(out, picked, by, "left")
    return out.select(*by, *[F.col(f"`{n}`") for n in wanted])


def measures(columns: list[str]) -> list[Column]:
    """The aggregate list but for quantiles."""
    has = lambda c: F.col(c) if c in columns else F.lit(None).cast("double")
    out = [F.countDistinct("session").alias("sessions"), F.count("*").alias("requests")]
    out += [F.coalesce(F.sum(has(c)), F.lit(0)).cast("long").alias(c) for c in SUMS]
    out += [F.avg(has(c)).alias(f"avg_{c}") for c in ("duration", "ttfb", "tps")]
    status = has("status")
    return [*out, F.count_if((status >= 200) & (status < 400)).alias("success_count"), F.count_if(status >= 400).alias("error_count"), F.count("*").alias("sample_count")]


def representative(c: str) -> Column:
    """One non-empty value of a column, the largest; empty if there is none."""
    return F.coalesce(F.max(F.nullif(F.col(c), F.lit(""))), F.lit("")).alias(c)


def two_grains(rows: DataFrame, time: str) -> DataFrame:
    """Each row under its day and its ISO week, so that both grains come from one scan and one grouping."""
    grains = F.array(F.struct(F.lit("week").alias("grain"), iso_week_key(F.col(time)).alias("period_key")), F.struct(F.lit("day").alias("grain"), day_key(F.col(time)).alias("period_key")))
    return rows.select("*", F.inline(grains))


def aggregate(rows: DataFrame, dims: list[str], time: str = "time", also: tuple[str, ...] = (), ranked: tuple[str, ...] = tuple(QUANTILES)) -> DataFrame:
    """Measures by grain, period, tier and ``dims``; of the columns ``also`` one non-empty value each.  Of ``QUANTILES`` those in ``ranked`` are found, others are null."""
    keys, grained = ["grain", "period_key", "tier", *dims], two_grains(rows, time)
    out = grained.groupBy(*keys).agg(*map(representative, also), *measures(rows.columns))
    wanted = {k: QUANTILES[k] for k in ranked if QUANTILES[k][0] in rows.columns}
    if wanted:
        doubles = grained.select(*keys, *[F.col(c).cast("double").alias(c) for c in {c for c, _ in wanted.values()}])
        out = beside(out, quantiles(doubles, keys, wanted), keys, "left")
    shown = [F.col(k) if k in wanted else F.lit(None).cast("double").alias(k) for k in QUANTILES]
    at = out.columns.index("success_count")
    return out.select(*out.columns[:at], *shown, *["success_count", "error_count", "sample_count"])


#: Breakdowns: the dimensions of each, and the columns of which it keeps one value.
BREAKDOWNS = {"model": (["provider", "model"], ("provider_model",)), "provider": (["provider"], ()), "geo": (["country"], ("continent",)), "geo_model": (["provider", "model", "country"], ("continent",))}


def breakdown(rows: DataFrame, kind: str, time: str = "time", ranked: tuple[str, ...] = tuple(QUANTILES)) -> DataFrame:
    """One of the ``BREAKDOWNS``; by country alone, provider and model are ``all``."""
    dims, also = BREAKDOWNS[kind]
    out = aggregate(rows, dims, time, also, ranked)
    return out.withColumns({"provider": F.lit("all"), "model": F.lit("all")}) if kind == "geo" else out


def from_spec(rows: DataFrame, by: list[str], calculations: list[tuple[str, str | None]], limit: int = 1000) -> DataFrame:
    """Aggregates named by a list of (op, column): COUNT, COUNT_DISTINCT, SUM, AVG, P50 or P95; the greatest first sum leads, so many rows at most."""
    ops = {"COUNT": lambda _: F.count("*"), "COUNT_DISTINCT": F.countDistinct, "SUM": F.sum, "AVG": F.avg}
    parts = {"P50": 0.5, "P95": 0.95}
    named = [f"{op}({column})" if column else op for op, column in calculations]
    plain = [ops[op](column).alias(name) for name, (op, column) in zip(named, calculations, strict=True) if op in ops]
    wanted = {name: (column, parts[op]) for name, (op, column) in zip(named, calculations, strict=True) if op in parts}
    out = rows.groupBy(*by).agg(*(plain or [F.count("*").alias("__n")]))
    if wanted:
        out = beside(out, quantiles(rows, by, wanted), by, "left")
    order = next((F.desc(f"`{name}`") for name in named if name.startswith("SUM(")), F.desc(f"`{named[0]}`"))
    return out.select(*by, *[F.col(f"`{name}`") for name in named]).orderBy(order, *by).limit(limit)


def by_country(rows: DataFrame, country: str, continent: str, measure: str) -> DataFrame:
    """(country, continent, measure): sums, with the first non-empty continent in its own order."""
    return rows.groupBy(country).agg(F.coalesce(F.min(F.nullif(F.col(continent), F.lit(""))), F.lit("")).alias(continent), F.sum(measure).alias(measure))


def weighted(level: str, weight: str, places: int = 2) -> Column:
    """The mean of ``level`` by ``weight``; rows without a level weigh nothing; rounded once."""
    known = F.when(F.col(level).isNotNull(), F.col(weight))
    return F.round(F.try_divide(F.sum(F.col(level) * F.col(weight)), F.nullif(F.sum(known), F.lit(0))), places)


def collapse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys as one: sums add, levels are re-weighted by requests, quantiles stay only where one row is alone."""
    have = rows.columns
    counts = [c for c in ("sessions", "requests", *SUMS, "success_count", "error_count", "sample_count") if c in have]
    one = F.count("*") == 1
    aggs = [F.sum(c).cast("long").alias(c) for c in counts]
    aggs += [F.when(one, F.max(c)).otherwise(weighted(c, "requests")).alias(c) for c in LEVELS if c in have]
    aggs += [F.when(one, F.max(c)).alias(c) for c in QUANTILES if c in have]
    return rows.groupBy(*keys).agg(*aggs)


def with_all_tier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows and, for each key without tier, their collapse as tier ``all``.  Sessions of several tiers count in each."""
    return rows.unionByName(collapse(rows, keys).withColumn("tier", F.lit("all")), allowMissingColumns=True)


def ordered_fold(values: Column, weights: Column, places: int = 2) -> Column:
    """The weighted mean of arrays folded from left to right with rounding at each step, for exact parity with such folds."""
    pairs = F.arrays_zip(values.alias("v"), weights.alias("w"))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).cast("double").alias("w"))

    def step(a, e):
        total = F.when(a["v"].isNotNull(), a["w"]).otherwise(0.0) + F.when(e["v"].isNotNull(), e["w"]).otherwise(0.0)
        mean = F.round(F.try_divide(F.coalesce(a["v"] * a["w"], F.lit(0.0)) + F.coalesce(e["v"] * e["w"], F.lit(0.0)), F.nullif(total, F.lit(0.0))), places)
        return F.struct(mean.cast("double").alias("v"), (a["w"] + e["w"]).cast("double").alias("w"))

    return F.aggregate(pairs, start, step)["v"]


def with_total(rows: DataFrame, label: str, name: str = "TOTAL", sums: list[str] | None = None) -> DataFrame:
    """The rows and one grand-total row; no total for no rows."""
    sums = sums or [c for c in rows.columns if c != label]
    total = rows.agg(F.count("*").alias("__n"), *[F.sum(c).alias(c) for c in sums]).filter("__n > 0").select(F.lit(name).alias(label), *sums)
    return rows.select(label, *sums).union(total)


def as_map(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Per key a sorted list of (name, value) and its map form's input."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("entries"))


def score_pivot(rows: DataFrame, ident: str, result: str, newest: str, limit: int = 100) -> DataFrame:
    """(ident, average, task, score) of the newest submissions, from nested JSON with any set of tasks."""
    schema = "averageScore double, tasks array<struct<averageScore: double, task: struct<id: string>>>"
    top = rows.orderBy(F.desc(newest), ident).limit(limit)
    parsed = top.select(ident, F.from_json(result, schema).alias("r"))
    return parsed.select(ident, F.col("r.averageScore").alias("average"), F.inline(F.transform("r.tasks", lambda t: F.struct(t["task"]["id"].alias("task"), t["averageScore"].alias("score")))))
