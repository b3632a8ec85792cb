"""Ranking, shares, top-k with the rest, change against a period before, running budgets, runs of equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import scratch

from quern.functions.exprs import percent_change, share


def ranks(rows: DataFrame, by: list[str], measures: list[str], ties: list[str]) -> DataFrame:
    """rank_<measure> from 1 within each partition, largest first, ties by ``ties``."""
    for m in measures:
        rows = rows.withColumn(f"rank_{m}", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(m), *ties)))
    return rows


def shares(rows: DataFrame, by: list[str], measure: str, name: str = "share") -> DataFrame:
    return rows.withColumn(name, share(F.col(measure), F.sum(measure).over(Window.partitionBy(*by))))


def top_with_other(rows: DataFrame, by: list[str], name: str, measure: str, k: int) -> DataFrame:
    """Per partition the k largest names, ranked afresh in each, and the rest as ``Other`` (dropped where zero)."""
    summed = rows.groupBy(*by, name).agg(F.sum(measure).alias(measure)).filter(F.col(measure) > 0)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(measure), name))
    label = F.when(rn <= k, F.col(name)).otherwise("Other")
    return summed.withColumn(name, label).groupBy(*by, name).agg(F.sum(measure).alias(measure))


def frozen_top_with_other(rows: DataFrame, bucket: str, name: str, measure: str, k: int) -> DataFrame:
    """Every bucket split by the same k names, the largest over all buckets, and ``Other``."""
    top = rows.groupBy(name).agg(F.sum(measure).alias("__total")).orderBy(F.desc("__total"), name).limit(k).select(F.col(name).alias("__top"))
    joined = rows.join(F.broadcast(top), rows[name] == top["__top"], "left")  # k rows
    return joined.withColumn(name, F.coalesce("__top", F.lit("Other"))).groupBy(bucket, name).agg(F.sum(measure).alias(measure))


def period_change(rows: DataFrame, keys: list[str], time: str, start, middle, end, measure: str) -> DataFrame:
    """Sums of [middle, end) and of [start, middle) in one pass, and the percent change."""
    inside = rows.filter((F.col(time) >= start) & (F.col(time) < end))
    now = F.coalesce(F.sum(F.when(F.col(time) >= middle, F.col(measure))), F.lit(0))
    before = F.coalesce(F.sum(F.when(F.col(time) < middle, F.col(measure))), F.lit(0))
    out = inside.groupBy(*keys).agg(now.alias("current"), before.alias("previous"))
    return out.filter("current > 0").withColumn("change", percent_change(F.col("current"), F.col("previous")))


def turns(rows: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """turn: how many user rows there are up to and with each row; next_start: where the next turn begins."""
    w = Window.partitionBy(key).orderBy(order)
    opened = rows.withColumn("turn_no", F.count_if(F.col(role) == "user").over(w))
    return opened.withColumn("next_start", F.min(F.when(F.col(role) == "user", F.col(order))).over(w.rowsBetween(1, Window.unboundedFollowing)))


def prune(rows: DataFrame, key: str, order: list[str], role: str, size: str, candidate: Column, stop: Column, protect: int = 40_000, least: int = 20_000, keep_turns: int = 2) -> DataFrame:
    """Old rows that may be emptied: newest to oldest, leaving the last turns and the first ``protect`` units of candidates, up to a row where ``stop`` holds; none if they come to ``least`` or less in all."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("__turns", F.count_if(F.col(role) == "user").over(upto))
    seen = seen.withColumn("__stopped", F.max((stop & (F.col("__turns") >= keep_turns)).cast("int")).over(upto))
    open_ = (F.col("__turns") >= keep_turns) & (F.coalesce("__stopped", F.lit(0)) == 0) & candidate
    seen = seen.withColumn("__open", open_).withColumn("__total", F.sum(F.when(open_, F.col(size)).otherwise(0)).over(upto))
    picked = seen.filter(F.col("__open") & (F.col("__total") > protect))
    return picked.withColumn("__pruned", F.sum(size).over(Window.partitionBy(key))).filter(F.col("__pruned") > least).drop("__turns", "__stopped", "__open", "__total", "__pruned")


def tail_within(rows: DataFrame, key: str, turn: str, order: str, size: str, budget: int) -> DataFrame:
    """The newest whole turns that fit the budget, and of the first that does not, its newest rows that still fit."""
    newest = Window.partitionBy(key).orderBy(F.desc(turn), F.desc(order))
    per_turn = F.sum(size).over(Window.partitionBy(key, turn))
    marked = rows.withColumn("__turn", per_turn).withColumn("__upto", F.sum(size).over(newest))
    whole = F.max("__upto").over(Window.partitionBy(key, turn))
    marked = marked.withColumn("__end", whole)
    first_out = F.max(F.when(F.col("__end") > budget, F.col(turn))).over(Window.partitionBy(key))
    marked = marked.withColumn("__out", first_out)
    return marked.filter((F.col("__end") <= budget) | ((F.col(turn) == F.col("__out")) & (F.col("__upto") <= budget))).drop("__turn", "__upto", "__end", "__out")


def latest(rows: DataFrame, keys: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The last row of each key by ``order``, by a partial aggregation."""
    rows = rows if where is None else rows.filter(where)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__r")).select("__r.*")


def since_last(rows: DataFrame, key: str, order: list[str], mark: Column) -> DataFrame:
    """Rows at or after the newest marked row of their key; all rows of keys without one."""
    place = F.struct(*order)
    last = F.max(F.when(mark, place)).over(Window.partitionBy(key))
    return rows.withColumn("__last", last).filter(F.col("__last").isNull() | (place >= F.col("__last"))).drop("__last")


def merge_runs(rows: DataFrame, key: str, order: str, same: list[str], text: str) -> DataFrame:
    """Neighbouring rows with equal ``same`` columns as one, their texts joined in order."""
    w = Window.partitionBy(key).orderBy(order)
    differs = ~F.struct(*same).eqNullSafe(F.lag(F.struct(*same)).over(w))
    marked = rows.withColumn("run", F.sum(F.coalesce(differs, F.lit(True)).cast("int")).over(w))
    return marked.groupBy(key, "run").agg(F.min(order).alias(order), *[F.first(c).alias(c) for c in same], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda e: e[text]), "").alias(text))


def last_k(rows: DataFrame, key: str, order: str, k: int, where: Column) -> DataFrame:
    """marked: is this one of the last k rows of its key for which ``where`` holds?"""
    rn = F.row_number().over(Window.partitionBy(key, "__w").orderBy(F.desc(order)))
    return rows.withColumn("__w", where).withColumn("marked", F.col("__w") & (rn <= k)).drop("__w")


def min_max_score(rows: DataFrame, cost: str, age: str, by: list[str] | None = None) -> DataFrame:
    """0.8 of the cost and 0.2 of the age, each against its largest; the least score comes first."""
    largest = [F.max(cost).cast("double").alias("__c"), F.max(age).cast("double").alias("__a")]
    met = rows.join(rows.groupBy(*by).agg(*largest), by) if by else rows.crossJoin(F.broadcast(rows.agg(*largest)))  # one row
    part = lambda c, m: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(m)), F.lit(0.0))
    return met.withColumn("score", part(cost, "__c") * 0.8 + part(age, "__a") * 0.2).drop("__c", "__a")


def equal_slices(time: Column, start: Column, end: Column, slices: int) -> Column:
    """Which of equal-width millisecond slices of [start, end] a time lies in; the last slice holds its end."""
    ms = lambda t: F.unix_millis(t.cast("timestamp"))
    width = (ms(end) - ms(start)) / slices
    return F.when((time >= start) & (time <= end), F.least(F.floor((ms(time) - ms(start)) / width), F.lit(slices - 1))).cast("int")


def window_rows(rows: DataFrame, time: str, tier: str, start: Column, end: Column) -> DataFrame:
    """Rows of a window for all users: the tier ``all`` where the window has any, else the sum of the others."""
    inside = rows.filter((F.col(time) >= start) & (F.col(time) < end))
    any_all = inside.agg(F.coalesce(F.max((F.col(tier) == "all").cast("int")), F.lit(0)).alias("__all"))
    return inside.crossJoin(F.broadcast(any_all)).filter((F.col("__all") == 1) == (F.col(tier) == "all")).drop("__all")  # one row


def weighted_choice(rows: DataFrame, key: str, name: str, weight: str, priority: str, number: Column) -> DataFrame:
    """One name per key: of the least priority, by weight, where ``number`` modulo the weights' sum falls."""
    live = rows.filter(F.col(weight) > 0).withColumn("__p", F.min(priority).over(Window.partitionBy(key))).filter(F.col(priority) == F.col("__p"))
    w = Window.partitionBy(key).orderBy(name)
    live = live.withColumn("__to", F.sum(weight).over(w)).withColumn("__all", F.sum(weight).over(Window.partitionBy(key)))
    at = F.pmod(number, F.col("__all"))
    return live.filter((at < F.col("__to")) & (at >= F.col("__to") - F.col(weight))).select(key, name)


def running_total(rows: DataFrame, order: list, amount, name: str = "upto") -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows up to each in a total order, without a window in one task.

    Rows are dealt by ranges of the order and written; sums run within each range, and what lies before a range is the
    sum of one number per range.
    """
    spark = rows.sparkSession
    path = scratch(spark)
    rows.withColumn("__amount", amount).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    offsets = dealt.groupBy("__range").agg(F.sum("__amount").alias("__sum")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("__amount").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = dealt.withColumn(name, inside).join(F.broadcast(offsets), "__range")  # as many rows as the shuffle has partitions
    return met.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before", "__amount")


def median(rows: DataFrame, value: str) -> DataFrame:
    """(median, n): the exact median of a column, the mean of the two middle values of an even number; null for no values."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    ranked = running_total(counted, [F.col(value)], F.col("__n"))
    n = ranked.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))
    middle = lambda at: F.min(F.when(F.col("upto") >= at, F.col(value)))
    both = ranked.crossJoin(F.broadcast(n))  # one row
    return both.agg(((middle(F.floor((F.col("n") + 1) / 2)) + middle(F.floor(F.col("n") / 2) + 1)) / 2).alias("median"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
