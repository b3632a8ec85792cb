"""Threshold alerts: one grouping with filtered aggregates, a gated formula, a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.aggregate import beside, quantiles


def ratio(rows: DataFrame, by: str, total: Column, failed: Column, least: int, threshold: float) -> DataFrame:
    """(by, total, failed, ratio in millionths, triggered); groups under ``least`` rows have ratio 0."""
    out = rows.groupBy(by).agg(F.count_if(total).alias("total"), F.count_if(failed).alias("failed"))
    part = F.when(F.col("total") >= least, F.floor(F.col("failed") * 1_000_000 / F.col("total"))).otherwise(0).cast("long")
    return out.withColumn("ratio_ppm", part).withColumn("triggered", part >= int(threshold * 1_000_000))


def two_source_ratio(rows: DataFrame, by: str, succeeded: Column, failed: Column, least: int, threshold: float) -> DataFrame:
    """:func:`ratio` where successes and failures come as different events: their sum is the denominator."""
    return ratio(rows, by, succeeded | failed, failed, least, threshold)


def low_median(rows: DataFrame, by: str, value: str, where: Column, least: int, threshold: float, idle: float = 999.0) -> DataFrame:
    """(by, n, p50, triggered): the lower median of a value, ``idle`` for groups with too few rows."""
    kept = rows.filter(where & F.col(value).isNotNull())
    kept = kept.select(by, F.col(value).cast("double").alias("__v"))
    out = kept.groupBy(by).agg(F.count("*").alias("n"))
    out = beside(out, quantiles(kept, [by], {"median": ("__v", 0.5)}), [by], "left")
    return out.select(by, "n", F.when(F.col("n") >= least, F.col("median")).otherwise(idle).alias("p50")).withColumn("triggered", F.col("p50") <= threshold)


def against_baseline(rows: DataFrame, time: str, by: str, now: Column, seconds: int = 3600, minutes_back: int = 1440, percent: int = 50) -> DataFrame:
    """(by, current, baseline, triggered): rows of the trailing window and of the same window some minutes earlier."""
    age = now.cast("timestamp").cast("long") - F.col(time).cast("timestamp").cast("long")
    back = minutes_back * 60
    inside = lambda a: (age >= a) & (age < a + seconds)
    out = rows.filter((age >= 0) & (age < back + seconds)).groupBy(by).agg(F.count_if(inside(0)).alias("current"), F.count_if(inside(back)).alias("baseline"))
    return out.withColumn("triggered", (F.col("current") - F.col("baseline")) * 100 >= F.col("baseline") * percent)


def payload(fired: DataFrame, by: str, value: str, unit: str = "%") -> DataFrame:
    """One line of text for each group that fired."""
    return fired.filter("triggered").select(by, F.format_string("%s: %d" + unit.replace("%", "%%"), F.col(by).cast("string"), F.floor(F.col(value) + 0.5).cast("long")).alias("line"))


def vote(current: Column, previous: Column, least: int = 10) -> Column:
    """low where few requests of many (more than ``least``) were qualified over two minutes; idle where there is no sign of trouble."""
    return F.when((current + previous > least) & (current < previous), "low").when(current <= previous * 3, "idle").otherwise("busy")
