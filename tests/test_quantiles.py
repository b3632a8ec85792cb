"""Quantiles are those of the SQL in groups of any size."""

import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from quern.operators import aggregate, alerts


def lowest(values, p):
    return sorted(values)[max(math.ceil(Decimal(str(p)) * len(values)), 1) - 1]


def test_quantiles_of_large_groups_are_exact(spark):
    """Groups beyond what a sketch holds, one with very many repeats, one without values, one under a null key."""
    groups = {"wide": 120_000, "same": 30_000, None: 7, "none": 5}
    value = F.when(F.col("g") == "wide", F.xxhash64("i") % 1_000_003).when(F.col("g") == "same", F.when(F.col("i") < 29_000, 3).otherwise(F.col("i"))).when(F.col("g").isNull(), F.col("i"))
    every = spark.createDataFrame(list(groups.items()), "g string, n int").select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i")).withColumn("v", value.cast("long")).repartition(7, "i")
    wanted = {"half": ("v", 0.5), "most": ("v", 0.95), "least": ("v", 0.0), "all": ("v", 1.0), "second": ("w", 0.5)}
    got = {r.g: tuple(r)[1:] for r in aggregate.quantiles(every.withColumn("w", F.col("v") / 2), ["g"], wanted).collect()}
    by = {}
    for r in every.filter("v is not null").collect():
        by.setdefault(r.g, []).append(r.v)
    assert got == {g: (lowest(v, 0.5), lowest(v, 0.95), min(v), max(v), lowest(v, 0.5) / 2) for g, v in by.items()} | {"none": (None,) * 5}


def test_aggregates_alerts_and_specs_take_exact_quantiles(spark):
    random.seed(5)
    values = [random.randrange(10**6) for _ in range(60_000)]
    rows = spark.createDataFrame([(v,) for v in values], "duration long").select("duration", F.lit("s").alias("session"), F.lit(200).alias("status"), F.lit("Go").alias("tier"), F.lit("m").alias("model"), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz").alias("time"))
    want = lowest(values, 0.5), lowest(values, 0.95)
    got = aggregate.aggregate(rows, ["model"])
    assert {(r.p50_duration, r.p95_duration, r.p50_ttfb) for r in got.collect()} == {(*want, None)} and got.count() == 2
    spec = [("COUNT", None), ("P50", "duration"), ("P95", "duration")]
    assert [tuple(r) for r in aggregate.from_spec(rows, ["model"], spec).collect()] == [("m", 60_000, *want)]
    assert [tuple(r) for r in aggregate.from_spec(rows, [], spec).collect()] == [(60_000, *want)]
    assert alerts.low_median(rows, "model", "duration", F.lit(True), 20, 0.0).first().p50 == want[0]
