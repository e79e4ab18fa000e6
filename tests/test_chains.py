"""Cooldown chains in slices against a walk of each key."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.times import slot
from tidewatch.plans import chains

ROWS = "remote string, port int, ts long, ttl long, id string, more string"


def walked(rows):
    """Accepted rows of (remote, port), one after the other."""
    free, out = {}, set()
    for remote, port, ts, ttl, row_id, _ in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[2], r[4])):
        if ts >= free.get((remote, port), ts):
            free[remote, port] = ts + ttl
            out.add((remote, port, ts, row_id, ts + ttl))
    return out


def many(n, spread, ttls, seed):
    rng = random.Random(seed)
    remote = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
    rows = [(remote(), rng.choice([1, 2]), rng.randrange(-spread // 10, spread) if rng.random() < 0.98 else None, rng.choice(ttls), f"i{k:05d}", "x") for k in range(n)]
    return rows + [(*r[:4], f"z{k}", r[5]) for k, r in enumerate(rows[:30])]


@pytest.mark.parametrize("spread,ttls,width", [
    (10_000, [1, 7, 50], 100), (10_000, [300], 100), (10_000, [2500, 9], 100), (10_000, [40], 10**9), (500, [1, 2], 10), (10**6, [5, 4000], 1000),
])
def test_accepted_rows(spark, spread, ttls, width):
    rows = many(2000, spread, ttls, spread + width)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a slice spans batches
    try:
        got = chains.accepted_rows(df, ["remote", "port"], "ts", "ttl", "id", width).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["remote"], r["port"], r["ts"], r["id"], r["until"]) for r in got} == walked(rows) and len(got) == len(walked(rows))


def test_no_rows(spark):
    df = spark.createDataFrame([], ROWS)
    assert chains.accepted_rows(df, ["remote"], "ts", "ttl", "id").count() == 0


def test_a_hot_key_is_spread_over_tasks(spark):
    rows = many(6000, 100_000, [30, 200], 1)
    nodes = spark.createDataFrame(rows, ROWS).dropna(subset=["remote", "ts"]).select(
        "remote", slot("ts", 1000).alias("_slice"), "ts", (F.col("ts") + F.col("ttl")).alias("until")).dropDuplicates(["remote", "ts"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = chains.sliced(nodes, ["remote"], "ts").filter("remote = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = sum(r["count"] for r in spread)
    assert total > 2000 and len(spread) == 4 and max(r["count"] for r in spread) < 0.5 * total


def test_functions_take_a_few_bytes_a_row(spark):
    at = F.col("id") * 10 + F.col("id") * F.col("id") % 7
    nodes = spark.range(50_000).select(F.lit("k").alias("remote"), slot(at, 50_000).alias("_slice"), at.alias("ts"), (at + 25).alias("until"))
    found = chains.exits(nodes, ["remote"], "ts").collect()
    assert len(found) >= 10 and sum(len(r["lasts"]) + len(r["places"]) + len(r["exits"]) for r in found) < 50_000
