"""Spark session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE splits skewed join partitions and sizes shuffles at run time, so no job
# hard-codes a partition count. Times are UTC; reports take a time zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Sessions of one batch are merged before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Stateful stream operators keep timers and per-key state in this provider.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_session(app_name: str = "tidewatch", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, "spark.sql.streaming.stateStore.providerClass": STATE_STORE, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


