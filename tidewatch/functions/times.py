"""Epoch arithmetic and local calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND_US = 1_000_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_ts_us(df: DataFrame) -> DataFrame:
    """Add ``ts_us`` (epoch microseconds) from ``ts`` unless it is there."""
    if "ts_us" in df.columns:
        return df
    return df.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


def slot(ts: Column | str, width: int) -> Column:
    """Number of the time slice of ``width`` units that holds ``ts``."""
    return F.call_function("div", _c(ts), F.lit(width).cast("bigint"))


def local_time(ts_ms: Column | str, tz: str) -> Column:
    """Wall-clock time in ``tz`` as a timestamp in the session's UTC."""
    return F.from_utc_timestamp(F.timestamp_millis(_c(ts_ms)), tz)


def local_date(ts_ms: Column | str, tz: str) -> Column:
    return F.to_date(local_time(ts_ms, tz))
