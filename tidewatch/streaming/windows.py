"""Streaming operators over windows, most of them Spark's own.

All take event-time ``ts`` and a watermark delay: rows later than it are
dropped by Spark and show up in the query's progress metrics (``late.split_late``
keeps them). Rows of several hosts carry ``host``, which is then part of keys. Results are for
append mode.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.times import SECOND_US, with_ts_us
from tidewatch.operators.crossflow import DIVERSITY_S, WINDOW_S
from tidewatch.operators.flows import describe, time_and_direction, with_flow_key
from tidewatch.plans.versions import shared_owner
from tidewatch.schema import FLOW_KEY
from tidewatch.streaming.buckets import BUCKETS, NEVER, bucket, coded, packed, unpacked

# A session window merges rows exactly one gap apart; a flow ends at exactly
# five seconds of silence, so its gap is one microsecond less.
FLOW_GAP = "4 seconds 999999 microseconds"


def stream_flows(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Flow sessions, each emitted once when the watermark passes its end."""
    keyed = with_flow_key(with_ts_us(packets)).withWatermark("ts", delay)
    keys = [*FLOW_KEY, *shared_owner(packets)]
    runs = keyed.groupBy(*keys, F.session_window("ts", FLOW_GAP)).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("packet_count"),
        F.sum(F.col("length").cast("bigint")).alias("byte_count"), F.min(time_and_direction()).alias("_direction"),
        F.min("local_ip").alias("local_ip"),
    )
    return describe(runs.drop("session_window"), keys)


def stream_scan_dns(connections: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Final connection and DNS counts per (pid, remote) session."""
    dns = (F.col("protocol") == 17) & (F.col("remote_port") == 53)
    host = shared_owner(connections)
    return (
        connections.withWatermark("ts", delay)
        .groupBy(*host, F.coalesce("pid", F.lit(0)).alias("pid"), "remote_ip", F.session_window("ts", f"{WINDOW_S} seconds").alias("w"))
        .agg(F.count("*").alias("scan_count"), F.count_if(dns).alias("dns_count"))
        .select(*host, "pid", "remote_ip", F.unix_micros("w.start").alias("first_us"), "scan_count", "dns_count")
    )


class Sliding(StatefulProcessor):
    """Distinct remotes and connections of a bucket's keys in sliding windows.

    A connection is held once, with the first and last window it is in, and not
    once for each. A window is told when the watermark has passed its end, and
    only once: what comes later counts in those that are still open.
    """

    def __init__(self, names: list[str], width_us: int, slide_us: int):
        self.names, self.width, self.slide = names, width_us, slide_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "done long, packed binary")

    def handleInputRows(self, key, rows, timerValues):
        done, held = self._held()
        new = pd.concat(list(rows))
        ts = new.pop("ts_us").to_numpy("int64")
        new["low"], new["high"] = (ts - self.width) // self.slide + 1, ts // self.slide
        by = [*self.names, "remote_ip", "low", "high"]
        code = coded(new, by)
        first = np.unique(code, return_index=True)[1]
        new = new.iloc[first][by].assign(n=np.bincount(code))
        rows = pd.concat([held, new[new["high"] > done]], ignore_index=True) if len(held) else new[new["high"] > done]
        self._keep(done, rows)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done, held = self._held()
        upto = (timerValues.getCurrentWatermarkInMs() * 1000 - self.width) // self.slide
        told = self._told(held, done, upto) if len(held) else None
        self._keep(max(done, upto), held[held["high"] > upto] if len(held) else held)
        if told is not None and len(told):
            yield told

    def _held(self) -> tuple[int, pd.DataFrame]:
        if not self.state.exists():
            return NEVER, pd.DataFrame()
        done, rows = self.state.get()
        return done, unpacked(bytes(rows)).to_pandas()

    def _keep(self, done: int, rows: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((done, packed(pa.Table.from_pandas(rows, preserve_index=False))))
        if len(rows):
            upcoming = max(int(rows["low"].min()), done + 1)
            self.handle.registerTimer(-(-(upcoming * self.slide + self.width) // 1000))

    def _told(self, rows: pd.DataFrame, done: int, upto: int) -> pd.DataFrame:
        """The windows after ``done``, and up to ``upto``, that hold a row."""
        code, pair = coded(rows, self.names), coded(rows, [*self.names, "remote_ip"])
        order = np.lexsort((rows["high"], pair))
        low, high, n = (rows[c].to_numpy("int64")[order] for c in ("low", "high", "n"))
        own, alike = code[order], np.append(False, pair[order][1:] == pair[order][:-1])
        # A remote is there from its first window on, and goes on from one connection to the next.
        begin = np.where(alike, np.maximum(low, np.roll(high, 1) + 1), low)
        fresh = (begin <= high).astype("int64")
        at, nothing = np.concatenate([begin, high + 1, low, high + 1]), np.zeros(2 * len(rows), "int64")
        moves = pd.DataFrame({
            "code": np.tile(own, 4), "at": at, "ips": np.concatenate([fresh, -fresh, nothing]), "conns": np.concatenate([nothing, n, -n]),
        }).groupby(["code", "at"]).sum()
        whose, since = (moves.index.get_level_values(c).to_numpy() for c in ("code", "at"))
        # The moves of a key add up to nothing, so sums needn't start anew.
        sums = moves.cumsum()
        until = np.append(since[1:], 0)
        low, high = np.maximum(since, done + 1), np.minimum(until - 1, upto)
        count = np.where(sums["conns"].to_numpy() > 0, np.maximum(high - low + 1, 0), 0)
        stretch = np.repeat(np.arange(len(count)), count)
        window = low[stretch] + np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
        first = np.unique(code, return_index=True)[1]
        return rows[self.names].iloc[first[whose[stretch]]].assign(
            window_end_us=window * self.slide + self.width, distinct_ips=sums["ips"].to_numpy()[stretch], pid_connections=sums["conns"].to_numpy()[stretch])

    def close(self) -> None:
        pass


def stream_diversity(connections: DataFrame, delay: str = "10 seconds", slide: str = "1 second") -> DataFrame:
    """Distinct remotes per pid in sliding windows, exactly.

    Pids are dealt into buckets, and a bucket's windows are counted in arrays
    (``Sliding``), so that a connection is moved and held once and not in each
    of its windows.
    """
    host = shared_owner(connections)
    names = [*host, "pid"]
    slide_us = connections.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {slide})").first()[0]
    kind = connections.schema["pid"].dataType.simpleString()
    # The time is a plain number below the watermark: a row counts in its open windows even if others are past.
    rows = connections.filter(F.col("pid").isNotNull()).withWatermark("ts", delay).filter(F.col("ts").isNotNull()).select(
        *names, "remote_ip", F.unix_micros("ts").alias("ts_us"), bucket(names, BUCKETS))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Sliding(names, DIVERSITY_S * SECOND_US, slide_us), outputMode="append", timeMode="eventTime",
        outputStructType=f"{'host string, ' * len(host)}pid {kind}, window_end_us long, distinct_ips long, pid_connections long",
    )
